import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lakewatch.llm import mixing


def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over
        if len(capped) == len(names):
            return {s: 2.0 * sizes[s] for s in names}


ROWS = [(i, "w " * (i * 7 % 23), f"s{i % 4}") for i in range(80)] + [(100, None, "s1"), (101, "", None), (102, "a b c", None), (None, "x y", "s0"), (103, "w " * 5000, "s3"), (104, "z", "S"), (104, "z", "S")]
SCHEMA = "doc_id long, text string, source string"


def test_mix_equals_brute_force(spark):
    got = mixing.mix(spark.createDataFrame(ROWS, SCHEMA)).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in ROWS]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(ROWS, size):
        sizes[s] += n
    target = water_fill(sizes)
    want = []
    for s in sizes:
        budget = int(target[s] + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for (d, _, _), n in sorted(((r, n) for r, n in zip(ROWS, size) if r[2] == s), key=lambda x: (hashlib.md5(("" if x[0][0] is None else str(x[0][0])).encode()).hexdigest(), x[1])):
            take = epochs * n + max(0, min(n, rest))
            rest -= n
            want.append((d, n, sizes[s], take))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r["size"], r.source_size, r.taken) for r in got), key=order) == sorted(want, key=order)
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.taken <= 2 * r["size"] for r in got)


def test_mixed_documents_hold_the_taken_words(spark):
    df = spark.createDataFrame(ROWS[:80], SCHEMA).withColumn("n_chars", F.length("text")).withColumn("cut", F.lit(9)).withColumn("row", F.lit("x")).withColumn("taken", F.lit("t"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    assert out.where("n_chars <> length(text) OR `cut` <> 9").count() == 0
    lined = spark.createDataFrame([(i, "one two\nthree  four\n\nfive six", "s") for i in range(3)], SCHEMA)
    texts = [r.text for r in mixing.mixed_documents(lined, ratio=1.3, cap=2.0).collect()]
    assert sorted(texts)[0] == "one two\nthree  four\n\nfive" and len(texts) == 4  # 23 of 18 words: a cut keeps its line breaks


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", "k", 5, "r", 1.0)], SCHEMA + ", key string, size long, range string, target double")
    assert mixing.mix(df).select("size", "taken").first() == (2, 3) and mixing.mixed_documents(df).columns == df.columns


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], SCHEMA)).collect()] == [0, 0]
