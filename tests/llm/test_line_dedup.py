import random

from lakewatch.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, __id string, removed_lines string"


def brute(rows, threshold=0.8):
    """(doc_id, line) that go, by comparing every line with every earlier one."""
    lines = [(d, k, set(x.encode().lower().split())) for d, t in rows if d is not None and t for k, x in enumerate(t.split("\n"))]
    lines = sorted((x for x in lines if x[2]), key=lambda x: x[:2])
    gone = set()
    for i, (d, k, s) in enumerate(lines):
        for e, j, o in lines[:i]:
            if (e, j) < (d, k) and 9 * len(s & o) >= 4 * (len(s) + len(o)) and len(s & o) >= threshold * len(s | o) - 1e-9:
                gone.add((d, k))
                break
    return gone


def corpus(seed, docs=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "naïve", "X"]
    pool = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 10, 20, 30]))] for _ in range(25)]
    rows = []
    for d in range(docs):
        text = []
        for _ in range(r.randint(0, 8)):
            line = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                line[r.randrange(len(line))] = r.choice(words)
            if r.random() < 0.2:
                r.shuffle(line)
            text.append(r.choice([" ", "  ", "\t"]).join(line).upper() if r.random() < 0.1 else " ".join(line))
            if r.random() < 0.1:
                text.append(r.choice(["", " ", "\r"]))
        rows.append((d, "\n".join(text)))
    rows += [(900, None), (None, rows[3][1]), (901, ""), (902, "\n\n"), (903, "w1"), (904, "w1\n"), (905, "long " + " ".join(f"v{i}" for i in range(3000))), (906, "long " + " ".join(f"v{i}" for i in range(2900))), (907, "w1")]
    return rows


def test_removed_lines_equal_brute_force(spark):
    for seed, params in ((1, {}), (2, {"block": 1, "most": 1}), (3, {"block": 3, "most": 2}), (4, {"dense": 1}), (5, {"dense": 4, "block": 4, "most": 1})):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, None, "x", "y") for d, t in rows], SCHEMA).repartition(5)
        got = {tuple(r) for r in line_dedup.removed_lines(df, **params).collect()}
        assert got == brute(rows)


def test_rows_that_share_a_doc_id_are_one_document(spark):
    rows = [(1, "a b c d e f\nx y z"), (1, "a b c d e f\nx y z\nq r s t"), (2, "x y z\nq r s t"), (2, None)]
    out = line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text or "", r.removed_lines) for r in out.collect()) == [(1, "a b c d e f\nx y z", []), (1, "a b c d e f\nx y z\nq r s t", []), (2, "", [0, 1]), (2, "", [0, 1])]


def test_a_dense_list_is_held_in_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, sig = 40_000, np.random.default_rng(1).integers(0, 2, 40_000)
    columns = [np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int32), np.full(n, 40 << 32), sig, *[np.zeros(n, np.int64)] * 3]
    batches = [pa.record_batch([pa.array(c[k : k + 10_000]) for c in columns], names=list("abcdefgh")) for k in range(0, n, 10_000)]
    tracemalloc.start()
    kinds = np.zeros(3, int)
    for b in line_dedup._list_heads(iter(batches), 0.8, 256, 8):
        kinds += np.bincount(b.column(0).to_numpy(), minlength=3)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert kinds.tolist() == [n - 1, n - 9, 256]


def test_texts_lose_exactly_the_removed_lines(spark):
    rows = corpus(4, 30)
    gone = brute(rows)
    df = spark.createDataFrame([(d, t, None, "x", "y") for d, t in rows], SCHEMA)
    out = line_dedup.deduplicate(df)
    assert out.columns == ["doc_id", "text", "lang", "__id", "removed_lines"]
    want = {d: t if t is None or d is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    assert {r.doc_id: r.text for r in out.collect()} == want


def test_empty_table(spark):
    assert line_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packed_keys_come_back_and_are_small_however_many_tasks_they_go_to():
    import numpy as np

    r, n = np.random.default_rng(3), 100_000
    lines = r.integers(0, 10_000, n)
    columns = [r.integers(0, 1 << line_dedup.KEY_BITS, n), lines + 51_000, (lines % 10).astype(np.int32), (20 + lines % 20) << 32 | r.integers(0, 5, n), r.integers(-(1 << 63), 1 << 63, 10_000)[lines], *[np.zeros(n, np.int64)] * 3]
    columns[1][:2], columns[2][:2], columns[3][:2] = (-(1 << 63), (1 << 63) - 1), ((1 << 31) - 1, 0), (1 << 62, 1)
    blocks = list(line_dedup._pack(columns))
    got = np.concatenate([line_dedup._unpack(*b) for b in blocks], 1)
    order = np.argsort(columns[0], kind="stable")
    assert sorted(zip(*got.tolist())) == sorted(zip(*(c[order].tolist() for c in columns)))
    assert len(blocks) > 500 and sum(len(b[2]) for b in blocks) < 26 * n  # rows of the columns took 34 to 39 bytes, in lz4


def test_rows_of_keys_are_shuffled_packed(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(d, t) for d, t in corpus(6) if d is not None], "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    import numpy as np

    none = spark.createDataFrame([], "doc_id long, line int")
    rows = line_dedup._postings(line_dedup._blocks(docs.repartition(4), np.full(1 << 16, 16, np.uint8), none, 0.8, 1024))
    parts = rows.select("token", F.spark_partition_id().alias("p")).distinct().groupBy("token").count()
    assert rows.columns == list(line_dedup.POSTING) and parts.where("count > 1").isEmpty() and rows.count() > 0


def test_ranges_larger_than_memory_are_sorted_by_spark_and_long_lists_cross_groups(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUPED", 64)
    docs = spark.createDataFrame([(d, t) for d, t in corpus(7) if d is not None], "doc_id long, text string").selectExpr("doc_id", "CAST(coalesce(text, '') AS BINARY) text")
    import numpy as np

    none = spark.createDataFrame([], "doc_id long, line int")
    blocks = line_dedup.materialize(line_dedup._blocks(docs.repartition(4), np.full(1 << 16, 16, np.uint8), none, 0.8, 1024), "test-blocks")
    rows = {held: sorted(map(str, line_dedup._first_blocks(blocks, 0.8, 2, 1, held).where("kind = 1").select("rank", "token", "doc_id", "line").collect())) for held in (0, 100, 1 << 21)}
    assert rows[0] and rows[0] == rows[100] == rows[1 << 21]


def test_keys_are_packed_in_the_scan_and_without_repeated_lines(spark):
    docs = spark.createDataFrame([(d, t) for d, t in corpus(8) if d is not None], "doc_id long, text string").selectExpr("doc_id", "CAST(coalesce(text, '') AS BINARY) text")
    import numpy as np

    gone = spark.createDataFrame([(d, k) for d in range(0, 60, 2) for k in range(5)], "doc_id long, line int")
    table = np.full(1 << 16, 16, np.uint8)
    plan = line_dedup._blocks(docs, table, gone, 0.8, 1024)
    assert str(plan._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1  # two Python workers a core held too much
    places = [{(r.token, r.doc_id, r.line) for r in line_dedup._postings(x).collect()} for x in (plan, line_dedup._blocks(docs, table, gone, 0.8, 1024, -1), line_dedup._blocks(docs, table, gone.limit(0), 0.8, 1024))]
    left = {x for x in places[2] if not (x[1] < 60 and x[1] % 2 == 0 and x[2] < 5)}
    assert places[0] == places[1] == left and left < places[2]


def test_order_of_keys_is_that_of_places_for_any_ids():
    import numpy as np

    r = np.random.default_rng(5)
    for ids in ((0, 50), (-(1 << 63), (1 << 63) - 1)):
        token, doc_id, line = r.integers(0, 40, 500), r.integers(*ids, 500), r.integers(0, 9, 500).astype(np.int32)
        order, want = line_dedup._in_order(token, doc_id, line), np.lexsort((line, doc_id, token))
        assert all((c[order] == c[want]).all() for c in (token, doc_id, line))
