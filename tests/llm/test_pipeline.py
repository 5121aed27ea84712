from pyspark.sql import functions as F

import corpus_pipeline
from lakewatch.llm import simhash
from tests.conftest import SF
from tests.llm.test_line_dedup import brute
from tests.llm.test_packing import check


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    docs = docs.unionByName(docs.limit(1).select(F.lit(10**6).alias("doc_id"), F.lit("12 !").alias("text"), F.lit("en").alias("lang"), "source", "n_chars").select(*docs.columns)).cache()
    columns, stage = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "harmonic_packing"]
    told = stage["language_id"](spark, docs, SF).cache()
    assert told.columns == columns and told.count() == 150 and told.where("doc_id = 1000000").count() == 0
    lines = stage["line_dedup"](spark, told, SF).cache()
    rows = [(r.doc_id, r.text) for r in told.collect()]
    gone = brute(rows)
    want = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    assert {r.doc_id: r.text for r in lines.collect()} == {d: t for d, t in want.items() if t.strip()} and lines.columns == columns
    single = stage["simhash_near_dedup"](spark, lines, SF).cache()
    least = {r.component_id for r in simhash.components(lines).collect()}
    assert {r.doc_id for r in single.collect()} == least and single.columns == columns
    mixed = stage["mix_sources"](spark, single, SF).cache()
    words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert mixed.columns == columns and abs(words(mixed) - 1.5 * words(single)) <= 20
    packed = stage["harmonic_packing"](spark, mixed, SF).collect()
    assert sum(r.length for r in packed if r.start == 0) > 0 and {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    once = mixed.dropDuplicates(["doc_id"])
    check(corpus_pipeline.packing.pack(once).collect(), {r.doc_id: r.text for r in once.collect()})


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    a, b = "the cat sat on the mat and slept all day", "a dog ran over the old green hill at noon"
    rows = [(1, f"{a}\n{b}", "en", "s"), (1, f"{a}\n{b}", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (4, a, "en", "s"), (5, "12 !", "de", "t"), (None, "words without an id stay here", None, None), (6, "der hund lief heute schnell nach hause zurück", "de", None), (7, "long " * 20000, "en", "t")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", k, 2.0 + k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row string, size int, score double")
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    told = stage["language_id"](spark, docs, SF).cache()
    assert ids(told) == [0, 1, 1, 4, 6, 7] and told.columns == docs.columns
    assert sorted(map(tuple, told.collect()), key=repr) == sorted((tuple(r) for r in docs.collect() if (r.doc_id or 0) in (0, 1, 4, 6, 7)), key=repr)
    lines = stage["line_dedup"](spark, told, SF).cache()
    assert ids(lines) == [0, 1, 1, 6, 7] and lines.columns == docs.columns  # 4 has no line of its own
    single = stage["simhash_near_dedup"](spark, lines, SF).cache()
    assert ids(single) == [0, 1, 6, 7] and single.columns == docs.columns
    mixed = stage["mix_sources"](spark, single, SF).cache()
    assert set(ids(mixed)) <= {0, 1, 6, 7} and mixed.columns == docs.columns and mixed.where("n_chars <> length(text)").count() == 0
    packed = stage["harmonic_packing"](spark, mixed, SF).collect()
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)


def test_run_survives_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_last_stage_returns_the_token_ids(spark):
    rows = [(1, "a b c"), (2, "w " * 3000), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    packed = dict(corpus_pipeline.STAGES)["harmonic_packing"](spark, docs, SF)
    assert dict(packed.dtypes)["ids"] == "array<int>"
    check(packed.collect(), dict(rows))
