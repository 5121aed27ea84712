from pyspark.sql import functions as F

from lakewatch.operators import postings, search
from lakewatch.sources import corpus
from tests.conftest import SF

SMALL = SF.replace("0.01", "0.001")


def test_search_and_update_touch_what_they_must(spark, tmp_path):
    docs, path = corpus.corpus(spark, SMALL), str(tmp_path / "index")
    ids = lambda df: [r.doc_id for r in df.collect()]
    postings.build(docs, path)
    for terms in (["favorito", "en"], ["the"], ["of the", "and"], ["no such"], ["x"]):
        assert ids(postings.search(spark, path, terms)) == ids(search.indexed_search(docs, search.indexed(docs), terms)), terms
    read = postings.lookup(spark, path, "Favorito")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,favorito)" in plan
    assert postings.update(docs, path) == 0
    changed = docs.withColumn("user_tags", F.when(F.col("doc_id") == 10, F.array(F.lit("novo"))).otherwise(F.col("user_tags"))).where("doc_id <> 20")
    more = changed.unionByName(docs.where("doc_id = 20").withColumn("doc_id", F.lit(9_999_999).cast("long")))
    before = spark.read.parquet(f"{path}/texts").count()
    assert postings.update(more, path) == 2 and spark.read.parquet(f"{path}/texts").count() == before + 2
    assert ids(postings.search(spark, path, ["novo"])) == [10]
    assert 10 not in ids(postings.search(spark, path, ["favorito"], 1000)) and 9_999_999 in ids(postings.search(spark, path, ["favorito"], 1000))
    assert postings.update(more, path, version=3) == more.count()
    postings.compact(spark, path, str(tmp_path / "new"))
    assert spark.read.parquet(str(tmp_path / "new/texts")).count() == before + 1
    for terms in (["novo"], ["favorito"], ["the"]):
        assert ids(postings.search(spark, str(tmp_path / "new"), terms)) == ids(postings.search(spark, path, terms))


def test_terms_are_read_from_what_was_written_and_no_text_is_sorted(spark, tmp_path):
    docs, path = corpus.corpus(spark, SMALL), str(tmp_path / "index")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [doc_id" in plan and "LeftOuter" in plan
    postings.build(docs, path)
    stored = spark.read.parquet(f"{path}/texts")
    assert "terms" in stored.columns and stored.select(F.explode("terms")).count() == spark.read.parquet(f"{path}/postings").count()
