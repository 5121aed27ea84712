import pyarrow as pa
from pyspark.sql import functions as F

from lakewatch.llm import common, packing


def test_batches_for_workers_are_bounded_by_bytes(spark):
    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.column(0).buffers()[2].size], pa.int64())], names=["size"])

    docs = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    sizes = [r.size for r in common.map_arrow(docs, run, "size long").collect()]
    assert max(sizes) <= 2 * common.BATCH_BYTES


def test_workers_drop_the_tokenizer_when_another_stage_runs(spark):
    def run(batches):
        for _ in batches:
            yield pa.record_batch([pa.array([len(packing._tokenizers)], pa.int64())], names=["n"])

    def own(batches):
        return run(batches)

    own.__module__ = packing.__name__
    ids = spark.range(0, 64, 1, 16)
    docs = ids.select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"))
    assert packing.pieces(docs).count() == 64
    assert sum(r.n for r in common.map_arrow(ids, own, "n long").collect())  # a task of its module finds it
    assert not sum(r.n for r in common.map_arrow(ids, run, "n long").collect())
