"""A table played as a stream: its rows land as files in order of time, in parts; a stream with a checkpoint is started for each
part, ends with it, and is started again for the next one, so its state has to survive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.session import scratch, shared_dir
from lakewatch.streaming.jobs import use_state_store


def replay(table: DataFrame, time: str, transform: Callable[[DataFrame], DataFrame], parts: int = 2, mode: str = "update") -> DataFrame:
    """What the stream `transform` gives over the rows of `table`, cut at quantiles of the column `time` into `parts` landings.
    Rows of the sink are kept under their micro-batch's number: a batch that is run again replaces what it wrote."""
    spark = table.sparkSession
    shared_dir(spark)
    use_state_store(spark)
    root = scratch(spark, "replay")
    table = table.checkpoint()  # computed once: its quantiles and every landing are read from the rows themselves
    at = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = table.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)])).first()[0] or []
    of = sum((F.coalesce((at > c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    landed = table.withColumn("landing", of)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for k in range(parts):
        landed.where(F.col("landing") == k).drop("landing").write.mode("append").parquet(f"{root}/in")
        stream = transform(spark.readStream.schema(table.schema).parquet(f"{root}/in"))
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)
