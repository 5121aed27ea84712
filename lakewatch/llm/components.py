"""Connected components by alternating large-star and small-star steps, each a grouping by node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links of comparable ids -> (node, root), root the smallest id that the node reaches.

    A node's neighbours are never gathered: its smallest one is a partial aggregation that is joined back, so a hub's rows can be
    split. Rounds are logarithmic in practice; each ends in a table in the shared folder. Nodes without links
    don't appear; null ends are ignored.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = lambda t: t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = state(links)
    for _ in range(most_rounds):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        links = materialize(small, "links")
        after = state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
