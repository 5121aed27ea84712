"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source the keys are cut into fixed ranges by their leading hex
digits, so a hot source is spread over thousands of ranges. The ranges' token sums give each range its start in the
source's order (a prefix sum over a bounded table), a window inside each range gives every document its own start, and
the source is cut at its exact budget; a budget above the source's size takes whole epochs first.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id has an empty key.
Rows that agree in source, doc_id and size are interchangeable; ties of keys break by doc_id, then size. Texts of any length
are counted whole. Empty tables give empty results. Columns of the input
other than doc_id, text and source are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewatch.llm.common import WORD, materialize, sized_join

SPACED_WORD = "[\\x20\\x09-\\x0D]*" + WORD
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has this many times the words of the input; no source gives more than CAP times its own.
RATIO, CAP = 1.5, 2.0
#: Leading hex digits of a key that name its range: 16 ** RANGE_DIGITS ranges a source.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> the same with `target`.

    Shares go by weight; those above `cap` times their source's size stop there and the excess is shared again by
    weight. The fixed point is found in one pass over the sources in order of cap by weight: a source is capped if the
    level that is left once all before it are capped reaches its own. The table has one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("level", cap * F.col("source_size") / F.col("weight"))
    left = ratio * F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))
    t = t.withColumn("reached", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("own", F.row_number().over(by_level)).withColumn("free", F.col("reached") < F.col("level"))
    t = t.withColumn("water", F.min(F.when(F.col("free"), F.struct("own", "reached"))).over(every))
    free = F.col("own") >= F.col("water.own")
    return t.select("source", "source_size", F.when(free, F.col("water.reached") * F.col("weight")).otherwise(cap * F.col("source_size")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target of its source, taken (its words in the mix, repeats
    counted), and the row's source and key. `taken` div size whole copies and a first part of `taken` mod size words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = materialize(docs.select("doc_id", "source", size.alias("size")), "mix-sizes")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = base.withColumn("key", key).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    sizes = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("range_start", F.coalesce(F.sum("range_size").over(in_source), F.lit(0)))
    goal = targets(sizes, weights, ratio, cap).withColumn("budget", F.floor(F.col("target") + 0.5))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0))
    starts = starts.alias("r").join(goal.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.source", "range", "range_start", "source_size", "target", "budget", "epochs")
    k, s = keyed.alias("k"), starts.alias("s")
    joined = k.join(s, F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k.range") == F.col("s.range"))).select("k.*", "range_start", "source_size", "target", "budget", "epochs")
    in_range = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("range_start") + F.coalesce(F.sum("size").over(in_range), F.lit(0))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - start
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "key")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: rows of `docs` (all their columns), a whole copy for each time it is taken whole, and at most one
    cut after its first words. Documents that aren't taken go. doc_id is to be unique; of rows that share one, each
    gets what the first in order of size got. A column n_chars, if there is one, follows the text."""
    plan = mix(docs, **params).groupBy("doc_id").agg(F.max_by("taken", "size").alias("taken"), F.max("size").alias("size"))
    plan = materialize(plan, "mix-plan")
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("row")).alias("d")  # no name of theirs can clash
    d = sized_join(rows, plan.alias("p"), plan.count(), 48, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")), "inner").select("row", "taken", "size")
    d = d.withColumn("whole", F.expr("CASE WHEN size > 0 THEN taken div size ELSE 0 END").cast("int"))
    part = F.col("taken") - F.col("whole") * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0), F.col("whole")), F.when(part > 0, F.array(part.cast("int"))).otherwise(F.array().cast("array<int>")))
    d = d.select("row", F.explode(copies).alias("cut"))
    parts = F.regexp_extract_all("row.text", F.lit(SPACED_WORD), F.lit(0))  # words, each with what separates it from the one before
    text = F.when(F.col("cut") > 0, F.array_join(F.slice(parts, 1, F.greatest(F.col("cut"), F.lit(1))), "")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return d.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH b AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM b GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size / weight AS level FROM w),
o AS (SELECT *, row_number() OVER (ORDER BY level, source NULLS LAST) AS own,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reached FROM l),
f AS (SELECT min(own) AS own, arg_min(reached, own) AS water FROM o WHERE reached < level),
t AS (SELECT o.source, source_size, CASE WHEN f.own IS NOT NULL AND o.own >= f.own THEN water * weight ELSE 2.0::DOUBLE * source_size END AS target FROM o, f),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT b.*, g.source_size, g.target, g.budget, g.epochs, coalesce(sum(size) OVER (PARTITION BY b.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken, source, key FROM p
"""
