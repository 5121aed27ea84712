"""Source health: scores, silent runs, failure streaks and heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewatch.operators.analytics import AS_OF, moment, since

#: Zero runs at which an alert is given, and the counter's limit.
ALERT_AT, MOST_ZEROS = 7, 10_000


def health_score(docs: DataFrame, configured: DataFrame, as_of=AS_OF, days: int = 30) -> DataFrame:
    """Items fetched in the window, mean age in days and classified share of every configured source; (0, days, 0) without items."""
    age = (F.unix_micros(moment(as_of)) - F.unix_micros("eff_date")) / F.lit(86_400_000_000.0)
    by = docs.where(since("fetched_at", as_of, days)).groupBy("source_id").agg(F.count(F.lit(1)).alias("items"), F.avg(age).alias("mean_age"), F.avg(F.col("has_llm").cast("double")).alias("classified"))
    j = configured.select(F.col("id").alias("source_id")).join(by, "source_id", "left")
    return j.select("source_id", F.coalesce("items", F.lit(0)).alias("items"), F.bround(F.coalesce("mean_age", F.lit(float(days))), 2).alias("mean_age"), F.bround(F.coalesce("classified", F.lit(0.0)), 3).alias("classified"))


def items_per_month(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_id", F.date_format("eff_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def false_positive_rate(docs: DataFrame, cut: int = 5) -> DataFrame:
    by = docs.where("has_llm").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relevancia") < cut).alias("discarded"))
    return by.select("source_id", "n", "discarded", F.bround(F.col("discarded") / F.col("n"), 3).alias("rate"))


def revision_calendar(docs: DataFrame, as_of=AS_OF, least_days: int = 30) -> DataFrame:
    """Sources whose last document is at least so many whole days old, oldest first."""
    last = docs.groupBy("source_id").agg(F.max("fetched_at").alias("last_fetched"))
    days = F.floor((F.unix_micros(moment(as_of)) - F.unix_micros("last_fetched")) / 86_400_000_000)
    return last.withColumn("days", days).where(F.col("days") >= least_days).orderBy(F.col("days").desc(), "source_id")


def source_volume(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source_id")


def silent_sources(docs: DataFrame, configured: DataFrame, as_of=AS_OF, days: int = 7) -> DataFrame:
    """Every configured source with its documents, last fetch and whether it has been silent."""
    by = docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("fetched_at").alias("last_seen"))
    j = configured.select(F.col("id").alias("source_id"), "ativo").join(by, "source_id", "left")
    return j.select("source_id", "ativo", F.coalesce("n", F.lit(0)).alias("n"), "last_seen", (F.col("last_seen").isNull() | ~since("last_seen", as_of, days)).alias("silent"))


def trailing_verdict(history: DataFrame, off_after: int = 5, on_after: int = 3) -> DataFrame:
    """history(source_id, ok, ts, event_id) -> each source's latest row's verdict: its last `off_after` all failed, or its
    last `on_after` all succeeded; a shorter history gives false."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("ts"), F.desc("event_id"))
    # only a source's last rows go on: Spark keeps that many of each task before the shuffle
    h = history.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= max(off_after, on_after))
    ok = lambda n: F.when(F.col("k") <= n, F.col("ok").cast("int"))
    off = (F.max(ok(off_after)) == 0) & (F.count(ok(off_after)) == off_after)
    on = (F.min(ok(on_after)) == 1) & (F.count(ok(on_after)) == on_after)
    return h.groupBy("source_id").agg(off.alias("should_disable"), on.alias("should_enable"))


def zero_runs(history: DataFrame, alert_at: int = ALERT_AT, days: int = 92) -> DataFrame:
    """history(source_id, run_day, items): consecutive runs without items, reset by any; an alert exactly at `alert_at`.

    A source's history is taken in ranges of `days`. A range's summary (how many runs it has, the place and the day of its last
    one with items) is all that later ranges need of it: the summaries are scanned, a row for each range."""
    h = history.withColumn("range", F.floor(F.datediff("run_day", F.lit("1970-01-01")) / days))
    by = Window.partitionBy("source_id", "range").orderBy("run_day")
    some = F.col("items") > 0
    held = by.rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("place", F.row_number().over(by))
    h = h.withColumn("own_place", F.max(F.when(some, F.col("place"))).over(held)).withColumn("own_day", F.max(F.when(some, F.col("run_day"))).over(held))
    ranges = h.groupBy("source_id", "range").agg(F.count(F.lit(1)).alias("n"), F.max("own_place").alias("last_place"), F.max("own_day").alias("last_day"))
    before = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranges = ranges.select(F.col("source_id").alias("s"), F.col("range").alias("r"), "offset", F.max(F.col("offset") + F.col("last_place")).over(before).alias("old_place"), F.max("last_day").over(before).alias("old_day"))
    j = h.join(ranges, F.col("source_id").eqNullSafe(F.col("s")) & F.col("range").eqNullSafe(F.col("r")))
    zeros = F.col("offset") + F.col("place") - F.coalesce(F.col("offset") + F.col("own_place"), F.col("old_place"), F.lit(0))
    return j.select("source_id", "run_day", "items", F.least(zeros, F.lit(MOST_ZEROS)).alias("consecutive_zero_runs"), F.coalesce("own_day", "old_day").alias("last_nonzero_at"), (zeros == alert_at).alias("alert"))


def zero_run_report(history: DataFrame, k: int = 30) -> DataFrame:
    """Sources whose latest run was empty, longest first, and how many the limit leaves out."""
    latest = zero_runs(history).groupBy("source_id").agg(F.max_by("consecutive_zero_runs", "run_day").alias("zeros")).where("zeros >= 1")
    omitted = latest.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - k).alias("omitted"))
    return latest.orderBy(F.col("zeros").desc(), "source_id").limit(k).crossJoin(omitted)  # one row


def heartbeat(history: DataFrame, as_of=AS_OF, stale_days: int = 7, chronic_at: int = 5) -> DataFrame:
    """Last success and failure, failures since the last success, stale and chronic."""
    h = history.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_failure"), F.max(F.when(F.col("ok"), F.struct("ts", "event_id"))).alias("at"))
    since_ok = history.join(h.select("source_id", "at"), "source_id").where(~F.col("ok") & (F.col("at").isNull() | (F.struct("ts", "event_id") > F.col("at")))).groupBy("source_id").agg(F.count(F.lit(1)).alias("failures"))
    j = h.join(since_ok, "source_id", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    stale = F.col("last_ok").isNull() | (F.col("last_ok") < moment(as_of) - F.expr(f"INTERVAL '{stale_days}' DAY"))
    return j.select("source_id", "last_ok", "last_failure", "failures", stale.alias("stale"), (F.col("failures") >= chronic_at).alias("chronic"))


def alert_eligible(configured: DataFrame) -> DataFrame:
    """The expected count, else 1 for fragile sources, else none; 0 opts out."""
    expected = F.coalesce("expected_min_items_per_week", F.when(F.col("fragile"), 1))
    return configured.select("id", expected.alias("expected"), F.coalesce(expected > 0, F.lit(False)).alias("eligible"))


def top_per_group(docs: DataFrame, group: str, k: int = 50, order: Column | None = None) -> DataFrame:
    """The newest `k` documents of each group."""
    by = Window.partitionBy(group).orderBy(F.col("fetched_at").desc() if order is None else order, "doc_id")
    return docs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
