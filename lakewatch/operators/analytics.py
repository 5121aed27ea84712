"""Aggregations over the corpus. `as_of` is a timestamp column or string; every ranking breaks ties by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewatch.session import shared_dir

AS_OF = "2024-01-31 00:00:00"


def moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def since(column: str, as_of, days: int) -> Column:
    return F.col(column) >= moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")


def split_list(c: Column) -> Column:
    """A comma list's items, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def counted(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def top(df: DataFrame, k: int, value: str, *keys: str) -> DataFrame:
    return df.orderBy(F.col(value).desc(), *keys).limit(k)


def trending_topics(docs: DataFrame, as_of=AS_OF, days: int = 30, k: int = 10) -> DataFrame:
    items = F.concat(F.coalesce("tags", F.array()), F.coalesce(split_list(F.col("metadados")["temas_especificos"]), F.array()))
    recent = docs.where(F.col("has_llm") & since("eff_date", as_of, days))
    return top(counted(recent.select(F.explode(items).alias("topic")), "topic"), k, "n", "topic")


def top_sources_by_relevance(docs: DataFrame, least: int = 3, k: int = 10) -> DataFrame:
    rated = docs.where("has_llm").groupBy("source_id").agg(F.avg("relevancia").alias("avg_relevancia"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return top(rated, k, "avg_relevancia", "source_id")


def top_ufs(docs: DataFrame, k: int = 10) -> DataFrame:
    return top(counted(docs, "uf"), k, "n", "uf")


def coverage_gaps(docs: DataFrame, active: list[str], as_of=AS_OF, days: int = 14) -> DataFrame:
    """Active regions without a document in the window."""
    asked = docs.sparkSession.createDataFrame([(u,) for u in active], "uf string")
    return asked.join(docs.where(since("eff_date", as_of, days)).select("uf").distinct(), "uf", "left_anti").orderBy("uf")


def rates_by_uf(docs: DataFrame) -> DataFrame:
    """Distinct rates of each region in order of first sight (date, document, place in the list)."""
    seen = docs.select("uf", F.posexplode(split_list(F.col("metadados")["aliquotas"])).alias("pos", "rate"), F.struct("eff_date", "doc_id").alias("at"))
    first = seen.groupBy("uf", "rate").agg(F.min(F.struct("at", "pos")).alias("first"))
    return first.groupBy("uf").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "rate"))), lambda x: x["rate"]).alias("aliquotas"))


def money_mentions(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count_if(F.coalesce(F.col("metadados")["valores_monetarios"], F.lit("")) != "").alias("n"))


def tag_frequency(docs: DataFrame, k: int = 20) -> DataFrame:
    return top(counted(docs.select(F.explode("tags").alias("tag")), "tag"), k, "n", "tag")


def maturity(docs: DataFrame, tipos: int = 9) -> DataFrame:
    """0.4 volume by the largest + 0.4 mean relevance by 10 + 0.2 distinct act types by `tipos`."""
    by = docs.groupBy("uf").agg(F.count(F.lit(1)).alias("volume"), F.avg("relevancia").alias("rel"), F.count_distinct("tipo").alias("tipos"))
    score = 0.4 * F.col("volume") / F.max("volume").over(Window.partitionBy()) + 0.4 * F.coalesce("rel", F.lit(0.0)) / 10 + 0.2 * F.col("tipos") / tipos
    return by.select("uf", F.bround(score, 3).alias("score"))


def proactivity(docs: DataFrame, tipos=("view", "click", "purchase"), as_of=AS_OF, days: int = 90) -> DataFrame:
    return counted(docs.where((F.col("source_tipo") == "sefaz") & F.col("tipo").isin(*tipos) & since("eff_date", as_of, days)), "uf")


def actuality(docs: DataFrame, as_of=AS_OF) -> DataFrame:
    age = (F.unix_micros(moment(as_of)) - F.unix_micros("eff_date")) / F.lit(86_400_000_000.0)
    return docs.groupBy("uf").agg(F.bround(F.avg(age), 1).alias("mean_age_days"))


def seasonality(docs: DataFrame) -> DataFrame:
    return counted(docs.withColumn("month", F.date_format("eff_date", "yyyy-MM")), "month").orderBy("month")


def consolidated(docs: DataFrame, active: list[str], as_of=AS_OF, tipos: int = 9, rated=("view", "click", "purchase")) -> DataFrame:
    """All of the above in long form: metric, key, value. One pass: every document gives its (metric, key, part) rows, one
    aggregation counts them, and all figures come from that table, which is small and written once."""
    row = lambda metric, key, part=None: F.struct(F.lit(metric).alias("metric"), F.coalesce(key, F.lit("")).alias("key"), (F.lit(None).cast("string") if part is None else part).alias("part"))
    none = F.array().cast("array<struct<metric: string, key: string, part: string>>")
    only = lambda when, *rows: F.when(when, F.array(*rows)).otherwise(none)
    listed = lambda metric, a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: row(metric, t))
    topics = F.concat(F.coalesce("tags", F.array()), F.coalesce(split_list(F.col("metadados")["temas_especificos"]), F.array()))
    month, uf = F.date_format("eff_date", "yyyy-MM"), F.col("uf")
    told = [
        *[F.when(F.col("has_llm") & since("eff_date", as_of, d), listed(f"trending_{d}d", topics)).otherwise(none) for d in (7, 30, 90)],
        F.array(row("uf", uf, F.col("tipo")), row("seasonality", month)), only(F.col("has_llm"), row("source", F.col("source_id"))), only(since("eff_date", as_of, 14), row("recent", uf)),
        F.transform(F.coalesce(split_list(F.col("metadados")["aliquotas"]), F.array().cast("array<string>")), lambda r: row("rate", uf, r)), listed("tags", F.col("tags")),
        only(F.coalesce(F.col("metadados")["valores_monetarios"], F.lit("")) != "", row("money_mentions", F.lit(""))),
        only((F.col("source_tipo") == "sefaz") & F.col("tipo").isin(*rated) & since("eff_date", as_of, 90), row("proactivity", uf)),
    ]
    age = (F.unix_micros(moment(as_of)) - F.unix_micros("eff_date")) / F.lit(86_400_000_000.0)
    shared_dir(docs.sparkSession)
    each = docs.select("relevancia", "has_llm", age.alias("age"), F.explode(F.concat(*told)).alias("x")).select("relevancia", "has_llm", "age", "x.*")
    g = each.groupBy("metric", "key", "part").agg(F.count(F.lit(1)).alias("n"), F.count("relevancia").alias("rated"), F.coalesce(F.sum("relevancia"), F.lit(0)).alias("sum"), F.sum("age").alias("age"), F.count_if("has_llm").alias("classified")).checkpoint()
    of = lambda m: g.where(F.col("metric") == m)
    out = lambda df, metric, value: df.select(F.lit(metric).alias("metric"), F.col("key").cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    one = lambda df, metric: out(df.withColumn("key", F.lit("")), metric, "n")
    ufs = of("uf").groupBy("key").agg(F.sum("n").alias("n"), F.sum("rated").alias("rated"), F.sum("sum").alias("sum"), F.sum("age").alias("age"), F.count("part").alias("tipos"))
    score = 0.4 * F.col("n") / F.max("n").over(Window.partitionBy()) + 0.4 * F.when(F.col("rated") > 0, F.col("sum") / F.col("rated")).otherwise(0.0) / 10 + 0.2 * F.col("tipos") / tipos
    gaps = docs.sparkSession.createDataFrame([(u,) for u in active], "key string").join(of("recent").select("key"), "key", "left_anti").withColumn("n", F.lit(1))
    sources = of("source").where("rated >= 3").withColumn("avg", F.col("sum") / F.col("rated"))
    parts = [out(top(of(m), 10, "n", "key"), m, "n") for m in ("trending_7d", "trending_30d", "trending_90d")]
    parts += [
        out(top(sources, 10, "avg", "key"), "top_sources", "avg"), out(top(ufs, 10, "n", "key"), "top_ufs", "n"), out(gaps, "gaps", "n"), out(of("rate").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "rates", "n"),
        one(of("money_mentions").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "money_mentions"), out(top(of("tags"), 20, "n", "key"), "tags", "n"), out(ufs.withColumn("score", F.bround(score, 3)), "maturity", "score"),
        out(ufs.withColumn("mean", F.bround(F.col("age") / F.col("n"), 1)), "actuality", "mean"), out(of("proactivity"), "proactivity", "n"), out(of("seasonality"), "seasonality", "n"),
        one(ufs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "total"), one(of("uf").agg(F.coalesce(F.sum("classified"), F.lit(0)).alias("n")), "classified"),
    ]
    return reduce(DataFrame.unionByName, parts)


def dashboard(docs: DataFrame, configured: DataFrame, as_of=AS_OF, recent: int = 20) -> DataFrame:
    """Panel, key, value: by region (all, last 7 days), topic, severity, last 7 days' total, silent sources, newest documents."""
    week = since("fetched_at", as_of, 7)
    row = lambda df, panel, key: df.select(F.lit(panel).alias("panel"), F.col(key).cast("string").alias("key"), F.col("n").cast("long").alias("n"))
    silent = configured.where("ativo").select(F.col("id").alias("source_id")).join(docs.where(week).select("source_id").distinct(), "source_id", "left_anti")
    newest = top(docs.select("doc_id", "fetched_at"), recent, "fetched_at", "doc_id").withColumn("n", F.unix_seconds("fetched_at"))
    parts = [
        row(counted(docs, "uf"), "uf", "uf"), row(counted(docs.where(week), "uf"), "uf_7d", "uf"), row(counted(docs.select(F.explode("topics").alias("topic")), "topic"), "topic", "topic"),
        row(counted(docs.select(F.coalesce("severity_tier", F.lit("n/a")).alias("tier")), "tier"), "severity", "tier"), row(docs.where(week).agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.lit("")), "total_7d", "key"),
        row(silent.agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.lit("")), "silent", "key"), row(newest, "recent", "doc_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def status_counts(docs: DataFrame, as_of=AS_OF, quota: int = 1500) -> DataFrame:
    """Metric, key, n: documents by status, by region in 7 days, classified in the last day, and what is left of the quota."""
    row = lambda df, metric, key: df.select(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"), F.col("n").cast("long").alias("n"))
    today = docs.agg(F.count_if(F.col("has_llm") & since("fetched_at", as_of, 1)).alias("n")).withColumn("key", F.lit(""))
    return reduce(DataFrame.unionByName, [row(counted(docs, "status"), "status", "status"), row(counted(docs.where(since("fetched_at", as_of, 7)), "uf"), "uf_7d", "uf"), row(today, "classified_today", "key"), row(today.withColumn("n", F.greatest(F.lit(0), quota - F.col("n"))), "quota_left", "key")])


def user_tag_counts(docs: DataFrame) -> DataFrame:
    return counted(docs.select(F.explode("user_tags").alias("tag")), "tag").orderBy(F.col("n").desc(), "tag")


STAGES = ("collected", "keywords", "prescore", "new", "classified", "stored", "notified")


def run_funnel(items: DataFrame) -> DataFrame:
    """Items with a flag for each of STAGES -> step, stage, n that passed it, in one aggregation."""
    counts = items.agg(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.count_if(F.col(s)).alias("n")) for i, s in enumerate(STAGES)]).alias("r"))
    return counts.select(F.inline("r")).orderBy("step")


def execution_metrics(events: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """run_events(collector, kind, duration_ms, items, tokens, ok) -> name, label, value."""
    by = events.groupBy("collector").agg(F.sum("duration_ms").alias("collector_duration_ms"), F.count_if(~F.col("ok")).alias("collector_errors"), F.sum("items").alias("collector_items"))
    names = ("collector_duration_ms", "collector_errors", "collector_items")
    rows = by.select(F.col("collector").alias("label"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])))
    used = events.agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, 1)), F.lit(0)).alias(k) for k in quotas])
    share = [F.struct(F.lit("quota_percent").alias("name"), F.lit(k).alias("label"), F.least(F.lit(100.0), 100.0 * F.col(k) / q).alias("value")) for k, q in quotas.items()]
    return rows.select("name", "label", "value").unionByName(used.select(F.inline(F.array(*share))))


def run_metrics(events: DataFrame, regions: list[str], call: str = "llm") -> DataFrame:
    """run_events(collector, uf, kind, duration_ms, items, tokens, ok) -> name, label, value of a whole run: the classifier's calls,
    failures and tokens, every stage's time, the regions with items (1) and without (0), and the share that has some. One
    aggregation by kind and one by region; regions are an owner's list."""
    asked, zero = F.col("kind") == call, F.lit(0)
    calls = events.agg(F.count_if(asked).alias("llm_calls"), F.count_if(asked & ~F.col("ok")).alias("llm_failures"), F.coalesce(F.sum(F.when(asked, F.col("tokens"))), zero).alias("llm_tokens"))
    row = lambda name, label, value: F.struct(F.lit(name).alias("name"), label.alias("label"), value.cast("double").alias("value"))
    out = calls.select(F.inline(F.array(*[row(n, F.lit("llm"), F.col(n)) for n in calls.columns])))
    stages = events.groupBy("kind").agg(F.sum("duration_ms").alias("d")).select(F.lit("stage_duration_ms").alias("name"), F.col("kind").alias("label"), F.col("d").cast("double").alias("value"))
    listed = events.sparkSession.createDataFrame([(r,) for r in regions], "uf string")
    some = listed.join(events.where("items > 0").select("uf").distinct().withColumn("has", F.lit(1.0)), "uf", "left").select("uf", F.coalesce("has", F.lit(0.0)).alias("has"))
    by_region = some.select(F.lit("uf_with_items").alias("name"), F.col("uf").alias("label"), F.col("has").alias("value"))
    share = some.agg(F.coalesce(100.0 * F.sum("has") / F.count(F.lit(1)), F.lit(0.0)).alias("value")).select(F.lit("uf_coverage_percent").alias("name"), F.lit("uf").alias("label"), "value")
    return out.unionByName(stages).unionByName(by_region).unionByName(share)


def digest_summary(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row: counts of the two highest tiers, regions that aren't federal, the most relevant documents, section sizes."""
    d = docs.where("has_llm")
    ranked = top(d.select("doc_id", "relevancia"), k, "relevancia", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("relevancia")).alias("r"), "doc_id"))), lambda x: x["doc_id"]).alias("top_docs"))
    sections = d.select(F.coalesce(F.try_element_at("topics", F.lit(1)), F.lit("outros")).alias("section")).groupBy("section").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.concat_ws("=", "section", "n"))).alias("sections"))
    head = d.agg(F.count_if(F.col("severity_tier") == "critico").alias("n_critico"), F.count_if(F.col("severity_tier") == "alta").alias("n_alta"), F.array_sort(F.collect_set(F.when(F.col("uf") != "_federal", F.col("uf")))).alias("ufs"))
    return head.crossJoin(ranked).crossJoin(sections)  # one row each


def slo(runs: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """runs(source_id, ok, duration_s, latency_s, classified) -> success, p95 duration (a run's own, within a rank of `accuracy`th of
    the runs: partial sketches, no buffer of all values), notified in 5 minutes, fully classified."""
    share = lambda c: F.avg(c.cast("double"))
    return runs.agg(share(F.col("ok")).alias("success"), F.percentile_approx("duration_s", 0.95, accuracy).alias("p95_s"), share(F.col("latency_s") <= 300).alias("notified_5min"), share(F.col("classified")).alias("fully_classified"))


def slo_by_source(runs: DataFrame) -> DataFrame:
    """Share of successful runs by source."""
    return runs.groupBy("source_id").agg(F.avg(F.col("ok").cast("double")).alias("success"), F.count(F.lit(1)).alias("n"))


def items_by_source(steps: DataFrame) -> DataFrame:
    """Steps of a batch (source_id and a flag for each stage) -> by source: collected, stored, discarded."""
    return steps.groupBy("source_id").agg(*[F.count_if(c).alias(c) for c in ("collected", "stored", "discarded")])
