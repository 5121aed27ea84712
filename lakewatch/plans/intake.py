"""The pipeline as one batch plan: select, collect, filter, classify, store, route."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.operators import filters as flt
from lakewatch.operators.analytics import AS_OF, STAGES, moment, run_funnel
from lakewatch.operators.clusters import cluster_key


@dataclass
class Batch:
    stored: DataFrame
    dispatch: DataFrame
    funnel: DataFrame
    steps: DataFrame  # source_id and a flag for each stage, a row an item


def classified(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Items with their classification (doc_id is source and hash) and whether a response has it; without one they wait as
    pending."""
    i = items.withColumn("doc_id", F.concat_ws(":", "source_id", F.substring("content_hash", 1, 16))).withColumn("cluster_key", cluster_key())
    r = responses.select("content_hash", F.col("tipo").alias("r_tipo"), "relevancia", "topics", "tags", F.lit(True).alias("answered"))
    d = i.join(r, "content_hash", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    tier = flt.tier_override(flt.tier(F.col("relevancia")), F.coalesce("keywords_bypass", F.lit(False)))
    return d.withColumn("tipo", F.col("r_tipo")).drop("r_tipo").withColumn("severity_tier", tier).withColumn("status", F.when(F.col("relevancia").isNull(), "pending").otherwise("classified"))


def classify_and_store(items: DataFrame, responses: DataFrame, keep_discarded: bool = False) -> DataFrame:
    """New items with their classification; discarded ones aren't stored."""
    d = classified(items, responses).drop("answered")
    return d if keep_discarded else d.where("severity_tier IS NULL OR severity_tier <> 'descartado'")


#: A provider of classifications: new items (titulo, texto, content_hash, ...) -> responses(content_hash, tipo, relevancia, topics,
#: tags). Items that it gives no row for wait as pending.
Classifier = Callable[[DataFrame], DataFrame]


def rule_provider(by_topic: dict[str, tuple] = flt.KEYWORDS) -> Classifier:
    """The provider that classifies by the rules of keywords, one response for each content."""

    def classify(items: DataFrame) -> DataFrame:
        d = flt.rule_classifier(items.withColumn("doc_id", F.col("content_hash")), by_topic)
        return d.select(F.col("doc_id").alias("content_hash"), "tipo", "relevancia", "topics", "tags").dropDuplicates(["content_hash"])

    return classify


def run_batch(items: DataFrame, sources: DataFrame, stored: DataFrame, responses: DataFrame | Classifier, keywords, *, as_of=AS_OF, cutoff: float = flt.CUTOFF, mutes: DataFrame | None = None) -> Batch:
    """items(source_id, titulo, texto, url, data_publicacao, fetched_at, content_hash) through all stages. Each item is one row with
    a flag for each stage that it passes, so the funnel is one aggregation and no stage is computed twice for it. `responses` is a
    table, or a provider that is asked for the new items only."""
    known = stored.select("content_hash").distinct().withColumn("known", F.lit(True))
    d = flt.scored(flt.with_found(items, sources, keywords), as_of).join(known, "content_hash", "left")
    d = d.withColumn("collected", F.lit(True)).withColumn("keywords", F.size("found") > 0).withColumn("prescore", F.col("keywords") & flt.passes(F.col("score"), cutoff))
    d = d.withColumn("new", F.col("prescore") & F.col("known").isNull())
    answers = responses(d.where("new").select(*items.columns)) if callable(responses) else responses
    d = classified(d, answers).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("classified", F.col("new") & F.col("answered"))
    d = d.withColumn("stored", F.col("new") & (F.coalesce("severity_tier", F.lit("")) != "descartado")).withColumn("discarded", F.col("new") & (F.coalesce("severity_tier", F.lit("")) == "descartado"))
    d = d.withColumn("notified", F.col("stored") & F.col("severity_tier").isNotNull())
    if mutes is not None:
        d = d.join(flt.muted(d.where("notified"), mutes, as_of).withColumn("muted", F.lit(True)), "doc_id", "left").withColumn("notified", F.col("notified") & F.col("muted").isNull()).drop("muted")
    flags = ("known", "answered", *STAGES, "discarded")
    return Batch(d.where("stored").drop(*flags), flt.with_route(d.where("notified")).select("doc_id", "severity_tier", "channels", "period"), run_funnel(d), d.select("source_id", *STAGES, "discarded"))


def reprocess(docs: DataFrame, results: DataFrame) -> DataFrame:
    """New classifications: discarded documents are archived, pending and archived ones that aren't discarded classified."""
    r = results.select("doc_id", F.col("tipo").alias("n_tipo"), F.col("relevancia").alias("n_rel"))
    j = docs.join(r, "doc_id", "left")
    has, tier = F.col("n_rel").isNotNull(), flt.tier(F.col("n_rel"))
    status = F.when(has & (tier == "descartado"), "archived").when(has & F.col("status").isin("pending", "archived"), "classified").otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("tipo", F.when(has, F.col("n_tipo")).otherwise(F.col("tipo"))).withColumn("severity_tier", F.when(has, tier).otherwise(F.col("severity_tier"))).withColumn("relevancia", F.when(has, F.col("n_rel")).otherwise(F.col("relevancia"))).drop("n_tipo", "n_rel")


def dispatch_split(docs: DataFrame) -> DataFrame:
    """Classified documents with their queue: immediate for critical ones, digest for the others."""
    return docs.where("severity_tier IS NOT NULL").select("doc_id", F.when(F.col("severity_tier") == "critico", "immediate").otherwise("digest").alias("queue"))


def digest_rows(docs: DataFrame, as_of=AS_OF, days: int = 7, most: int = 1000) -> DataFrame:
    """The digest's rows: classified documents fetched in the window, newest first, with what is shown of each."""
    d = docs.where(F.col("severity_tier").isNotNull() & (F.col("fetched_at") >= moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")))
    show = d.select("doc_id", F.coalesce("titulo", F.lit("(sem título)")).alias("titulo"), "uf", "url", F.coalesce("tipo", F.lit("outro")).alias("tipo"), F.coalesce("relevancia", F.lit(0)).alias("relevancia"), "severity_tier", F.coalesce("resumo", F.lit("")).alias("resumo"), F.date_format(F.coalesce("data_publicacao", "fetched_at"), "dd/MM/yyyy").alias("data"), F.array_join(F.coalesce("topics", F.array()), ", ").alias("topics"), "fetched_at")
    return show.orderBy(F.col("fetched_at").desc(), "doc_id").limit(most)


def on_demand(docs: DataFrame, as_of=AS_OF, days: int = 7, k: int = 50) -> DataFrame:
    """Classified documents of the window by relevance, and how many are pending."""
    d = docs.where(F.col("fetched_at") >= moment(as_of) - F.expr(f"INTERVAL '{days}' DAY"))
    pending = d.agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return d.where("severity_tier IS NOT NULL").select("doc_id", "relevancia", "fetched_at").orderBy(F.col("relevancia").desc(), F.col("fetched_at").desc(), "doc_id").limit(k).crossJoin(pending)  # one row


def grouped_digest(docs: DataFrame, by: str = "uf", k: int = 10) -> DataFrame:
    """Groups with their count and their `k` most relevant documents."""
    from lakewatch.operators.health import top_per_group

    d = docs.where("severity_tier IS NOT NULL")
    n = d.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    best = top_per_group(d, by, k, F.col("relevancia").desc()).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    return n.join(best, by).orderBy(by)
