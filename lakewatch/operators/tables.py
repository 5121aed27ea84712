"""Table jobs: upserts, tags, retention, export, restore, quarantine. Results are new tables; the caller swaps them in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.operators.analytics import AS_OF, moment
from lakewatch.operators.health import top_per_group
from lakewatch.operators.search import indexed

ORIGINAL = ("source_id", "titulo", "url", "texto", "data_publicacao", "content_hash")
CSV_FIELDS = ("doc_id", "source_id", "uf", "titulo", "url", "data_publicacao", "fetched_at", "tipo", "relevancia", "severity_tier", "resumo", "tags", "topics")
JSON_FIELDS = (*CSV_FIELDS, "status", "metadados", "llm_model", "prompt_version")


def upsert(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, conflicts): new documents are added; the same original keeps the stored row (and its classification); a
    different original under a stored id is a conflict."""
    same = F.lit(True)
    for c in ORIGINAL:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}"))
    j = batch.alias("n").join(stored.alias("s"), "doc_id", "left").withColumn("__is_new", F.col("s.content_hash").isNull()).withColumn("__same", same)
    fresh = j.where("__is_new").select("doc_id", *[F.col(f"n.{c}") for c in batch.columns if c != "doc_id"])
    conflicts = j.where("NOT __is_new AND NOT __same").select("doc_id", F.lit("conflict").alias("reason"))
    return stored.unionByName(fresh.select(*stored.columns)), conflicts


def replace_classification(stored: DataFrame, results: DataFrame) -> DataFrame:
    """results(doc_id, and any of the classification's columns) take the place of the stored ones; originals stay."""
    new = [c for c in results.columns if c != "doc_id" and c not in ORIGINAL]
    r = results.select("doc_id", F.struct(*new).alias("__new"))
    j = stored.join(r, "doc_id", "left")
    return j.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in stored.columns])


def set_status(stored: DataFrame, changes: DataFrame) -> DataFrame:
    c = changes.select("doc_id", F.col("status").alias("__status"))
    return stored.join(c, "doc_id", "left").withColumn("status", F.coalesce("__status", "status")).select(*stored.columns)


def add_tag(docs: DataFrame, tag: str) -> DataFrame:
    return docs.withColumn("user_tags", F.array_union(F.coalesce("user_tags", F.array().cast("array<string>")), F.array(F.lit(tag))))


def remove_tag(docs: DataFrame, tag: str) -> DataFrame:
    return docs.withColumn("user_tags", F.array_remove("user_tags", tag))


def rename_tag(docs: DataFrame, old: str, new: str) -> DataFrame:
    return docs.withColumn("user_tags", F.array_distinct(F.transform("user_tags", lambda t: F.when(t == old, new).otherwise(t))))


def reindex(docs: DataFrame, index: DataFrame, version: int = 2) -> DataFrame:
    """The index with rows rebuilt that are missing, empty or of an older version."""
    current = index.where(F.col("index_version") >= version).select("doc_id", F.explode(F.array("text")).alias("text"), "terms", "index_version")
    fresh = current.where("text <> ''")  # it stays above the generator, so where a text is built it is not built for the filter once more
    stale = docs.join(fresh.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti")  # the smaller side has ids alone, and no text is sorted
    return fresh.select("doc_id", "text", "terms", "index_version").unionByName(indexed(stale).withColumn("index_version", F.lit(version)))


#: Retention: rule, condition of what goes, days.
RETENTION = (("discarded", "severity_tier = 'descartado'", 90), ("archived", "status = 'archived'", 365))


def retention(docs: DataFrame, as_of=AS_OF, rules=RETENTION) -> tuple[DataFrame, DataFrame]:
    """(kept, counts of what goes by rule): the first rule that holds counts."""
    rule = F.lit(None).cast("string")
    for name, condition, days in reversed(rules):
        rule = F.when(F.expr(condition) & (F.col("fetched_at") < moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")), name).otherwise(rule)
    d = docs.withColumn("__rule", rule)
    return d.where("__rule IS NULL").drop("__rule"), d.where("__rule IS NOT NULL").groupBy(F.col("__rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def retained(collections: dict[str, DataFrame], days: dict[str, int], as_of=AS_OF, at: str = "timestamp") -> tuple[dict[str, DataFrame], DataFrame]:
    """Collections by name without the rows older than their days, and how many go of each (audit 365 and runs 180 days, say)."""
    old = lambda name: F.col(at) < moment(as_of) - F.expr(f"INTERVAL '{days[name]}' DAY")
    counts = [df.where(old(name)).agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n")) for name, df in collections.items()]
    return {name: df.where(~F.coalesce(old(name), F.lit(False))) for name, df in collections.items()}, reduce(DataFrame.unionByName, counts)


def export_owner(tables: dict[str, DataFrame], owner: str, path: str) -> DataFrame:
    """Each table's rows of the owner as gzipped JSON lines under `path`, and a manifest of their counts."""
    rows = None
    for name, df in tables.items():
        own = df.where(F.col("owner_id") == owner)
        own.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
        n = own.agg(F.lit(1).alias("version"), F.lit(owner).alias("owner_id"), F.lit(name).alias("collection"), F.count(F.lit(1)).alias("n"))
        rows = n if rows is None else rows.unionByName(n)
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return rows


def restore(rows: DataFrame, owner: str, collections: tuple[str, ...], version: int = 1) -> tuple[DataFrame, DataFrame]:
    """rows(version, owner_id, collection, doc_id, ...) -> (accepted, counts of rejected by reason)."""
    reason = F.when(~F.col("version").eqNullSafe(F.lit(version)), "version").when(~F.col("owner_id").eqNullSafe(F.lit(owner)), "owner").when(~F.coalesce(F.col("collection").isin(*collections), F.lit(False)), "collection").when(~F.coalesce(F.col("doc_id").cast("string").rlike(r"^[A-Za-z0-9_:.\-]{1,200}$"), F.lit(False)), "doc_id")
    d = rows.withColumn("reason", reason)
    return d.where("reason IS NULL").drop("reason"), d.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reconcile_owner(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumn("owner_id", F.when(F.col("owner_id") == old, new).otherwise(F.col("owner_id")))


def csv_rows(docs: DataFrame) -> DataFrame:
    """The fixed columns of the CSV export, arrays joined."""
    kinds = dict(docs.dtypes)
    return docs.select(*[F.array_join(c, " | ").alias(c) if kinds[c].startswith("array") else F.col(c) for c in CSV_FIELDS])


def json_rows(docs: DataFrame) -> DataFrame:
    """The JSON export's fields: empty collections instead of nulls."""
    kinds = dict(docs.dtypes)
    empty = lambda k: F.array().cast(k) if k.startswith("array") else F.create_map().cast(k)
    return docs.select(*[F.coalesce(F.col(c), empty(kinds[c])).alias(c) if kinds[c][:3] in ("arr", "map") else F.col(c) for c in JSON_FIELDS])


def feeds(docs: DataFrame, k: int = 50) -> DataFrame:
    """feed, entry fields: the newest `k` documents of each region, of each act type, and of relevance 7 and more."""
    fields = ("doc_id", "titulo", "url", "resumo", "fetched_at", "rank")
    by_uf = top_per_group(docs, "uf", k).select(F.concat(F.lit("uf/"), "uf").alias("feed"), *fields)
    by_tipo = top_per_group(docs.where("tipo IS NOT NULL"), "tipo", k).select(F.concat(F.lit("tipo/"), "tipo").alias("feed"), *fields)
    high = docs.where("relevancia >= 7").orderBy(F.col("fetched_at").desc(), "doc_id").limit(k).withColumn("g", F.lit(0))
    return by_uf.unionByName(by_tipo).unionByName(top_per_group(high, "g", k).select(F.lit("relevantes").alias("feed"), *fields))


def exported_since(docs: DataFrame, day: str) -> DataFrame:
    return docs.where(F.to_date("fetched_at") >= F.lit(day).cast("date"))


def enqueue(dlq: DataFrame, failed: DataFrame) -> DataFrame:
    return dlq.unionByName(failed.select(*dlq.columns))


def dlq_by_reason(dlq: DataFrame, reason: str) -> DataFrame:
    return dlq.where(F.col("reason") == reason).orderBy("failed_at", "entry_id")


def dlq_remove(dlq: DataFrame, handled: DataFrame) -> DataFrame:
    return dlq.join(handled.select("entry_id"), "entry_id", "left_anti").select(*dlq.columns)


def clean_keywords(rows: DataFrame) -> DataFrame:
    """rows(pos, kw): spaces collapsed, empty ones and those over 80 characters dropped, the first of each spelling kept."""
    c = rows.withColumn("kw", F.trim(F.regexp_replace("kw", r"(?U)\s+", " "))).where(F.length("kw").between(1, 80))
    return c.groupBy(F.lower("kw").alias("__l")).agg(F.min(F.struct("pos", "kw")).alias("x")).select("x.pos", "x.kw")


def added_keywords(extras: DataFrame, defaults: DataFrame, new: DataFrame, most: int | None = 200) -> DataFrame:
    """Extras (kw) with the new ones that are no default or extra in any case, 3 to 100 characters long; `most` in all, an
    owner's limit (None: no limit)."""
    known = extras.select(F.lower("kw").alias("l")).unionByName(defaults.select(F.lower("kw").alias("l"))).distinct()
    ok = new.where(F.length("kw").between(3, 100)).withColumn("l", F.lower("kw")).join(known, "l", "left_anti").groupBy("l").agg(F.min("kw").alias("kw"))
    out = extras.select("kw", F.lit(0).alias("o")).unionByName(ok.select("kw", F.lit(1).alias("o")))
    return (out if most is None else out.orderBy("o", "kw").limit(most)).select("kw")
