"""An inverted index of search terms: `postings` (term, doc_id, generation) in folders by the term's bucket, sorted by term, so that
a look-up reads one bucket's row groups; `texts` (doc_id, text, fetched_at, status, mark, generation), a row for each time that a
document was indexed. Both are only ever added to: a reindex writes what has changed under a new generation, and a posting counts
if its generation is its document's latest. `compact` writes the latest rows anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewatch.functions.text import search_term
from lakewatch.operators.search import indexed

BUCKETS = 64
#: Documents whose postings of a bucket are one task's, about.
DOCS = 1 << 16
#: The version of the terms' form: documents that were indexed under a lower one are stale.
VERSION = 2
_TEXTS = "doc_id BIGINT, text STRING, fetched_at TIMESTAMP, status STRING, mark STRING, version INT, generation INT"


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _mark() -> Column:
    """What an index row depends on: any change of it makes the row stale."""
    fields = ("titulo", "source_id", "uf", "topics", "user_tags", "tipo", "severity_tier", "resumo", "tags", "url", "texto", "data_publicacao", "fetched_at", "status")
    return F.sha2(F.to_json(F.struct(*fields, F.array_sort(F.map_entries("metadados")).alias("meta"))), 256)


def _add(docs: DataFrame, path: str, version: int, generation: int) -> None:
    columns = [c.split()[0] for c in _TEXTS.split(", ")]
    built = indexed(docs.withColumn("mark", _mark()), keep=("fetched_at", "status", "mark")).withColumn("version", F.lit(version)).withColumn("generation", F.lit(generation))
    built.select(*columns, "terms").write.mode("append").parquet(f"{path}/texts")
    # the terms are read from what was written: no text is made or cut into terms twice
    own = docs.sparkSession.read.schema(f"{_TEXTS}, terms ARRAY<STRING>").parquet(f"{path}/texts").where(F.col("generation") == generation)
    salt = max(4, own.count() // DOCS)
    terms = own.select("doc_id", "generation", F.explode("terms").alias("term")).withColumn("bucket", _bucket(F.col("term")))
    # a bucket's rows meet in a few tasks, a hot term's in as many as its documents' hashes, which grow with the documents
    dealt = terms.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(salt))).sortWithinPartitions("bucket", "term", "doc_id")
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every document's text."""
    t = spark.read.schema(_TEXTS).parquet(f"{path}/texts")
    newest = t.groupBy("doc_id").agg(F.max("generation").alias("generation"))
    return t.join(newest, ["doc_id", "generation"])


def build(docs: DataFrame, path: str, version: int = VERSION) -> None:
    """Indexes all of `docs` under a new path."""
    _add(docs, path, version, 1)


def update(docs: DataFrame, path: str, version: int = VERSION) -> int:
    """Indexes the documents that the index doesn't have, has with other contents or under a lower version; gives how many. Nothing
    of the others is read but their marks, and nothing is written."""
    t = docs.sparkSession.read.schema(_TEXTS).parquet(f"{path}/texts").select("doc_id", "mark", "version", "generation")
    held = t.groupBy("doc_id").agg(F.max_by(F.struct("mark", "version"), "generation").alias("h"), F.max("generation").alias("generation"))
    good = docs.select("doc_id", _mark().alias("mark")).join(held, "doc_id").where((F.col("h.mark") == F.col("mark")) & (F.col("h.version") >= version))
    stale = docs.join(good.select("doc_id"), "doc_id", "left_anti").checkpoint()
    n = stale.count()
    if n:
        _add(stale, path, version, 1 + (t.agg(F.max("generation")).first()[0] or 0))
    return n


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The index with the latest rows only, under a new path."""
    now = latest(spark, path)
    now.select(*[c.split()[0] for c in _TEXTS.split(", ")]).write.parquet(f"{to}/texts")
    p = spark.read.parquet(f"{path}/postings").join(now.select("doc_id", "generation"), ["doc_id", "generation"])
    p.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4))).sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{to}/postings")


def lookup(spark: SparkSession, path: str, term: str) -> DataFrame:
    """doc_id and generation of a term's postings: one bucket is read."""
    word = search_term(term)
    bucket = spark.range(1).select(_bucket(F.lit(word))).first()[0]
    schema = "term STRING, doc_id BIGINT, generation INT, bucket INT"
    return spark.read.schema(schema).parquet(f"{path}/postings").where((F.col("bucket") == bucket) & (F.col("term") == word)).select("doc_id", "generation")


def search(spark: SparkSession, path: str, terms: list[str], limit: int = 50) -> DataFrame:
    """Documents that have the longest term without a space among their terms and all terms in their text; not archived, newest
    first. Without such a term all texts are searched."""
    whole = [t for t in terms if " " not in t.strip()]
    texts = latest(spark, path)
    if whole:
        hits = lookup(spark, path, max(whole, key=len))
        t = spark.read.schema(_TEXTS).parquet(f"{path}/texts")
        newest = t.select("doc_id", "generation").join(hits.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("generation").alias("generation"))
        texts = t.join(hits.join(newest, ["doc_id", "generation"], "left_semi"), ["doc_id", "generation"], "left_semi")
    for x in terms:
        texts = texts.where(F.contains("text", F.lit(search_term(x))))
    return texts.where("status <> 'archived'").orderBy(F.col("fetched_at").desc(), "doc_id").limit(limit).select("doc_id", "fetched_at")
