"""The owner's configuration as tables kept by commands: what was saved last stands, unless it was removed since. Commands are rows with
a time and a sequence number, so a table can be had as of any moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.functions.text import duration_days
from lakewatch.operators.analytics import AS_OF, moment
from lakewatch.operators.filters import channels
from lakewatch.schema import TOPICS

MUTE_KEY = r"^(UF|tipo|tag)=(.+)$"


def current(commands: DataFrame, keys: tuple[str, ...], as_of=AS_OF) -> DataFrame:
    """commands(ts, seq, verb, keys..., values...) -> the rows that stand: each key's last command up to `as_of`, if it is `save`."""
    d = commands.where(F.col("ts") <= moment(as_of))
    values = [c for c in d.columns if c not in keys]
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("ts", "seq")).alias("x")).select(*keys, "x.*")
    return last.where("verb = 'save'").drop("verb", "seq")


def saved_settings(commands: DataFrame, as_of=AS_OF, defaults=TOPICS) -> DataFrame:
    """commands(ts, seq, verb, kind, key, value) of states, topics and watches -> kind, key, value. The default topics are there from
    the start and can't be removed."""
    held = current(commands.where(~((F.col("kind") == "topic") & F.lower("key").isin(*defaults) & (F.col("verb") == "delete"))), ("kind", "key"), as_of).select("kind", "key", "value")
    own = held.where("kind = 'topic'").select(F.lower("key").alias("k"))
    first = commands.sparkSession.createDataFrame([("topic", t, None) for t in defaults], "kind string, key string, value string")
    return held.unionByName(first.join(own, F.col("key") == F.col("k"), "left_anti"))


def mute_commands(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commands(ts, seq, verb, text) such as `UF=SP 7d`, `tag=x 2w` (save) or `UF=SP` (delete) -> (commands with key and until,
    rejects). A mute needs one of the keys and a duration."""
    key = F.regexp_extract("text", r"^(\S+)", 1)
    days = duration_days(F.regexp_extract("text", r"^\S+\s+(\S+)$", 1))
    c = commands.withColumn("key", key).withColumn("until", F.when(F.col("verb") == "save", F.timestamp_micros(F.unix_micros("ts") + days.cast("long") * 86_400_000_000)))
    good = F.col("key").rlike(MUTE_KEY) & ((F.col("verb") == "delete") | F.col("until").isNotNull())
    return c.where(good).drop("text"), c.where(~F.coalesce(good, F.lit(False))).select("seq", F.lit("validation_error").alias("reason"), F.col("text").alias("payload"))


def active_mutes(commands: DataFrame, as_of=AS_OF) -> DataFrame:
    """key and until of the mutes that stand and haven't ended, soonest first."""
    kept = current(mute_commands(commands)[0], ("key",), as_of).where(F.col("until") > moment(as_of))
    return kept.select("key", "until").orderBy("until", "key")


def notified(docs: DataFrame, sent: DataFrame) -> DataFrame:
    """`docs` with enviada, enviada_em and canais: sent(doc_id, ts) marks a document as sent, first of all at its earliest time, by
    its tier's channels."""
    first = sent.groupBy("doc_id").agg(F.min("ts").alias("enviada_em"))
    d = docs.join(first, "doc_id", "left").withColumn("enviada", F.col("enviada_em").isNotNull())
    return d.withColumn("canais", F.when(F.col("enviada"), F.coalesce(channels(F.col("severity_tier")), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def source_errors(sources: DataFrame, kinds: Column) -> DataFrame:
    """id and the names of the rules that a source breaks: lengths, the region's form, its kind, and that a source without
    keywords names organisations."""
    no = F.lit(False)
    rules = {
        "id": ~F.coalesce(F.length("id").between(1, 80), no), "nome": ~F.coalesce(F.length("nome").between(1, 200), no), "url": ~F.coalesce(F.length("url").between(1, 2048), no), "uf": ~F.coalesce(F.col("uf").rlike("^([A-Z]{2}|_federal)$"), no),
        "tipo": ~F.coalesce(F.array_contains(kinds, F.col("tipo")), no), "org_mentions": F.coalesce("keywords_bypass", no) & (F.size(F.coalesce("org_mentions", F.array())) == 0),
        "expected": F.coalesce("expected_min_items_per_week", F.lit(0)) < 0,
    }
    return sources.select("id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("errors"))
