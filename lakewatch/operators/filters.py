"""Predicates and projections of the intake: keywords, prescore, duplicates, tiers, routing, responses, validation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.functions import detect
from lakewatch.functions.protect import ipv4
from lakewatch.functions.text import collapse, nfkc
from lakewatch.operators.analytics import AS_OF, moment
from lakewatch.schema import ACT_TYPES, TOPICS

#: Defaults by topic; callers pass their own dictionaries.
KEYWORDS = {
    "itcd": ("ITCMD", "ITCD", "causa mortis", "inventário", "espólio", "partilha", "doação", "holding familiar", "planejamento sucessório", "fato gerador", "base de cálculo", "alíquota"),
    "sucessoes": ("herança", "testamento", "sucessão", "herdeiro", "legítima", "codicilo"),
    "regime_bens": ("regime de bens", "comunhão parcial", "comunhão universal", "separação de bens", "pacto antenupcial"),
}
#: Weights of the prescore and its cut-off.
DENSITY, AUTHORITY, FRESHNESS, ACT_BONUS, CUTOFF = 0.35, 0.35, 0.2, 0.1, 0.3


def _norm(c: Column) -> Column:
    return collapse(F.lower(nfkc(c)))


def strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _with_form(text: Column, fn) -> Column:
    """`fn` of the text's normal form, which is made once, however often it is used."""
    return F.element_at(F.transform(F.array(_norm(text)), fn), 1)


def keywords_in(form: Column, keywords: Column | tuple | list) -> Column:
    """The keywords that are substrings of a normal form, as they are spelled, in their order (a column of keywords is taken to
    be in compatibility form)."""
    if isinstance(keywords, Column):
        return F.filter(keywords, lambda k: F.contains(form, collapse(F.lower(k))))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(" ".join(unicodedata.normalize("NFKC", k).lower().split())).alias("form")) for k in keywords]) if keywords else F.expr("CAST(array() AS array<struct<k: string, form: string>>)")
    return F.transform(F.filter(pairs, lambda p: F.contains(form, p["form"])), lambda p: p["k"])


def found_keywords(text: Column, keywords: Column | tuple | list) -> Column:
    """The keywords that are substrings of the text, as they are spelled, in their order; both sides in compatibility form, lower
    case and single spaces."""
    return _with_form(text, lambda form: keywords_in(form, keywords))


def keyword_match(docs: DataFrame, keywords, text: str = "texto") -> DataFrame:
    return docs.withColumn("keywords", found_keywords(F.col(text), keywords)).where(F.size("keywords") > 0)


def expand_keywords(defaults, extras) -> Column:
    return F.array_union(strings(defaults), strings(extras))


def with_found(items: DataFrame, sources: DataFrame, defaults) -> DataFrame:
    """Items (source_id, titulo, texto) with what their source's rule finds: an organisation for bypass sources, for others a
    keyword (their own list, if they have one) or an organisation."""
    s = sources.select(F.col("id").alias("source_id"), "keywords_bypass", "org_mentions", "keywords_required", "trusted", F.col("tipo").alias("tipo_fonte"))
    j = items.join(s, "source_id")
    text = F.concat_ws(" ", "titulo", "texto")
    own = F.when(F.size("keywords_required") > 0, F.col("keywords_required")).otherwise(strings(defaults))
    both = _with_form(text, lambda form: F.struct(keywords_in(form, F.col("org_mentions")).alias("orgs"), keywords_in(form, own).alias("kws")))
    j = j.withColumn("both", F.explode(F.array(both)))  # one row: a filter on it isn't pushed below, where the form would be made again
    j = j.withColumn("orgs", F.col("both.orgs")).withColumn("kws", F.col("both.kws"))
    j = j.withColumn("found", F.when(F.col("keywords_bypass"), F.col("orgs")).otherwise(F.array_union("kws", "orgs")))
    return j.drop("both", "orgs", "kws")


def keyword_or_org(items: DataFrame, sources: DataFrame, defaults) -> DataFrame:
    """Items that their source's rule lets pass, with what was found."""
    return with_found(items, sources, defaults).where(F.size("found") > 0)


def topics_of(text: Column, by_topic: dict[str, tuple]) -> Column:
    """Topics with a keyword in the text, most keywords first, ties in the topics' order."""

    def ordered(form: Column) -> Column:
        rows = [F.struct((-F.size(keywords_in(form, tuple(dict.fromkeys(words))))).alias("n"), F.lit(i).alias("ord"), F.lit(t).alias("topic")) for i, (t, words) in enumerate(by_topic.items())]
        return F.transform(F.array_sort(F.filter(F.array(*rows), lambda r: r["n"] < 0)), lambda r: r["topic"])

    return _with_form(text, ordered)


def configured_topics(docs: DataFrame, config: DataFrame, text: str = "texto") -> DataFrame:
    """Documents with `topics` by a table of keywords (topic, kw), read when the job runs: most keywords first, then by name. The
    table is an owner's configuration; it becomes one row that goes to every task."""
    pairs = config.select("topic", "kw").distinct().agg(F.array_sort(F.collect_list(F.struct("topic", collapse(F.lower(nfkc(F.col("kw")))).alias("form")))).alias("__pairs"))
    d = docs.withColumn("__form", _norm(F.col(text))).crossJoin(F.broadcast(pairs))  # one row
    hits = F.transform(F.filter("__pairs", lambda p: F.contains(F.col("__form"), p["form"])), lambda p: p["topic"])
    counted = F.transform(F.array_distinct(hits), lambda t: F.struct((-F.size(F.filter(hits, lambda h: h == t))).alias("n"), t.alias("topic")))
    return d.withColumn("topics", F.transform(F.array_sort(counted), lambda r: r["topic"])).select(*[c for c in docs.columns if c != "topics"], "topics")


def automaton_match(docs: DataFrame, words: list[str], text: str = "texto") -> DataFrame:
    """doc_id and the words found, sorted, lower-cased: one automaton for each task, for dictionaries of thousands."""
    words = sorted({w.lower() for w in words})

    def run(frames):
        import ahocorasick

        a = ahocorasick.Automaton()
        for w in words:
            a.add_word(w, w)
        if words:
            a.make_automaton()
        for f in frames:
            yield pd.DataFrame({"doc_id": f.doc_id, "found": [sorted({w for _, w in a.iter((t or "").lower())}) if words else [] for t in f.text]})

    return docs.select("doc_id", F.col(text).alias("text")).mapInPandas(run, "doc_id long, found array<string>")


def prescore(found: Column, text: Column, title: Column, published: Column, trusted: Column, tipo: Column, as_of=AS_OF) -> Column:
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))
    density = F.least(F.size(found) * 50.0 / words, F.lit(1.0))
    authority = F.when(trusted, 1.0).when(tipo.isin("sefaz", "assembleia", "doe"), 0.7).when(tipo == "jurisprudencia", 0.6).otherwise(0.4)
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(moment(as_of)) - F.unix_micros(published)) / 86_400_000_000))
    fresh = F.when(published.isNull(), 0.6).otherwise(F.greatest(F.lit(0.3), 1 - days / 30))
    return DENSITY * density + AUTHORITY * authority + FRESHNESS * fresh + ACT_BONUS * detect.act(title).isNotNull().cast("double")


def scored(items: DataFrame, as_of=AS_OF) -> DataFrame:
    return items.withColumn("score", prescore(F.col("found"), F.concat_ws(" ", "titulo", "texto"), F.col("titulo"), F.col("data_publicacao"), F.col("trusted"), F.col("tipo_fonte"), as_of))


def passes(score: Column, cutoff: float = CUTOFF) -> Column:
    return score >= cutoff


def unseen(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items whose content isn't stored yet; repeats within the batch stay."""
    return items.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def tier(relevance: Column) -> Column:
    return F.when(relevance < 5, "descartado").when(relevance >= 9, "critico").when(relevance >= 8, "alta").when(relevance >= 7, "normal").when(relevance.isNotNull(), "baixa")


def tier_override(t: Column, bypass: Column) -> Column:
    return F.when(bypass & (t == "normal"), "baixa").otherwise(t)


def channels(t: Column) -> Column:
    return F.when(t == "critico", strings(("telegram",))).when(t.isin("alta", "normal"), strings(("email", "telegram"))).when(t == "baixa", strings(("email",))).otherwise(strings(()))


def period(t: Column) -> Column:
    return F.when(t == "critico", "immediate").when(t.isin("alta", "normal"), "daily").when(t == "baixa", "weekly").otherwise("none")


def routed(docs: DataFrame, mutes: DataFrame | None = None, as_of=AS_OF) -> DataFrame:
    """Channels and period of classified documents; those under a mute (key `UF=x`, `tipo=x` or `tag=x`, until) are left out."""
    d = with_route(docs.where(F.col("severity_tier").isNotNull()))
    return d if mutes is None else d.join(muted(d, mutes, as_of), "doc_id", "left_anti")


def with_route(docs: DataFrame) -> DataFrame:
    return docs.withColumn("channels", channels(F.col("severity_tier"))).withColumn("period", period(F.col("severity_tier")))


def muted(d: DataFrame, mutes: DataFrame, as_of=AS_OF) -> DataFrame:
    """doc_id of the documents (uf, tipo, tags) under a live mute, once each."""
    keys = F.concat(F.array(F.concat(F.lit("UF="), "uf"), F.concat(F.lit("tipo="), "tipo")), F.transform(F.coalesce("tags", F.array()), lambda t: F.concat(F.lit("tag="), t)))
    live = mutes.where(F.col("until") > moment(as_of)).select("key").distinct()
    return d.select("doc_id", F.explode(keys).alias("key")).join(live, "key", "left_semi").select("doc_id").distinct()


RESPONSE = "ARRAY<STRUCT<related: BOOLEAN, tipo: STRING, relevancia: INT, resumo: STRING, resumo_completo: STRING, tags: ARRAY<STRING>, topics: ARRAY<STRING>>>"


def validated_responses(responses: DataFrame, batches: DataFrame, topics=TOPICS, tipos=ACT_TYPES) -> tuple[DataFrame, DataFrame]:
    """responses(batch_id, raw) and batches(batch_id, pos, doc_id) -> (results by doc_id, rejected with reason).

    Code fences go; a list or a wrapper key (items, results, classifications, list) holds the results, as many as the batch
    has; related ones need a summary of 40 characters; unrelated ones and those without an allowed topic get no topics and
    a relevance of 4 at most."""
    body = F.trim(F.regexp_replace("raw", r"(?is)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    wrapped = [F.get_json_object(body, f"$.{k}") for k in ("items", "results", "classifications", "list")]
    listed = F.coalesce(F.when(body.startswith("["), body), *wrapped)
    sizes = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("wanted"))
    r = responses.withColumn("parsed", F.from_json(listed, RESPONSE, {"mode": "PERMISSIVE"})).join(sizes, "batch_id", "left")
    reason = F.when(F.col("parsed").isNull(), "parse_error").when(F.col("wanted").isNull() | (F.size("parsed") != F.col("wanted")), "count_mismatch")
    r = r.withColumn("reason", reason)
    rows = r.where("reason IS NULL").select("batch_id", F.posexplode("parsed").alias("pos", "x")).join(batches, ["batch_id", "pos"])
    allowed = F.array_intersect(F.coalesce("x.topics", F.array()), strings(topics))
    bad = F.when(~F.col("x.tipo").isin(*tipos) | F.col("x.tipo").isNull(), "tipo").when(~F.col("x.relevancia").between(0, 10) | F.col("x.relevancia").isNull(), "relevancia").when(F.coalesce("x.related", F.lit(False)) & (F.length(F.coalesce("x.resumo_completo", F.lit(""))) < 40), "resumo_completo")
    rows = rows.withColumn("reason", bad).withColumn("on_topic", F.coalesce("x.related", F.lit(False)) & (F.size(allowed) > 0))
    relevance = F.when(F.col("on_topic"), F.col("x.relevancia")).otherwise(F.least(F.col("x.relevancia"), F.lit(4)))
    good = rows.where("reason IS NULL").select("doc_id", "x.tipo", relevance.alias("relevancia"), tier(relevance).alias("severity_tier"), "x.resumo", "x.resumo_completo", "x.tags", F.when(F.col("on_topic"), allowed).otherwise(strings(())).alias("topics"))
    rejected = r.where("reason IS NOT NULL").select("batch_id", F.lit(None).cast("long").alias("doc_id"), "reason").unionByName(rows.where("reason IS NOT NULL").select("batch_id", F.col("doc_id").cast("long").alias("doc_id"), "reason"))
    return good, rejected


def rule_classifier(docs: DataFrame, by_topic: dict[str, tuple]) -> DataFrame:
    """A deterministic classification: topics by keywords, relevance min(10, 4 + 2 n), 0 and unrelated without a topic."""
    d = docs.withColumn("topics", topics_of(F.concat_ws(" ", "titulo", "texto"), by_topic))
    relevance = F.when(F.size("topics") == 0, 0).otherwise(F.least(F.lit(10), 4 + 2 * F.size("topics")))
    return d.select("doc_id", F.lit("noticia").alias("tipo"), relevance.alias("relevancia"), tier(relevance).alias("severity_tier"), F.col("topics").alias("tags"), "topics")


def document_predicates(docs: DataFrame, cluster: str | None = None, tipo: str = "lei") -> DataFrame:
    has = lambda k: F.coalesce(F.col("metadados")[k], F.lit("")) != ""
    return docs.select("doc_id", F.coalesce(F.col("relevancia") >= 8, F.lit(False)).alias("high_relevance"), has("aliquotas").alias("has_aliquotas"), has("revogacoes_citadas").alias("has_revogacoes"), F.coalesce(F.col("metadados")["modulacao_efeitos"] == "true", F.lit(False)).alias("has_modulacao"), F.coalesce(F.col("tipo") == tipo, F.lit(False)).alias("is_tipo"))


def outside_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (number, ...) whose number lies in no range (lo, hi). Ranges are listed under each block of 1,024 numbers that they
    touch, so the range join is an equality join with a residual."""
    r = ranges.select("lo", "hi", F.explode(F.sequence(F.shiftright("lo", 10), F.shiftright("hi", 10))).alias("block"))
    n = rows.withColumn("block", F.shiftright(F.col("number").cast("long"), 10))
    return n.join(r, (n.block == r.block) & n.number.between(r.lo, r.hi), "left_anti").select(*rows.columns)


def scanner_fields(triggers: DataFrame) -> DataFrame:
    """Agent, address and token (16 characters) from either spelling of their keys."""
    of = lambda *keys: F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in keys])
    return triggers.select("event_id", "ts", of("useragent", "user_agent", "ua").alias("agent"), of("src_ip", "ip", "client_ip").alias("ip"), F.substring(of("token", "id"), 1, 16).alias("token"))


def without_scanners(events: DataFrame, agents: str, networks: DataFrame) -> DataFrame:
    """Events whose agent doesn't match and whose address lies in no network (lo, hi as longs).

    Networks are joined on their first 16 bits, so the range join is an equality join with a residual; a network wider than
    that is listed once for each of the blocks it spans, 65,536 at most."""
    n = networks.select("lo", "hi", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("block"))
    e = events.where(~F.coalesce(F.col("agent").rlike(agents), F.lit(False))).withColumn("ip_long", ipv4(F.col("ip"))).withColumn("block", F.shiftright("ip_long", 16))
    return e.join(n, (e.block == n.block) & e.ip_long.between(n.lo, n.hi), "left_anti").drop("ip_long", "block")


def model_errors(docs: DataFrame) -> DataFrame:
    """doc_id and the names of the fields that break the model's rules."""
    rules = {
        "titulo": F.col("titulo").isNull() | ~F.length("titulo").between(1, 500), "url": F.col("url").isNull() | (F.length("url") > 2048), "content_hash": ~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "uf": ~F.coalesce(F.col("uf").rlike("^([A-Z]{2}|_federal)$"), F.lit(False)), "relevancia": F.col("relevancia").isNotNull() & ~F.col("relevancia").between(0, 10), "tags": F.size(F.coalesce("tags", F.array())) > 20,
    }
    return docs.select("doc_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("errors"))
