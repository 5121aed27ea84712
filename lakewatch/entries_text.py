"""Queries of the fact detectors, the payload parsers and the table jobs over legal notices and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.functions import detect, text
from lakewatch.operators import filters, search, tables
from lakewatch.registry import on_corpus, on_notices, query, same
from lakewatch.sources import corpus as views
from lakewatch.sources import payloads


def _case(values: dict[int, str]) -> str:
    """What each of the notices' sentences has, by its number; null for the others."""
    return "CASE k " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items()) + " END"


_FACTS = {
    "numero_ato": {0: "1234/2024", 3: "10705/2000", 10: "55/2023", 13: "9/2021"}, "aliquotas": {1: "4%,8%,2.5%-8%"}, "relator": {2: "João da Silva"}, "revogacoes_citadas": {3: "10.705/2000,45.837/2015"},
    "recurso_tipos": {4: "embargos,resp", 5: "re"}, "temas_stf_stj": {5: "825,1024"}, "normas_citadas": {0: "1.234/2024", 3: "10.705/2000,45.837/2015", 10: "55/2023", 13: "9/2021"},
    "valores_monetarios": {6: "R$ 1.500,00,R$ 2 mil"}, "temas_especificos": {7: "base_de_calculo,fato_gerador,holding_familiar"},
}
_FLAGS = {"sancao_detectada": detect.SANCTION, "veto_detectado": detect.VETO, "repetitivo": detect.REPETITIVE, "modulacao_efeitos": detect.MODULATION}
on_notices(
    "d01_d13_facts",
    "SELECT doc_id, " + ", ".join([*(f"{_case(v)} AS {k}" for k, v in _FACTS.items()), *(f"CASE WHEN regexp_matches(notice, {same(p)}) THEN 'true' END AS {k}" for k, p in _FLAGS.items())]) + " FROM notices",
    lambda n: detect.with_facts(n, text.detection_form(F.col("notice")), "m").select("doc_id", *[F.col("m")[k].alias(k) for k in (*_FACTS, *_FLAGS)]),
)
on_notices("d10_amounts", f"SELECT doc_id, coalesce({_case({6: 'R$ 1.500,00|R$ 2 mil'})}, '') AS amounts FROM notices", lambda n: n.select("doc_id", F.array_join(detect.amounts(F.col("notice")), "|").alias("amounts")))
on_notices(
    "d14_act_type",
    f"SELECT doc_id, {_case({0: 'lei', 3: 'decreto', 8: 'instrucao_normativa', 10: 'portaria', 13: 'decreto'})} AS tipo, {_case({0: '1234/2024', 3: '45837/2015', 8: '2121/2022', 10: '55/2023', 13: '9/2021'})} AS numero, CAST({_case({0: '2024', 3: '2015', 8: '2022', 10: '2023', 13: '2021'})} AS INT) AS ano FROM notices",
    lambda n: n.select("doc_id", detect.act_type(F.col("notice")).alias("a")).select("doc_id", "a.tipo", "a.numero", "a.ano"),
)
on_notices("d15_body", "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(upper(notice), '\\b{b}\\b') THEN '{b}'" for b in detect.BODIES) + " END AS body FROM notices", lambda n: n.select("doc_id", detect.body(F.col("notice")).alias("body")))
on_notices("d16_invalid_articles", f"SELECT doc_id, coalesce({_case({9: '3000'})}, '') AS articles FROM notices", lambda n: n.select("doc_id", F.array_join(detect.invalid_code_articles(F.col("notice")), "|").alias("articles")))
query("j10_articles_outside", "SELECT doc_id, number FROM (SELECT doc_id, doc_id % 4000 AS number FROM documents) WHERE NOT (number BETWEEN 1 AND 1027 OR number BETWEEN 1196 AND 2046)")(
    lambda s, d: filters.outside_ranges(views.table(s, d, "documents").select("doc_id", (F.col("doc_id") % 4000).alias("number")), s.createDataFrame([(1, 1027), (1196, 2046)], "lo long, hi long"))
)
on_notices(
    "f14_enriched",
    f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'llm' ELSE {_case(_FACTS['numero_ato'])} END AS numero_ato, {_case(_FACTS['aliquotas'])} AS aliquotas, CASE WHEN doc_id % 2 = 0 THEN 'y' END AS extra FROM notices",
    lambda n: detect.with_facts(n, text.detection_form(F.col("notice"))).select("doc_id", detect.enrich(F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("numero_ato"), F.lit("llm"), F.lit("extra"), F.lit("y"))), F.col("facts")).alias("m")).select("doc_id", *[F.col("m")[k].alias(k) for k in ("numero_ato", "aliquotas", "extra")]),
)
on_notices("f01_compatibility_forms", "SELECT doc_id, CASE WHEN k = 14 THEN 'itcmd|OFFICE' ELSE '' END AS found FROM notices", lambda n: n.select("doc_id", F.array_join(filters.found_keywords(F.regexp_replace(F.substring_index("notice", "\n", 1), "​", ""), ("itcmd", "OFFICE")), "|").alias("found")))
on_corpus(
    "f02_expanded_keywords",
    "SELECT doc_id, array_to_string(list_filter(['license', 'the and', 'zu'], lambda k: contains(trim(regexp_replace(lower(texto), '\\s+', ' ', 'g')), k)), '|') AS found FROM corpus",
    lambda c: c.select("doc_id", F.array_join(filters.found_keywords(F.col("texto"), filters.expand_keywords(("license", "the and"), ("zu", "license"))), "|").alias("found")),
)
on_corpus("c06_title_similar", None, lambda c: c.where(search.title_similar(F.col("titulo"), "the and attion to thanedble the, anea. eriner thanea. thntblere of then, edtioner in")).select("doc_id", "titulo"))
query("s20_s23_d22_helpers", """SELECT doc_id, 'a b' AS clean, CASE doc_id % 5 WHEN 0 THEN TIMESTAMP '2024-01-05 10:00:00' WHEN 1 THEN TIMESTAMP '2024-02-03 00:00:00' WHEN 2 THEN TIMESTAMP '2024-03-09 00:00:00' WHEN 3 THEN TIMESTAMP '2024-04-01 12:30:00' END AS moment,
CASE doc_id % 6 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE (1 + doc_id % 90) * [1, 7, 30, 365][doc_id % 6 + 1] END AS days FROM documents""")(
    lambda s, d: views.table(s, d, "documents").select(
        "doc_id", text.strip_controls(F.concat(F.lit("a\u0007 "), F.lit("​b"))).alias("clean"), text.lenient_timestamp(F.expr("element_at(array('2024-01-05T10:00:00Z', '03/02/2024', '20240309', '2024-04-01 12:30:00', 'soon'), CAST(doc_id % 5 + 1 AS INT))")).alias("moment"),
        text.duration_days(F.expr("concat(1 + doc_id % 90, element_at(array('d', 'W', ' m'  , 'y', 'h', ''), CAST(doc_id % 6 + 1 AS INT)))".replace("' m'  ", "'m '"))).cast("long").alias("days"),
    )
)

# Payloads
_CLEAN = "replace(replace(text, '<', ' '), ']]', ' ')"


def _feeds(s, d) -> DataFrame:
    """The documents as landed feeds of 20 entries, some of them no feeds; each fourth entry has no link."""
    t = views.table(s, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.expr(_CLEAN).alias("t"))
    link = F.when(F.col("doc_id") % 4 != 3, F.expr("concat('<link>https://x.example.org/', doc_id, '</link>')")).otherwise(F.lit(""))
    entry = F.concat(F.expr("concat('<item><title>Entry ', doc_id, '</title>')"), link, F.expr("concat('<guid>g', doc_id, '</guid><pubDate>Mon, 15 Jan 2024 08:00:00 GMT</pubDate>')"), F.lit("<description><![CDATA["), "t", F.lit("]]></description></item>"))
    g = t.groupBy("source_id", F.expr("doc_id div 20").alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "").alias("body"))
    return g.select("source_id", F.lit("2024-01-31").cast("timestamp").alias("fetched_at"), F.when(F.col("g") % 7 == 6, F.lit("not a feed")).otherwise(F.concat(F.lit("<rss><channel>"), "body", F.lit("</channel></rss>"))).alias("body"))


query("s05_feed_entries", "SELECT source AS source_id, 'Entry ' || doc_id AS titulo, sha256('g' || doc_id) AS content_hash, TIMESTAMP '2024-01-15 08:00:00' AS data_publicacao FROM documents WHERE doc_id % 4 <> 3 AND (doc_id // 20) % 7 <> 6")(lambda s, d: payloads.parse_feed(_feeds(s, d))[0].select("source_id", "titulo", "content_hash", "data_publicacao"))
query("p08_failures", "SELECT 'rss' AS parser, source_id, 'parse_error' AS reason, count(*) AS n FROM (SELECT DISTINCT source AS source_id, doc_id // 20 AS g FROM documents) WHERE g % 7 = 6 GROUP BY 2")(
    lambda s, d: payloads.failures(_feeds(s, d).select("source_id", "fetched_at", F.lit(None).cast("string").alias("base_url"), "body", F.lit("rss").alias("parser")))
)


def _hits(s, d) -> DataFrame:
    """The documents as pages of one labelled hit each; each second place has an accent, each fifth hit no URN."""
    t = views.table(s, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.expr(_CLEAN).alias("t"))
    row = lambda k, v: F.concat(F.lit(f"<dt>{k}</dt><dd>"), v, F.lit("</dd>"))
    urn = F.when(F.col("doc_id") % 5 != 4, F.expr("concat('<a href=\"/urn/urn:lex:br;x:', doc_id, '\">x</a>')")).otherwise(F.lit(""))
    place = F.when(F.col("doc_id") % 3 == 0, F.lit("São Paulo")).when(F.col("doc_id") % 3 == 1, F.lit("sao paulo")).otherwise(F.lit("Recife"))
    body = F.concat(F.lit('<div class="hit">'), row("Título", F.expr("concat('Ato ', doc_id)")), row("Localidade", place), row("Ementa", F.col("t")), row("Data", F.lit("2024-01-09")), urn, F.lit("</div>"))
    return t.select("source_id", F.lit("2024-01-31").cast("timestamp").alias("fetched_at"), body.alias("body"))


query("s08_labelled_hits", "SELECT source AS source_id, 'Ato ' || doc_id AS titulo, sha256('urn:lex:br;x:' || doc_id) AS content_hash, TIMESTAMP '2024-01-09 00:00:00' AS data_publicacao FROM documents WHERE doc_id % 5 <> 4 AND doc_id % 3 < 2")(lambda s, d: payloads.labelled_hits(_hits(s, d), ["São Paulo"]).select("source_id", "titulo", "content_hash", "data_publicacao"))


def _gazettes(s, d) -> DataFrame:
    """The documents as gazette texts of two acts, the second glued to the first."""
    t = F.concat(F.expr("concat('DIÁRIO\nLEI Nº 1.', 100 + doc_id % 900, '\n')"), "text", F.expr("concat('. DECRETO Nº ', doc_id, ' trata do ITCMD')"))
    return views.table(s, d, "documents").select("doc_id", t.alias("text"))


query("s17_gazette_acts", "SELECT doc_id, 0 AS pos, '1.' || 100 + doc_id % 900 AS numero, 'LEI Nº 1.' || 100 + doc_id % 900 AS titulo FROM documents UNION ALL SELECT doc_id, 1, doc_id::VARCHAR, 'DECRETO Nº ' || doc_id || ' trata do ITCMD' FROM documents")(lambda s, d: payloads.gazette_acts(_gazettes(s, d)).select("doc_id", "pos", "numero", "titulo"))
query("s18_prefiltered_acts", "SELECT doc_id, 1 AS pos FROM documents UNION ALL SELECT doc_id, 0 FROM documents WHERE contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'license')")(lambda s, d: payloads.prefilter_acts(payloads.gazette_acts(_gazettes(s, d)), ["ITCMD"], ["license"]).select("doc_id", "pos"))

# Table jobs
_DLQ = "SELECT 'e' || event_id AS entry_id, CASE WHEN event_type = 'error' THEN 'llm_error' ELSE 'parse_error' END AS reason, event_id FROM events"


def _dlq(s, d) -> DataFrame:
    e = views.table(s, d, "events")
    return e.select(F.concat(F.lit("e"), "event_id").alias("entry_id"), F.when(F.col("event_type") == "error", "llm_error").otherwise("parse_error").alias("reason"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("failed_at"))


query("k14_dead_letters", f"SELECT entry_id FROM ({_DLQ}) WHERE reason = 'llm_error' AND event_id % 3 <> 0")(
    lambda s, d: tables.dlq_by_reason(tables.dlq_remove(_dlq(s, d), _dlq(s, d).where("CAST(substr(entry_id, 2) AS BIGINT) % 3 = 0")), "llm_error").select("entry_id")
)
query("k06_audit_retention", "SELECT 'audit' AS collection, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '20' DAY UNION ALL SELECT 'runs', count(*) FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '10' DAY")(
    lambda s, d: tables.retained({"audit": views.table(s, d, "events").withColumn("at", F.col("ts").cast("timestamp")), "runs": views.table(s, d, "events").where("event_type = 'view'").withColumn("at", F.col("ts").cast("timestamp"))}, {"audit": 20, "runs": 10}, at="at")[1]
)
on_corpus(
    "k15_added_keywords",
    "SELECT DISTINCT lower(tags[1]) AS kw FROM corpus WHERE len(tags) > 0 AND length(tags[1]) BETWEEN 3 AND 100 AND lower(tags[1]) <> 'the' UNION ALL SELECT 'Extra'",
    lambda c: tables.added_keywords(c.sparkSession.createDataFrame([("Extra",)], "kw string"), c.sparkSession.createDataFrame([("The",)], "kw string"), c.where("size(tags) > 0").select(F.lower(F.col("tags")[0]).alias("kw")), most=None),
)
_CONFIG = (("en", "the "), ("en", " of "), ("es", " de "), ("es", "CIÓN"), ("de", "und"), ("de", "ver"), ("fr", "ment"), ("fr", "la"))
_N = lambda t: " + ".join(f"contains(form, '{k.strip().lower()}')::INT" for x, k in _CONFIG if x == t)
on_corpus(
    "e03_configured_topics",
    "SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'n': -({_N(t)}), 't': '{t}'}}" for t in ("de", "en", "es", "fr")) + "], lambda r: r.n < 0)), lambda r: r.t), '|') AS topics FROM (SELECT doc_id, trim(regexp_replace(lower(texto), '\\s+', ' ', 'g')) AS form FROM corpus)",
    lambda c: filters.configured_topics(c, c.sparkSession.createDataFrame(list(_CONFIG), "topic string, kw string")).select("doc_id", F.array_join("topics", "|").alias("topics")),
)
