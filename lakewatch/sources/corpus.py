"""Adapter views: the generic tables in the shape of the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the dates of the event of the same id; those with a label count as classified."""
    d = table(spark, sf_dir, "documents").alias("d")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    e = e.join(d.select("doc_id"), "doc_id", "left_semi")  # few of the events are documents'
    titled = d.select("doc_id", "text", "lang", "source", F.expr("replace(substr(text, 1, 80), '\n', ' ')").alias("titulo"), F.sha2("text", 256).alias("content_hash"), F.expr("substr(text, 81, 200)").alias("second"))
    # what is made of a text's start goes through the shuffle in its place, and no text is sorted for the join
    j = titled.join(e.join(l, "doc_id", "full").hint("shuffle_hash"), "doc_id", "left")  # a document without an event has the first day, and no value
    j = j.withColumn("ts", F.coalesce("ts", F.lit("2024-01-01").cast("timestamp"))).withColumn("event_type", F.coalesce("event_type", F.lit("view"))).withColumn("value", F.coalesce("value", F.lit(0.0)))
    n = F.expr("CAST(substr(source, 4) AS INT)")
    when = lambda c: F.expr(f"CASE WHEN labelled THEN {c} END")
    relevance = "CAST(floor(value) AS INT) % 11"
    return j.select(
        "doc_id", F.lit("owner").alias("owner_id"), F.col("source").alias("source_id"), F.upper("lang").alias("uf"),
        F.when(n % 3 == 0, "sefaz").when(n % 3 == 1, "assembleia").otherwise("noticia").alias("source_tipo"),
        F.expr("concat('https://', source, '.example.org/', doc_id)").alias("url"),
        "titulo", F.col("text").alias("texto"), "content_hash",
        F.when(F.col("doc_id") % 7 != 0, F.col("ts")).alias("data_publicacao"), F.expr("ts + INTERVAL '1' DAY").alias("fetched_at"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN ts + INTERVAL '1' DAY ELSE ts END").alias("eff_date"),
        F.expr("labelled IS NOT NULL").alias("has_llm"), when("event_type").alias("tipo"), when(relevance).alias("relevancia"),
        when(f"CASE WHEN {relevance} < 5 THEN 'descartado' WHEN {relevance} >= 9 THEN 'critico' WHEN {relevance} >= 8 THEN 'alta' WHEN {relevance} >= 7 THEN 'normal' ELSE 'baixa' END").alias("severity_tier"),
        F.expr(f"CASE WHEN labelled IS NULL THEN 'pending' WHEN {relevance} < 5 THEN 'archived' ELSE 'classified' END").alias("status"),
        when("concat('m', doc_id % 2)").alias("llm_model"), when("concat('v', doc_id % 3)").alias("prompt_version"), when("second").alias("resumo"),
        when("slice(split(lower(titulo), ' '), 1, 3)").alias("tags"),
        when("CASE doc_id % 4 WHEN 0 THEN array('itcd') WHEN 1 THEN array('sucessoes', 'itcd') WHEN 2 THEN array('regime_bens') ELSE array() END").alias("topics"),
        F.expr("CASE doc_id % 10 WHEN 0 THEN array('favorito', 'lido') WHEN 1 THEN array('lido') ELSE array() END").alias("user_tags"),
        F.map_filter(
            F.create_map(
                F.lit("numero_ato"), when("CASE WHEN doc_id % 3 = 0 THEN concat(doc_id % 40, '/2024') END"), F.lit("aliquotas"), when("CASE WHEN doc_id % 5 = 0 THEN concat(doc_id % 4, '%, ', doc_id % 3, '%') END"),
                F.lit("valores_monetarios"), when("CASE WHEN doc_id % 6 = 0 THEN concat('R$ ', doc_id % 100) END"), F.lit("temas_especificos"), when("CASE WHEN doc_id % 2 = 0 THEN concat('t', doc_id % 7, ', t', doc_id % 3) END"),
            ), lambda k, v: v.isNotNull(),
        ).alias("metadados"),
    )


#: The same view for DuckDB; metadata are columns of their own there.
CORPUS_SQL = r"""
corpus AS (SELECT *, CASE WHEN relevancia IS NULL THEN 'pending' WHEN relevancia < 5 THEN 'archived' ELSE 'classified' END AS status,
  CASE WHEN relevancia < 5 THEN 'descartado' WHEN relevancia >= 9 THEN 'critico' WHEN relevancia >= 8 THEN 'alta' WHEN relevancia >= 7 THEN 'normal' WHEN relevancia IS NOT NULL THEN 'baixa' END AS severity_tier FROM (
  SELECT d.doc_id, 'owner' AS owner_id, d.source AS source_id, upper(d.lang) AS uf,
    CASE CAST(substr(d.source, 4) AS INT) % 3 WHEN 0 THEN 'sefaz' WHEN 1 THEN 'assembleia' ELSE 'noticia' END AS source_tipo,
    'https://' || d.source || '.example.org/' || d.doc_id AS url, replace(substr(d.text, 1, 80), chr(10), ' ') AS titulo, d.text AS texto, sha256(d.text) AS content_hash,
    CASE WHEN d.doc_id % 7 <> 0 THEN e.ts END AS data_publicacao, e.ts + INTERVAL '1' DAY AS fetched_at, CASE WHEN d.doc_id % 7 = 0 THEN e.ts + INTERVAL '1' DAY ELSE e.ts END AS eff_date,
    l.doc_id IS NOT NULL AS has_llm, CASE WHEN l.doc_id IS NOT NULL THEN e.event_type END AS tipo, CASE WHEN l.doc_id IS NOT NULL THEN CAST(floor(e.value) AS INT) % 11 END AS relevancia,
    CASE WHEN l.doc_id IS NOT NULL THEN 'm' || d.doc_id % 2 END AS llm_model, CASE WHEN l.doc_id IS NOT NULL THEN 'v' || d.doc_id % 3 END AS prompt_version, CASE WHEN l.doc_id IS NOT NULL THEN substr(d.text, 81, 200) END AS resumo,
    CASE WHEN l.doc_id IS NOT NULL THEN string_split(lower(replace(substr(d.text, 1, 80), chr(10), ' ')), ' ')[1:3] END AS tags,
    CASE WHEN l.doc_id IS NOT NULL THEN CASE d.doc_id % 4 WHEN 0 THEN ['itcd'] WHEN 1 THEN ['sucessoes', 'itcd'] WHEN 2 THEN ['regime_bens'] ELSE [] END END AS topics,
    CASE d.doc_id % 10 WHEN 0 THEN ['favorito', 'lido'] WHEN 1 THEN ['lido'] ELSE [] END AS user_tags,
    CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 = 0 THEN d.doc_id % 40 || '/2024' END AS numero_ato, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 5 = 0 THEN d.doc_id % 4 || '%, ' || d.doc_id % 3 || '%' END AS aliquotas,
    CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 6 = 0 THEN 'R$ ' || d.doc_id % 100 END AS valores_monetarios, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 2 = 0 THEN 't' || d.doc_id % 7 || ', t' || d.doc_id % 3 END AS temas_especificos
  FROM documents d LEFT JOIN (SELECT event_id, ts, event_type, value FROM events) e0 ON e0.event_id = d.doc_id CROSS JOIN LATERAL (SELECT coalesce(e0.ts, TIMESTAMP '2024-01-01 00:00:00') AS ts, coalesce(e0.event_type, 'view') AS event_type, coalesce(e0.value, 0.0) AS value) e LEFT JOIN labels l ON l.doc_id = d.doc_id))
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of the corpus's sources."""
    n = F.expr("CAST(substr(source, 4) AS INT)")
    s = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", n)
    return s.select(
        F.col("source").alias("id"), F.expr("element_at(array('DE', 'EN', 'ES', 'FR', '_federal'), n % 5 + 1)").alias("uf"), F.concat(F.lit("Source "), "n").alias("nome"),
        F.when(n % 3 == 0, "sefaz").when(n % 3 == 1, "assembleia").otherwise("noticia").alias("tipo"), F.expr("concat(CASE WHEN n % 6 = 0 THEN 'http' ELSE 'https' END, '://', source, CASE WHEN n % 2 = 0 THEN '.gov.br' ELSE '.example.org' END)").alias("url"),
        F.expr("CASE WHEN n % 4 = 1 THEN array('the', 'and') WHEN n % 4 = 2 THEN array('ITCD') ELSE array() END").alias("keywords_required"), (n != 19).alias("ativo"), (n % 5 == 0).alias("fragile"), (n % 4 == 0).alias("trusted"), (n % 9 == 0).alias("geo_restricted"),
        (n % 10 == 3).alias("keywords_bypass"), F.expr("CASE WHEN n % 10 = 3 THEN array('eres', 'ion') ELSE array() END").alias("org_mentions"), F.expr("CASE WHEN n % 8 = 7 THEN array() ELSE array('itcd') END").alias("topics"),
        F.expr("CASE WHEN n % 7 = 0 THEN 0 WHEN n % 7 = 1 THEN 3 END").alias("expected_min_items_per_week"), F.expr("CASE WHEN n % 10 = 0 THEN 'notes' END").alias("notas"),
    )


SOURCES_SQL = r"""
sources AS (SELECT source AS id, ['DE', 'EN', 'ES', 'FR', '_federal'][n % 5 + 1] AS uf, 'Source ' || n AS nome, CASE n % 3 WHEN 0 THEN 'sefaz' WHEN 1 THEN 'assembleia' ELSE 'noticia' END AS tipo,
  CASE WHEN n % 6 = 0 THEN 'http' ELSE 'https' END || '://' || source || CASE WHEN n % 2 = 0 THEN '.gov.br' ELSE '.example.org' END AS url,
  CASE n % 4 WHEN 1 THEN ['the', 'and'] WHEN 2 THEN ['ITCD'] ELSE [] END AS keywords_required, n <> 19 AS ativo, n % 5 = 0 AS fragile, n % 4 = 0 AS trusted, n % 9 = 0 AS geo_restricted, n % 10 = 3 AS keywords_bypass,
  CASE WHEN n % 10 = 3 THEN ['eres', 'ion'] ELSE [] END AS org_mentions, CASE WHEN n % 8 = 7 THEN [] ELSE ['itcd'] END AS topics, CASE n % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 END AS expected_min_items_per_week, CASE WHEN n % 10 = 0 THEN 'notes' END AS notas
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM documents))
"""


def run_history(spark: SparkSession, sf_dir: str, value: float = 30.0) -> DataFrame:
    """Items of each source on each day of the events; sources and days are few."""
    e = table(spark, sf_dir, "events").withColumn("run_day", F.to_date("ts"))
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    c = e.where((F.col("event_type") == "purchase") & (F.col("value") > value)).groupBy(F.concat(F.lit("src"), F.col("event_id") % 20).alias("source_id"), "run_day").agg(F.count(F.lit(1)).alias("items"))
    days = e.agg(F.array_sort(F.collect_set("run_day")).alias("days"))  # a set of days, one row
    return s.join(F.broadcast(days)).select("source_id", F.explode("days").alias("run_day")).join(c, ["source_id", "run_day"], "left").fillna({"items": 0})


RUN_HISTORY_SQL = r"""
run_history AS (SELECT s.source_id, dd.run_day, coalesce(c.items, 0) AS items FROM (SELECT DISTINCT source AS source_id FROM documents) s CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS run_day FROM events) dd
  LEFT JOIN (SELECT 'src' || event_id % 20 AS source_id, CAST(ts AS DATE) AS run_day, count(*) AS items FROM events WHERE event_type = 'purchase' AND value > 30 GROUP BY 1, 2) c ON c.source_id = s.source_id AND c.run_day = dd.run_day)
"""


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("src"), F.col("event_id") % 20).alias("source_id"), (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


SOURCE_EVENTS_SQL = "source_events AS (SELECT 'src' || event_id % 20 AS source_id, event_type <> 'error' AS ok, ts, event_id FROM events)"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("command"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Webhook events with an address and a user agent."""
    e = table(spark, sf_dir, "events")
    ip = F.concat_ws(".", (F.col("user_id") % 223 + 1), F.col("event_id") % 256, F.col("user_id") % 256, F.col("event_id") % 7)
    agent = F.when(F.col("event_type") == "view", "Slackbot-LinkExpanding 1.0").when(F.col("event_type") == "error", "curl/8.0").otherwise("Mozilla/5.0")
    payload = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, agent).alias("useragent"), F.when(F.col("event_id") % 2 == 1, agent).alias("user_agent"), ip.alias("src_ip"), F.md5(F.col("event_id").cast("string")).alias("token")))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), payload.alias("payload"))


TRIGGERS_SQL = r"""
triggers AS (SELECT event_id, ts, concat_ws('.', user_id % 223 + 1, event_id % 256, user_id % 256, event_id % 7) AS ip, CASE event_type WHEN 'view' THEN 'Slackbot-LinkExpanding 1.0' WHEN 'error' THEN 'curl/8.0' ELSE 'Mozilla/5.0' END AS agent,
  md5(CAST(event_id AS VARCHAR))[1:16] AS token FROM events)
"""

#: Watches by name: pattern, type, region, least relevance, expired or cooling.
WATCHES = (
    ("w1", "ration", "term", None, 0, None, 0, None),
    ("w2", "the", "term", "EN", 5, None, 24, "2024-01-29 00:00:00"),
    ("w3", "nd (of|to) ", "regex", None, 7, "2024-03-01 00:00:00", 0, None),
    ("w4", "12/2024", "pl_number", None, 0, None, 0, None),
    ("w5", "FR:itcd", "uf_topic", None, 0, None, 24, "2024-01-30 12:00:00"),
    ("w6", "EN:sucessoes", "uf_topic", None, 3, None, 0, None),
    ("w7", "license", "term", None, 0, "2024-01-01 00:00:00", 0, None),
    ("w8", "9/2024", "pl_number", "DE", 0, None, 0, None),
)


def watches(spark: SparkSession) -> DataFrame:
    from lakewatch.schema import WATCH

    rows = spark.createDataFrame([(*w[:5], w[5], w[6], w[7]) for w in WATCHES], "watch_id string, pattern string, pattern_type string, uf string, relevancia_min int, e string, cooldown_hours int, l string")
    return rows.withColumn("expires_at", F.to_timestamp("e")).withColumn("last_triggered", F.to_timestamp("l")).select(*[c.split()[0] for c in WATCH.split(", ")])


# Sentences of legal notices, one for each remainder of doc_id by 16; they stand before the document's whole text.
NOTICES = (
    "Lei nº 1.234/2024 sancionada pelo governador.", "Alíquota de 4% de ITCD, e de 2,5% a 8% sobre a doação.", "Relator: Dep. João da Silva. O veto parcial foi mantido.",
    "Fica revogada a Lei nº 10.705/2000 e o Decreto 45.837/2015.", "Embargos infringentes no Recurso Especial.", "Recurso extraordinário, rito dos repetitivos, Tema 825 e Tema nº 1024.",
    "Doação de R$ 1.500,00 e de R$ 2 milhões.", "Houve modulação dos efeitos; mudam o fato gerador e a base de cálculo. Holding familiar.", "Instrução Normativa RFB nº 2.121/2022, ao lado da SEFAZ-SP.",
    "Veja o art. 3000 do Código Civil.", "Portaria nº 55/2023 da PGFN.", "CPF 123.456.789-09, CNPJ 12.345.678/0001-95, telefone (11) 91234-5678.", "Chaves sk_live_abcdefghij0123456789 e ghp_abcdefghijklmnopqrstuvwxyz012345.",
    "Decreto 9/2021. DELETE FROM tabela; ../../etc/passwd", "ＩＴＣＭＤ em São Paulo, ofﬁce​ novo.", "Sem fatos.",
)


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and notice: a sentence by doc_id and the document's whole text; act: the notice's number of an act."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    listed = F.array(*[F.lit(n) for n in NOTICES])
    return d.select("doc_id", F.col("source").alias("source_id"), F.concat_ws("\n", F.get(listed, (F.col("doc_id") % 16).cast("int")), "text").alias("notice"))


NOTICES_SQL = (
    "notices AS (SELECT doc_id, source AS source_id, doc_id % 16 AS k, concat_ws(chr(10), ["
    + ", ".join("'" + n.replace("'", "''") + "'" for n in NOTICES)
    + "][doc_id % 16 + 1], text) AS notice FROM documents)"
)
