"""The engine's queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewatch.functions import detect, protect, text
from lakewatch.operators import analytics, audit, clusters, config, exports, filters, health, postings, search, tables, watches
from lakewatch.plans import intake
from lakewatch.registry import ORACLE_SQL, QUERIES, on_both, on_corpus, on_notices, query, same
from lakewatch.session import scratch
from lakewatch.sources import catalog, corpus as views, payloads, selectors, zipped
from lakewatch.streaming import jobs
from lakewatch.streaming.replay import replay

ACTIVE = ["EN", "FR", "XX"]
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
KEYWORDS = ("license", "ration", "the and", "ción", "mente")
TOPIC_WORDS = {"en": ("the ", " of "), "es": (" de ", "ción"), "de": (" und ", "ver"), "fr": (" la ", "eaux", "ment")}
_corpus, _both = on_corpus, on_both

_SPLIT = "list_filter(list_transform(string_split({}, ','), lambda x: trim(x)), lambda x: x <> '')"
_SINCE = "{} >= " + AS_OF + " - INTERVAL '{}' DAY"


def since(column: str, days: int) -> str:
    return _SINCE.format(column, days)


#: A moment within reach of the corpus's dates, which are the first days of January at every scale but the smallest.
EARLY = "2024-01-09 00:00:00"


def early(column: str, days: int) -> str:
    return since(column, days).replace(AS_OF, f"TIMESTAMP '{EARLY}'")


_TOPICS = "SELECT unnest(list_concat(coalesce(tags, []), coalesce(" + _SPLIT.format("temas_especificos") + ", []))) AS topic FROM corpus WHERE has_llm AND {}"

# Aggregations
_corpus("a01_trending_topics", f"SELECT topic, count(*) AS n FROM ({_TOPICS.format(early('eff_date', 7))}) GROUP BY topic ORDER BY n DESC, topic LIMIT 10", lambda c: analytics.trending_topics(c, EARLY, days=7))
_corpus("a02_top_sources", "SELECT source_id, avg(relevancia) AS avg_relevancia, count(*) AS n FROM corpus WHERE has_llm GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10", analytics.top_sources_by_relevance)
_corpus("a03_top_ufs", "SELECT uf, count(*) AS n FROM corpus GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", analytics.top_ufs)
_corpus("a04_coverage_gaps", f"SELECT uf FROM (SELECT unnest(['EN', 'FR', 'XX']) AS uf) WHERE uf NOT IN (SELECT uf FROM corpus WHERE {since('eff_date', 14)})", lambda c: analytics.coverage_gaps(c, ACTIVE))
_corpus(
    "a05_rates_by_uf",
    f"""SELECT uf, string_agg(rate, '|' ORDER BY d, doc_id, pos) AS aliquotas FROM (SELECT uf, rate, arg_min(d, (d, doc_id, pos)) AS d, arg_min(doc_id, (d, doc_id, pos)) AS doc_id, arg_min(pos, (d, doc_id, pos)) AS pos FROM (
    SELECT uf, eff_date AS d, doc_id, pos, l[pos] AS rate FROM (SELECT uf, eff_date, doc_id, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT uf, eff_date, doc_id, {_SPLIT.format('aliquotas')} AS l FROM corpus WHERE aliquotas IS NOT NULL))) GROUP BY uf, rate) GROUP BY uf""",
    lambda c: analytics.rates_by_uf(c).select("uf", F.array_join("aliquotas", "|").alias("aliquotas")),
)
_corpus("a06_money_mentions", "SELECT count(*) AS n FROM corpus WHERE valores_monetarios <> ''", analytics.money_mentions)
_corpus("a07_tag_frequency", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM corpus) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", analytics.tag_frequency)
_MATURITY = "SELECT uf, round_even(0.4::DOUBLE * volume / max(volume) OVER () + 0.4::DOUBLE * coalesce(rel, 0) / 10 + 0.2::DOUBLE * tipos / 9, 3) AS score FROM (SELECT uf, count(*) AS volume, avg(relevancia) AS rel, count(DISTINCT tipo) AS tipos FROM corpus GROUP BY uf)"
_corpus("a08_maturity", _MATURITY, analytics.maturity)
_PROACTIVE = f"SELECT uf, count(*) AS n FROM corpus WHERE source_tipo = 'sefaz' AND tipo IN ('view', 'click', 'purchase') AND {since('eff_date', 90)} GROUP BY 1"
_corpus("a09_proactivity", _PROACTIVE, analytics.proactivity)
_ACTUALITY = f"SELECT uf, round_even(avg((epoch_us({AS_OF}) - epoch_us(eff_date)) / 86400000000.0::DOUBLE), 1) AS mean_age_days FROM corpus GROUP BY 1"
_corpus("a10_actuality", _ACTUALITY, analytics.actuality)
_corpus("a11_seasonality", "SELECT strftime(eff_date, '%Y-%m') AS month, count(*) AS n FROM corpus GROUP BY 1", analytics.seasonality)
_trend = lambda d: f"SELECT * FROM (SELECT 'trending_{d}d' AS metric, topic AS key, count(*)::DOUBLE AS value FROM ({_TOPICS.format(since('eff_date', d))}) GROUP BY topic ORDER BY 3 DESC, 2 LIMIT 10)"
_corpus(
    "a12_consolidated_report",
    " UNION ALL ".join([
        *(_trend(d) for d in (7, 30, 90)), "SELECT * FROM (SELECT 'top_sources', source_id, avg(relevancia)::DOUBLE FROM corpus WHERE has_llm GROUP BY 2 HAVING count(*) >= 3 ORDER BY 3 DESC, 2 LIMIT 10)",
        "SELECT * FROM (SELECT 'top_ufs', uf, count(*)::DOUBLE FROM corpus GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)", f"SELECT 'gaps', uf, 1::DOUBLE FROM (SELECT unnest(['EN', 'FR', 'XX']) AS uf) WHERE uf NOT IN (SELECT uf FROM corpus WHERE {since('eff_date', 14)})",
        f"SELECT 'rates', uf, count(DISTINCT rate)::DOUBLE FROM (SELECT uf, unnest({_SPLIT.format('aliquotas')}) AS rate FROM corpus WHERE aliquotas IS NOT NULL) GROUP BY uf", "SELECT 'money_mentions', '', count(*)::DOUBLE FROM corpus WHERE valores_monetarios <> ''",
        "SELECT * FROM (SELECT 'tags', tag, count(*)::DOUBLE FROM (SELECT unnest(tags) AS tag FROM corpus) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)", f"SELECT 'maturity', uf, score FROM ({_MATURITY})", f"SELECT 'actuality', uf, mean_age_days FROM ({_ACTUALITY})", f"SELECT 'proactivity', uf, n::DOUBLE FROM ({_PROACTIVE})",
        "SELECT 'seasonality', strftime(eff_date, '%Y-%m'), count(*)::DOUBLE FROM corpus GROUP BY 2", "SELECT 'total', '', count(*)::DOUBLE FROM corpus", "SELECT 'classified', '', count_if(has_llm)::DOUBLE FROM corpus",
    ]),
    lambda c: analytics.consolidated(c, ACTIVE),
)
_both(
    "a13_source_health_score",
    f"""SELECT s.id AS source_id, coalesce(items, 0) AS items, round_even(coalesce(age, 30.0), 2) AS mean_age, round_even(coalesce(cl, 0.0), 3) AS classified FROM sources s LEFT JOIN
    (SELECT source_id, count(*) AS items, avg((epoch_us({AS_OF}) - epoch_us(eff_date)) / 86400000000.0::DOUBLE) AS age, avg(has_llm::INT::DOUBLE) AS cl FROM corpus WHERE {since('fetched_at', 30)} GROUP BY 1) b ON b.source_id = s.id""",
    health.health_score,
)
_corpus("a14_items_per_month", "SELECT source_id, strftime(eff_date, '%Y-%m') AS month, count(*) AS n FROM corpus GROUP BY 1, 2", health.items_per_month)
_corpus("a15_false_positive_rate", "SELECT source_id, count(*) AS n, count_if(relevancia < 5)::BIGINT AS discarded, round_even(count_if(relevancia < 5)::DOUBLE / count(*), 3) AS rate FROM corpus WHERE has_llm GROUP BY 1", health.false_positive_rate)
_corpus("a16_revision_calendar", f"SELECT *, floor((epoch_us({AS_OF}) - epoch_us(last_fetched)) / 86400000000)::BIGINT AS days FROM (SELECT source_id, max(fetched_at) AS last_fetched FROM corpus GROUP BY 1) WHERE (epoch_us({AS_OF}) - epoch_us(last_fetched)) / 86400000000 >= 0", lambda c: health.revision_calendar(c, least_days=0))
_corpus("a17_source_volume", "SELECT source_id, count(*) AS n FROM corpus GROUP BY 1", health.source_volume)
_both(
    "a18_dashboard",
    f"""SELECT 'uf' AS panel, uf AS key, count(*) AS n FROM corpus GROUP BY 2 UNION ALL SELECT 'uf_7d', uf, count(*) FROM corpus WHERE {since('fetched_at', 7)} GROUP BY 2 UNION ALL SELECT 'topic', t, count(*) FROM (SELECT unnest(topics) AS t FROM corpus) GROUP BY 2
    UNION ALL SELECT 'severity', coalesce(severity_tier, 'n/a'), count(*) FROM corpus GROUP BY 2 UNION ALL SELECT 'total_7d', '', count(*) FROM corpus WHERE {since('fetched_at', 7)}
    UNION ALL SELECT 'silent', '', count(*) FROM sources WHERE ativo AND id NOT IN (SELECT source_id FROM corpus WHERE {since('fetched_at', 7)})
    UNION ALL SELECT * FROM (SELECT 'recent', doc_id::VARCHAR, floor(epoch(fetched_at))::BIGINT FROM corpus ORDER BY fetched_at DESC, doc_id LIMIT 20)""",
    analytics.dashboard,
)
_TODAY = f"count_if(has_llm AND {since('fetched_at', 1)})::BIGINT"
_corpus("a19_status_counts", f"SELECT 'status' AS metric, status AS key, count(*) AS n FROM corpus GROUP BY 2 UNION ALL SELECT 'uf_7d', uf, count(*) FROM corpus WHERE {since('fetched_at', 7)} GROUP BY 2 UNION ALL SELECT 'classified_today', '', {_TODAY} FROM corpus UNION ALL SELECT 'quota_left', '', greatest(0, 1500 - {_TODAY}) FROM corpus", analytics.status_counts)
_corpus("a20_user_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(user_tags) AS tag FROM corpus) GROUP BY 1", analytics.user_tag_counts)


_REGION = "CASE WHEN event_id % 5 < 3 THEN 'U' || event_id % 5 ELSE NULL END"
query("a22_run_metrics", f"""WITH e AS (SELECT {_REGION} AS uf, event_type AS kind, CAST(floor(value) AS BIGINT) AS d, event_id % 3 AS items, event_id % 11 AS tokens, event_id % 13 <> 0 AS ok FROM events), u AS (SELECT uf, uf IN (SELECT uf FROM e WHERE items > 0 AND uf IS NOT NULL) AS has FROM (SELECT unnest(['U0', 'U1', 'U2', 'U9']) AS uf))
SELECT 'llm_calls' AS name, 'llm' AS label, count_if(kind = 'click')::DOUBLE AS value FROM e UNION ALL SELECT 'llm_failures', 'llm', count_if(kind = 'click' AND NOT ok)::DOUBLE FROM e UNION ALL SELECT 'llm_tokens', 'llm', coalesce(sum(CASE WHEN kind = 'click' THEN tokens END), 0)::DOUBLE FROM e
UNION ALL SELECT 'stage_duration_ms', kind, sum(d)::DOUBLE FROM e GROUP BY 2 UNION ALL SELECT 'uf_with_items', uf, has::INT::DOUBLE FROM u UNION ALL SELECT 'uf_coverage_percent', 'uf', 100.0::DOUBLE * count_if(has) / count(*) FROM u""")(
    lambda s, d: analytics.run_metrics(views.table(s, d, "events").select(F.expr("CASE WHEN event_id % 5 < 3 THEN concat('U', event_id % 5) END AS uf"), F.col("event_type").alias("kind"), F.floor("value").alias("duration_ms"), (F.col("event_id") % 3).alias("items"), (F.col("event_id") % 11).alias("tokens"), (F.col("event_id") % 13 != 0).alias("ok")), ["U0", "U1", "U2", "U9"], "click"))


@query("a22_execution_metrics", """SELECT 'collector_duration_ms' AS name, collector AS label, sum(d)::DOUBLE AS value FROM (SELECT 'src' || event_id % 20 AS collector, CAST(floor(value) AS BIGINT) AS d FROM events) GROUP BY 2
UNION ALL SELECT 'collector_errors', 'src' || event_id % 20, count_if(event_type = 'error')::DOUBLE FROM events GROUP BY 2 UNION ALL SELECT 'collector_items', 'src' || event_id % 20, sum(event_id % 3)::DOUBLE FROM events GROUP BY 2
UNION ALL SELECT 'quota_percent', 'view', least(100.0, 100.0 * count_if(event_type = 'view') / 1500)::DOUBLE FROM events UNION ALL SELECT 'quota_percent', 'click', least(100.0, 100.0 * count_if(event_type = 'click') / 20000)::DOUBLE FROM events""")
def _a22(spark, d):
    e = views.table(spark, d, "events").select(F.concat(F.lit("src"), F.col("event_id") % 20).alias("collector"), F.col("event_type").alias("kind"), F.floor("value").alias("duration_ms"), (F.col("event_id") % 3).alias("items"), (F.col("event_type") != "error").alias("ok"))
    return analytics.execution_metrics(e, {"view": 1500, "click": 20000})


_corpus(
    "a24_digest_summary",
    """SELECT count_if(severity_tier = 'critico')::BIGINT AS n_critico, count_if(severity_tier = 'alta')::BIGINT AS n_alta, (SELECT string_agg(DISTINCT uf, '|' ORDER BY uf) FROM corpus WHERE has_llm AND uf <> '_federal') AS ufs,
    (SELECT string_agg(doc_id::VARCHAR, '|' ORDER BY relevancia DESC, doc_id) FROM (SELECT doc_id, relevancia FROM corpus WHERE has_llm ORDER BY relevancia DESC, doc_id LIMIT 5)) AS top_docs,
    (SELECT string_agg(s || '=' || n, '|' ORDER BY s || '=' || n) FROM (SELECT coalesce(topics[1], 'outros') AS s, count(*) AS n FROM corpus WHERE has_llm GROUP BY 1)) AS sections FROM corpus WHERE has_llm""",
    lambda c: analytics.digest_summary(c).select("n_critico", "n_alta", *[F.array_join(x, "|").alias(x) for x in ("ufs", "top_docs", "sections")]),
)


@query("a25_slo", "SELECT avg((event_type <> 'error')::INT::DOUBLE) AS success, quantile_disc(value, 0.95) AS p95_s, avg((user_id % 400 <= 300)::INT::DOUBLE) AS notified_5min, avg((event_id % 50 <> 0)::INT::DOUBLE) AS fully_classified FROM events")
def _a25(spark, d):
    e = views.table(spark, d, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("duration_s"), (F.col("user_id") % 400).alias("latency_s"), (F.col("event_id") % 50 != 0).alias("classified"))
    return analytics.slo(e)


query("a25_slo_by_source", "SELECT 'src' || event_id % 20 AS source_id, avg((event_type <> 'error')::INT::DOUBLE) AS success, count(*) AS n FROM events GROUP BY 1")(lambda s, d: analytics.slo_by_source(views.source_events(s, d)))

# Windows over histories
query("w01_trailing_verdict", """SELECT source_id, arg_max(dis, (ts, event_id)) AS should_disable, arg_max(en, (ts, event_id)) AS should_enable FROM (SELECT source_id, ts, event_id, max(ok::INT) OVER f = 0 AND count(*) OVER f = 5 AS dis, min(ok::INT) OVER g = 1 AND count(*) OVER g = 3 AS en
FROM source_events WINDOW f AS (PARTITION BY source_id ORDER BY ts, event_id ROWS 4 PRECEDING), g AS (PARTITION BY source_id ORDER BY ts, event_id ROWS 2 PRECEDING)) GROUP BY 1""", "source_events")(lambda s, d: health.trailing_verdict(views.source_events(s, d)))
_ZERO = """SELECT source_id, run_day, items, least(sum((items = 0)::INT) OVER (PARTITION BY source_id, island ORDER BY run_day), 10000)::BIGINT AS consecutive_zero_runs, last_nonzero_at, sum((items = 0)::INT) OVER (PARTITION BY source_id, island ORDER BY run_day) = 3 AS alert
FROM (SELECT *, sum((items > 0)::INT) OVER (PARTITION BY source_id ORDER BY run_day) AS island, max(CASE WHEN items > 0 THEN run_day END) OVER (PARTITION BY source_id ORDER BY run_day) AS last_nonzero_at FROM run_history)"""
query("w02_zero_runs", _ZERO, "run_history")(lambda s, d: health.zero_runs(views.run_history(s, d), alert_at=3))
query("w03_heartbeat", f"""SELECT e.source_id, max(CASE WHEN ok THEN ts END) AS last_ok, max(CASE WHEN NOT ok THEN ts END) AS last_failure, count_if(NOT ok AND (ts, event_id) > (lo.t, lo.i))::BIGINT AS failures, max(CASE WHEN ok THEN ts END) < {AS_OF} - INTERVAL '7' DAY AS stale, count_if(NOT ok AND (ts, event_id) > (lo.t, lo.i)) >= 5 AS chronic
FROM source_events e JOIN (SELECT source_id, max(ts) AS t, arg_max(event_id, (ts, event_id)) AS i FROM source_events WHERE ok GROUP BY 1) lo ON lo.source_id = e.source_id GROUP BY 1""", "source_events")(lambda s, d: health.heartbeat(views.source_events(s, d)))
query("w04_zero_run_report", f"SELECT source_id, zeros, greatest(0, (SELECT count(*) FROM (SELECT source_id, arg_max(consecutive_zero_runs, run_day) AS zeros FROM ({_ZERO}) GROUP BY 1) WHERE zeros >= 1) - 30) AS omitted FROM (SELECT source_id, arg_max(consecutive_zero_runs, run_day) AS zeros FROM ({_ZERO}) GROUP BY 1) WHERE zeros >= 1 ORDER BY zeros DESC, source_id LIMIT 30", "run_history")(lambda s, d: health.zero_run_report(views.run_history(s, d)))
_corpus("w05_top_per_group", "SELECT uf, doc_id, rank FROM (SELECT uf, doc_id, row_number() OVER (PARTITION BY uf ORDER BY fetched_at DESC, doc_id) AS rank FROM corpus) WHERE rank <= 50", lambda c: health.top_per_group(c, "uf").select("uf", "doc_id", "rank"))
query("w06_admission_bound", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) <= 2 AS admitted FROM events")(lambda s, d: audit.admission_bound(views.requests(s, d), 2, 86400).select("event_id", "in_window", "admitted"))

# Admission in full: the SQL steps through every key's requests with the times that were admitted.
_ADMITTED = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_id, n, [us] AS held, TRUE AS admitted FROM e WHERE n = 1 UNION ALL
  SELECT user_id, event_id, n, CASE WHEN len(held) < 3 THEN list_append(held, us) ELSE held END, len(held) < 3 FROM
    (SELECT e.user_id, e.event_id, e.n, e.us, list_filter(s.held, lambda x: x >= e.us - 86400000000) AS held FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
SELECT event_id, admitted FROM s"""
query("w06_admission", _ADMITTED)(lambda s, d: audit.admit(views.requests(s, d), 3, 86400, 7 * 86400).select("event_id", "admitted"))
# The state machines as streams: what they give over a table that lands in two parts, with a restart between.
query("t05_admission_stream", _ADMITTED)(lambda s, d: replay(views.requests(s, d), "ts", lambda r: jobs.admission_stream(r, 3, 86400)).select("event_id", "admitted"))
query("t02_zero_run_stream", _ZERO, "run_history")(lambda s, d: replay(views.run_history(s, d), "run_day", lambda r: jobs.zero_run_stream(r, 3)))
_BREAKER = """RECURSIVE e AS (SELECT source_id, ok, ts, row_number() OVER (PARTITION BY source_id ORDER BY ts, event_id) AS n FROM source_events),
s AS (SELECT DISTINCT source_id, NULL::TIMESTAMP AS ts, FALSE AS ok, 0::BIGINT AS n, TRUE AS admitted, 'closed' AS state, 0 AS failures, TIMESTAMP '1970-01-01' AS opened FROM e UNION ALL
  SELECT source_id, ts, ok, n, admitted, CASE WHEN admitted AND ok THEN 'closed' WHEN trips THEN 'open' ELSE state END, CASE WHEN admitted AND ok THEN 0 WHEN admitted THEN failures + 1 ELSE failures END, CASE WHEN trips THEN ts ELSE opened END
  FROM (SELECT *, admitted AND NOT ok AND (state = 'half_open' OR failures + 1 >= 2) AS trips FROM (SELECT *, state <> 'open' AS admitted FROM
    (SELECT e.source_id, e.ts, e.ok, e.n, s.failures, s.opened, CASE WHEN s.state = 'open' AND e.ts - s.opened >= INTERVAL 6 HOUR THEN 'half_open' ELSE s.state END AS state FROM s JOIN e ON e.source_id = s.source_id AND e.n = s.n + 1))))
SELECT source_id, ts, ok, admitted, state, failures FROM s WHERE n > 0"""
query("t03_breaker_stream", f"WITH {_BREAKER.replace('RECURSIVE', 'RECURSIVE ' + views.SOURCE_EVENTS_SQL + ',', 1)}")(lambda s, d: replay(views.source_events(s, d), "ts", lambda r: jobs.breaker_stream(r, 2, 6.0)))


def _log(spark, d) -> DataFrame:
    """An audit log from all events: every user is an owner, entries without their links."""
    return views.table(spark, d, "events").select(F.concat(F.lit("o"), F.col("user_id")).alias("owner_id"), F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("action"), F.col("props").alias("payload"))


_FORM_OF = """'{"action":"' || event_type || '","entry_id":' || event_id || ',"owner_id":"o' || user_id || '","payload_hash":"' || sha256(props) || '","prev_hash":"@","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}'"""


@query("w07_w08_audit_chain", f"SELECT owner_id, len(forms) AS entries, 0::BIGINT AS broken, list_reduce(list_prepend(repeat('0', 64), forms), lambda p, x: sha256(replace(x, '@', p))) AS last_hash FROM (SELECT 'o' || user_id AS owner_id, list({_FORM_OF} ORDER BY ts, event_id) AS forms FROM events GROUP BY 1)")
def _w07(spark, d):
    none = spark.createDataFrame([], "owner_id string, last_hash string")
    chained = audit.verify(audit.append(_log(spark, d), none)).withColumn("hash", F.sha2(audit.canonical(), 256))
    return chained.groupBy("owner_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("valid")).alias("broken"), F.max_by("hash", F.struct("timestamp", "entry_id")).alias("last_hash"))


query("w09_alert_eligible", "SELECT id, coalesce(expected_min_items_per_week, CASE WHEN fragile THEN 1 END) AS expected, coalesce(coalesce(expected_min_items_per_week, CASE WHEN fragile THEN 1 END) > 0, false) AS eligible FROM sources", "sources")(lambda s, d: health.alert_eligible(views.sources(s, d)))

# Filters
_HAS = "regexp_matches({0}, '')"
_NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
_FOUND = "list_filter([{1}], lambda k: contains(" + _NORM.format("{0}") + ", trim(lower(k))))"
_lit = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_corpus("f01_keyword_match", f"SELECT doc_id, array_to_string({_FOUND.format('texto', _lit(KEYWORDS))}, '|') AS keywords FROM corpus WHERE len({_FOUND.format('texto', _lit(KEYWORDS))}) > 0", lambda c: filters.keyword_match(c, KEYWORDS).select("doc_id", F.array_join("keywords", "|").alias("keywords")))
_KWORG = f"""SELECT doc_id, list_distinct(CASE WHEN keywords_bypass THEN orgs ELSE list_concat(kws, orgs) END) AS f, trusted, source_tipo, titulo, texto, data_publicacao, content_hash FROM (
SELECT c.*, list_filter(org_mentions, lambda k: contains({_NORM.format("titulo || ' ' || texto")}, trim(lower(k)))) AS orgs, list_filter(CASE WHEN len(keywords_required) > 0 THEN keywords_required ELSE [{_lit(KEYWORDS)}] END, lambda k: contains({_NORM.format("titulo || ' ' || texto")}, trim(lower(k)))) AS kws, keywords_bypass, trusted
FROM corpus c JOIN sources s ON s.id = c.source_id) WHERE len(CASE WHEN keywords_bypass THEN orgs ELSE list_concat(kws, orgs) END) > 0"""


def _items(c: DataFrame) -> DataFrame:
    return c.select("doc_id", "source_id", "titulo", "texto", "url", "data_publicacao", "fetched_at", "content_hash")


_both("f03_keyword_or_org", f"SELECT doc_id, array_to_string(list_sort(f), '|') AS found FROM ({_KWORG})", lambda c, s: filters.keyword_or_org(_items(c), s, KEYWORDS).select("doc_id", F.array_join(F.array_sort("found"), "|").alias("found")))
_TOPN = lambda words: f"len(list_filter([{_lit(words)}], lambda k: contains({_NORM.format('texto')}, trim(lower(k)))))"
_corpus("f04_topics", "SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([" + ", ".join(f"{{'n': -{_TOPN(w)}, 'o': {i}, 't': '{t}'}}" for i, (t, w) in enumerate(TOPIC_WORDS.items())) + "], lambda r: r.n < 0)), lambda r: r.t), '|') AS topics FROM corpus", lambda c: c.select("doc_id", F.array_join(filters.topics_of(F.col("texto"), TOPIC_WORDS), "|").alias("topics")))
_corpus("f05_automaton", f"SELECT doc_id, array_to_string(list_sort(list_filter([{_lit(KEYWORDS)}], lambda k: contains(lower(texto), k))), '|') AS found FROM corpus", lambda c: filters.automaton_match(c, list(KEYWORDS)).select("doc_id", F.array_join("found", "|").alias("found")))
_SCORE = f"""0.35::DOUBLE * least(len(f) * 50.0::DOUBLE / greatest(1, len(regexp_extract_all(titulo || ' ' || texto, '\\S+'))), 1.0::DOUBLE) + 0.35::DOUBLE * CASE WHEN trusted THEN 1.0::DOUBLE WHEN source_tipo IN ('sefaz', 'assembleia', 'doe') THEN 0.7::DOUBLE WHEN source_tipo = 'jurisprudencia' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END
+ 0.2::DOUBLE * CASE WHEN data_publicacao IS NULL THEN 0.6::DOUBLE ELSE greatest(0.3::DOUBLE, 1 - greatest(0, floor((epoch_us({AS_OF}) - epoch_us(data_publicacao)) / 86400000000)) / 30::DOUBLE) END + 0.1::DOUBLE * 0"""
_both("f06_prescore", f"SELECT doc_id, round({_SCORE}, 9) AS score FROM ({_KWORG})", lambda c, s: filters.scored(filters.keyword_or_org(_items(c), s, KEYWORDS)).select("doc_id", F.round("score", 9).alias("score")))
_both("f07_cutoff", f"SELECT count(*) AS n, count_if(round({_SCORE}, 9) >= 0.5)::BIGINT AS n_pass FROM ({_KWORG})", lambda c, s: filters.scored(filters.keyword_or_org(_items(c), s, KEYWORDS)).agg(F.count(F.lit(1)).alias("n"), F.count_if(filters.passes(F.round("score", 9), 0.5)).alias("n_pass")))
_corpus("f08_unseen", "SELECT doc_id FROM corpus WHERE doc_id % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM corpus WHERE doc_id % 2 = 0)", lambda c: filters.unseen(c.where("doc_id % 2 = 1"), c.where("doc_id % 2 = 0")).select("doc_id"))
_corpus("f09_f11_routing", "SELECT doc_id, severity_tier, CASE severity_tier WHEN 'critico' THEN 'telegram' WHEN 'alta' THEN 'email|telegram' WHEN 'normal' THEN 'email|telegram' WHEN 'baixa' THEN 'email' ELSE '' END AS channels, CASE severity_tier WHEN 'critico' THEN 'immediate' WHEN 'alta' THEN 'daily' WHEN 'normal' THEN 'daily' WHEN 'baixa' THEN 'weekly' ELSE 'none' END AS period FROM corpus WHERE has_llm", lambda c: filters.routed(c.withColumn("severity_tier", filters.tier(F.col("relevancia")))).select("doc_id", "severity_tier", F.array_join("channels", "|").alias("channels"), "period"))
_both("f10_tier_override", "SELECT doc_id, CASE WHEN keywords_bypass AND severity_tier = 'normal' THEN 'baixa' ELSE severity_tier END AS tier FROM corpus JOIN sources ON id = source_id", lambda c, s: c.join(s.select(F.col("id").alias("source_id"), "keywords_bypass"), "source_id").select("doc_id", filters.tier_override(F.col("severity_tier"), F.col("keywords_bypass")).alias("tier")))


def _responses(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Batches of classified documents and their responses as JSON, some fenced, some wrapped, some damaged."""
    d = c.where("has_llm").withColumn("batch_id", F.expr("doc_id div 10"))
    batches = d.withColumn("pos", F.row_number().over(Window.partitionBy("batch_id").orderBy("doc_id")) - 1)
    one = F.struct((F.col("doc_id") % 4 != 3).alias("related"), F.lit("lei").alias("tipo"), "relevancia", F.lit("r").alias("resumo"), F.repeat(F.lit("x"), F.when(F.col("doc_id") % 13 == 0, 10).otherwise(50)).alias("resumo_completo"), F.array(F.lit("t")).alias("tags"), F.col("topics").alias("topics"))
    listed = batches.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("o")))), lambda x: x["o"]).alias("items"))
    raw = F.when(F.col("batch_id") % 5 == 0, F.concat(F.lit("```json\n"), F.to_json("items"), F.lit("\n```"))).when(F.col("batch_id") % 5 == 1, F.concat(F.lit('{"items": '), F.to_json("items"), F.lit("}"))).when(F.col("batch_id") % 5 == 2, F.to_json(F.slice("items", 1, F.size("items") - 1))).when(F.col("batch_id") % 5 == 3, F.lit("oops")).otherwise(F.to_json("items"))
    return listed.select("batch_id", raw.alias("raw")), batches.select("batch_id", "pos", "doc_id")


_corpus(
    "f12_response_validation",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN least(relevancia, 4) ELSE relevancia END AS relevancia, CASE WHEN doc_id % 4 = 3 THEN '' ELSE array_to_string(topics, '|') END AS topics FROM corpus
    WHERE has_llm AND (doc_id // 10) % 5 IN (0, 1, 4) AND NOT (doc_id % 4 <> 3 AND doc_id % 13 = 0)""",
    lambda c: filters.validated_responses(*_responses(c))[0].select("doc_id", "relevancia", F.array_join("topics", "|").alias("topics")),
)
_corpus(
    "f12_response_rejects",
    """SELECT reason, count(*) AS n FROM (SELECT DISTINCT doc_id // 10 AS b, CASE WHEN (doc_id // 10) % 5 = 2 THEN 'count_mismatch' ELSE 'parse_error' END AS reason FROM corpus WHERE has_llm AND (doc_id // 10) % 5 IN (2, 3)
    UNION ALL SELECT doc_id, 'resumo_completo' FROM corpus WHERE has_llm AND (doc_id // 10) % 5 IN (0, 1, 4) AND doc_id % 4 <> 3 AND doc_id % 13 = 0) GROUP BY 1""",
    lambda c: filters.validated_responses(*_responses(c))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
)
_corpus("f15_rule_classifier", "SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE least(10, 4 + 2 * n) END AS relevancia FROM (SELECT doc_id, " + " + ".join(f"({_TOPN(w)} > 0)::INT" for w in TOPIC_WORDS.values()).replace("(texto)", "(titulo || ' ' || texto)") + " AS n FROM corpus)", lambda c: filters.rule_classifier(c, TOPIC_WORDS).select("doc_id", F.size("topics").alias("n"), "relevancia"))
_corpus("f19_predicates", "SELECT doc_id, coalesce(relevancia >= 8, false) AS high_relevance, coalesce(aliquotas, '') <> '' AS has_aliquotas, doc_id % 4 = 0 AS has_revogacoes, doc_id % 8 = 0 AS has_modulacao, coalesce(tipo = 'view', false) AS is_tipo FROM corpus", lambda c: filters.document_predicates(c.withColumn("metadados", F.map_concat("metadados", F.map_filter(F.create_map(F.lit("revogacoes_citadas"), F.expr("CASE WHEN doc_id % 4 = 0 THEN '1/2000' END"), F.lit("modulacao_efeitos"), F.expr("CASE WHEN doc_id % 8 = 0 THEN 'true' WHEN doc_id % 8 = 1 THEN 'false' END")), lambda k, v: v.isNotNull()))), tipo="view"))
_HOSTS = ("https://10.0.0.5/x", "https://localhost/", "http://a.example.org/", "https://[::1]/", "https://8.8.8.8/", "https://[2606:4700::1111]/x", "https://user@192.168.1.1:8443/", "https://metadata.google.internal/")
query("f20_url_safety", "SELECT page_id, CASE WHEN page_id % 9 = 8 THEN regexp_matches(url, '^https://[^/]') AND length(url) <= 2048 ELSE page_id % 9 IN (4, 5) END AS safe FROM pages")(lambda s, d: views.table(s, d, "pages").select("page_id", protect.safe_url(F.when(F.col("page_id") % 9 == 8, F.col("url")).otherwise(F.get(F.array(*[F.lit(h) for h in _HOSTS]), (F.col("page_id") % 9).cast("int")))).alias("safe")))
_NETS = (("10.0.0.0/8", 167772160, 184549375), ("66.0.0.0/7", 1107296256, 1140850687), ("17.5.0.0/17", 285540352, 285573119), ("100.64.0.0/10", 1681915904, 1686110207))


def _networks(spark) -> DataFrame:
    return spark.createDataFrame([(n, *protect.cidr_bounds(n)) for n, _, _ in _NETS], "cidr string, lo long, hi long")


_LONG = "(split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT)"
query("f21_j09_t09_scanner_filter", f"SELECT event_id, agent, ip, token FROM triggers WHERE NOT regexp_matches(agent, 'Slackbot|curl/') AND NOT (" + " OR ".join(f"{_LONG} BETWEEN {lo} AND {hi}" for _, lo, hi in _NETS) + ")", "triggers")(lambda s, d: jobs.trigger_filter(views.triggers(s, d), "Slackbot|curl/", _networks(s)).select("event_id", "agent", "ip", "token"))
query("f22_injection", "SELECT page_id, " + ", ".join(f"regexp_matches(html, {same(p)}) AS {k}" for k, p in protect.INJECTION.items()) + " FROM pages")(lambda s, d: views.table(s, d, "pages").select("page_id", protect.injection_flags(F.col("html")).alias("m")).select("page_id", *[F.col("m")[k].alias(k) for k in protect.INJECTION]))
on_notices("f22_injection_types", "SELECT doc_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(notice, {same(p)}) THEN '{k}' END" for k, p in protect.INJECTION.items()) + "], lambda x: x IS NOT NULL)), '|') AS types FROM (SELECT doc_id, nfc_normalize(notice) AS notice FROM notices)", lambda n: n.select("doc_id", F.array_join(protect.injection_types(F.col("notice")), "|").alias("types")))
_MASKED = reduce(lambda c, p: f"regexp_replace({c}, {same(p[0])}, '{p[1]}', 'g')", protect.PII, "notice")
on_notices("f23_has_pii", "SELECT doc_id, " + " OR ".join(f"regexp_matches(notice, {same(p)})" for p, _ in protect.PII) + " AS has_pii FROM notices", lambda n: n.select("doc_id", protect.has_pii(F.col("notice")).alias("has_pii")))
on_notices("d17_redact_pii", f"SELECT doc_id, md5({_MASKED}) AS redacted FROM notices", lambda n: n.select("doc_id", F.md5(protect.redact_pii(F.col("notice"))).alias("redacted")))
_WITHOUT_TOKENS = reduce(lambda c, p: f"regexp_replace({c}, {same(p[0])}, '{p[1]}', 'g')", protect.TOKENS, "notice")
on_notices("d18_redact_tokens", f"SELECT doc_id, md5({_WITHOUT_TOKENS}) AS redacted FROM notices", lambda n: n.select("doc_id", F.md5(protect.redact_tokens(F.col("notice"))).alias("redacted")))
on_notices("d19_masked_map", f"SELECT doc_id, '***REDACTED***' AS api_key, md5({_WITHOUT_TOKENS}) AS note FROM notices", lambda n: n.select("doc_id", protect.mask_map(F.create_map(F.lit("API_Key"), "source_id", F.lit("note"), "notice")).alias("m")).select("doc_id", F.col("m")["API_Key"].alias("api_key"), F.md5(F.col("m")["note"]).alias("note")))
_corpus("d21_age", f"SELECT doc_id, round((epoch_us({AS_OF}) - epoch_us(coalesce(data_publicacao, fetched_at))) / 86400000000.0::DOUBLE, 6) AS age FROM corpus", lambda c: c.select("doc_id", F.round(text.age_days(text.effective_date(), analytics.moment(analytics.AS_OF)), 6).alias("age")))
_corpus("f25_model_errors", "SELECT doc_id, CASE WHEN length(titulo) BETWEEN 1 AND 500 THEN '' ELSE 'titulo' END AS errors FROM corpus", lambda c: filters.model_errors(c).select("doc_id", F.array_join("errors", "|").alias("errors")))

# Search
_FORM = "trim(regexp_replace(lower(strip_accents({})), '\\s+', ' ', 'g'))"
_MAPS = "array_to_string(list_filter([CASE WHEN numero_ato IS NOT NULL THEN 'numero_ato ' || numero_ato END, CASE WHEN aliquotas IS NOT NULL THEN 'aliquotas ' || aliquotas END, CASE WHEN valores_monetarios IS NOT NULL THEN 'valores_monetarios ' || valores_monetarios END, CASE WHEN temas_especificos IS NOT NULL THEN 'temas_especificos ' || temas_especificos END], lambda x: x IS NOT NULL), chr(10))"
_TEXT = _FORM.format(f"concat_ws(chr(10), doc_id, titulo, source_id, uf, array_to_string(topics, ' '), array_to_string(user_tags, ' '), tipo, severity_tier, resumo, array_to_string(tags, ' '), {_MAPS}, url, texto, strftime(coalesce(data_publicacao, fetched_at), '%Y-%m-%d'))")
_corpus("x02_corpus_text", f"SELECT doc_id, md5({_TEXT}) AS form FROM corpus", lambda c: c.select("doc_id", F.md5(search.corpus_text()).alias("form")))
_SEARCH = f"(SELECT *, {_TEXT} AS ctext FROM corpus)"
_TERMS = "list_distinct(list_concat(list_filter([lower(source_id), lower(uf), tipo, severity_tier], lambda x: x IS NOT NULL), coalesce(topics, []), coalesce(user_tags, []), list_transform(regexp_extract_all(ctext, '\\d{1,6}/\\d{4}|[0-9A-Za-z_À-ÿ]{3,}'), lambda x: substr(x, 1, 64))))"
_corpus("x03_index_terms", f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), '|')) AS terms FROM (SELECT doc_id, {_TERMS} AS t FROM {_SEARCH})", lambda c: search.indexed(c).select("doc_id", F.size("terms").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("terms"), "|")).alias("terms")))
_corpus("x04_stored_or_built", f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE ctext END) AS form FROM {_SEARCH}", lambda c: c.select("doc_id", F.md5(search.stored_or_built(F.expr("CASE doc_id % 4 WHEN 1 THEN '' WHEN 3 THEN NULL ELSE 'kept' END"))).alias("form")))
_corpus("x06_indexed_search", f"SELECT doc_id FROM {_SEARCH} WHERE status <> 'archived' AND contains(ctext, 'favorito') AND contains(ctext, 'en') AND list_contains(user_tags, 'favorito') ORDER BY fetched_at DESC, doc_id LIMIT 50", lambda c: search.indexed_search(c, search.indexed(c), ["favorito", "en"]).select("doc_id"))
def _postings_search(c: DataFrame) -> DataFrame:
    """The search over an index of all documents, built first."""
    path = scratch(c.sparkSession, "postings")
    postings.build(c, path)
    return postings.search(c.sparkSession, path, ["favorito", "en"]).select("doc_id")


_corpus("x06_postings_search", f"SELECT doc_id FROM {_SEARCH} WHERE status <> 'archived' AND contains(ctext, 'favorito') AND contains(ctext, 'en') AND list_contains(user_tags, 'favorito') ORDER BY fetched_at DESC, doc_id LIMIT 50", _postings_search)
_corpus("x07_scan_search", f"SELECT doc_id FROM {_SEARCH} WHERE contains(ctext, 'tion') AND contains(ctext, 'the') ORDER BY fetched_at DESC, doc_id LIMIT 50", lambda c: search.scan_search(c, ["Tion", "the"]).select("doc_id"))
_corpus("x08_faceted_search", f"SELECT doc_id FROM corpus WHERE uf = 'EN' AND relevancia >= 5 AND llm_model = 'm1' AND {early('eff_date', 7)} ORDER BY doc_id LIMIT 50", lambda c: search.faceted_search(c, uf="EN", least_relevance=5, model="m1", period="1w", as_of=EARLY).select("doc_id"))
_corpus("x10_boolean_search", f"SELECT doc_id FROM {_SEARCH} WHERE (contains(ctext, 'license') OR contains(ctext, 'ration')) AND NOT contains(ctext, 'zu') ORDER BY doc_id LIMIT 50", lambda c: search.boolean_search(c, "license OR ration AND NOT zu").select("doc_id"))
_corpus("x10_phrases", f"SELECT doc_id FROM {_SEARCH} WHERE (contains(ctext, 'nd to the') OR contains(ctext, 'ration of')) AND contains(ctext, 'the') AND NOT contains(ctext, 'license') ORDER BY doc_id LIMIT 50", lambda c: search.boolean_search(c, "nd to the OR ration of and the not license").select("doc_id"))
_corpus("x11_fuzzy_titles", None, lambda c: search.similar_titles(c, "the and attion to thanedble the, anea. eriner thanea. thntblere of then, edtioner in", 0.7).select("doc_id", "titulo", "ratio"))
_corpus("x12_more_like", None, lambda c: search.more_like(c, 11).select("doc_id", "titulo", "ratio"))
_corpus("x13_regex_search", f"SELECT doc_id FROM {_SEARCH} WHERE regexp_matches(ctext, 'nd (of|to) the') ORDER BY doc_id LIMIT 50", lambda c: search.regex_search(c, "nd (of|to) the").select("doc_id"))
_corpus("x14_highlight", "SELECT doc_id, md5(regexp_replace(titulo, '(the)', '**\\1**', 'gi')) AS marked FROM corpus", lambda c: c.select("doc_id", F.md5(search.highlight(F.col("titulo"), "the")).alias("marked")))
_ACTS = "CASE doc_id % 3 WHEN 0 THEN 'Lei nº 5.234 / 2024, ' || texto WHEN 1 THEN texto || ' Decreto 77-2023' ELSE texto END"
_corpus("x15_act_number", f"SELECT doc_id, CASE WHEN m[2] = '' THEN '' ELSE substr(replace(m[2], '.', '') || '/' || m[3], 1, 32) END AS act FROM (SELECT doc_id, list_value('', regexp_extract({_ACTS}, {same(text.ACT_NOTATION)}, 1), regexp_extract({_ACTS}, {same(text.ACT_NOTATION)}, 2)) AS m FROM corpus)", lambda c: c.select("doc_id", text.act_number(F.expr(_ACTS)).alias("act")))
_corpus("x16_ranked_search", f"SELECT doc_id FROM {_SEARCH} WHERE contains(ctext, 'ing') AND year(fetched_at) = 2024 AND list_contains(topics, 'itcd') ORDER BY coalesce(relevancia, 0) DESC, fetched_at DESC, doc_id LIMIT 20", lambda c: search.ranked_search(c, ["ing"], year=2024, topic="itcd", limit=20).select("doc_id"))
_corpus("x17_archive", "SELECT doc_id FROM corpus WHERE strftime(data_publicacao, '%Y-%m') = '2024-01' AND uf = 'FR'", lambda c: search.archive(c, "2024-01", "FR").select("doc_id"))
_corpus("x18_favourites", "SELECT doc_id FROM corpus WHERE list_contains(user_tags, 'favorito') ORDER BY fetched_at DESC, doc_id LIMIT 20", lambda c: search.favourites(c).select("doc_id"))
_both("x19_bypass_listing", f"SELECT doc_id, greatest(0, (SELECT count(*) FROM corpus WHERE {since('eff_date', 30)} AND source_id IN (SELECT id FROM sources WHERE keywords_bypass)) - 30) AS omitted FROM corpus WHERE {since('eff_date', 30)} AND source_id IN (SELECT id FROM sources WHERE keywords_bypass) ORDER BY eff_date DESC, doc_id LIMIT 30", lambda c, s: search.bypass_listing(c, s).select("doc_id", "omitted"))
_corpus("s24_l02_page", "SELECT doc_id FROM corpus WHERE status = 'classified' ORDER BY fetched_at DESC, doc_id LIMIT 50 OFFSET 20", lambda c: search.page(c, status="classified", offset=20, limit=50).select("doc_id"))

# Sources and joins
query("s03_source_selection", "SELECT id FROM sources WHERE (CASE WHEN id = 'src3' THEN false WHEN id = 'src19' THEN true ELSE ativo END) AND (uf IN ('EN', 'FR') OR uf = '_federal')", "sources")(lambda s, d: catalog.select_sources(views.sources(s, d), s.createDataFrame([("src3", False), ("src19", True)], "id string, ativo boolean"), s.createDataFrame([("EN",), ("FR",)], "uf string")).select("id"))
query("s04_source_lint", """SELECT id, array_to_string(w, '|') AS warnings FROM (SELECT id, list_filter([CASE WHEN contains(url, '.gov.br') AND NOT starts_with(url, 'https://') THEN 'gov_url_not_https' END, CASE WHEN len(keywords_required) > 0 AND NOT contains(upper(array_to_string(keywords_required, ' ')), 'ITCD') THEN 'keywords_without_core' END,
CASE WHEN len(topics) = 0 THEN 'no_topics' END, CASE WHEN fragile AND coalesce(notas, '') = '' THEN 'fragile_without_notes' END], lambda x: x IS NOT NULL) AS w FROM sources) WHERE len(w) > 0""", "sources")(lambda s, d: catalog.lint(views.sources(s, d)).select("id", F.array_join("warnings", "|").alias("warnings")))
def _archives(spark, d) -> DataFrame:
    """The documents as zipped XML of their sources, five hundred ids each; the executors zip them."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = views.table(spark, d, "documents").select("doc_id", "source", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ").alias("text"))
    one = F.concat(F.expr("concat('<propositura><IdDocumento>', doc_id, '</IdDocumento><Natureza>', CASE doc_id % 3 WHEN 0 THEN 'REQ' ELSE 'PL' END, '</Natureza><NroLegislativo>', doc_id, '</NroLegislativo><AnoLegislativo>2024</AnoLegislativo><Ementa>')"), esc(F.col("text")), F.expr("concat('</Ementa><DtEntradaSistema>', CASE doc_id % 4 WHEN 1 THEN '2023-06-01' ELSE '2024-01-15' END, '</DtEntradaSistema></propositura>')"))
    xml = t.groupBy("source", F.expr("doc_id div 500").alias("n")).agg(F.array_join(F.collect_list(one), "").alias("rows")).select("source", F.concat(F.lit("<r>"), "rows", F.lit("</r>")).alias("xml"))

    def zip_up(batches):
        for b in batches:
            out = []
            for x in b.column("xml").to_pylist():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("dump.xml", x)
                out.append(buffer.getvalue())
            yield pa.record_batch([b.column("source"), pa.array(out, pa.binary())], names=["source_id", "content"])

    return xml.mapInArrow(zip_up, "source_id string, content binary").withColumn("fetched_at", F.lit("2024-01-31").cast("timestamp"))


query("s16_zipped_xml", "SELECT 'alesp' AS source_id, 'PL ' || doc_id || '/2024' AS titulo, sha256('alesp:' || doc_id) AS content_hash, length(trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'))) AS n FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1")(
    lambda s, d: payloads.map_xml(zipped.zipped_records(_archives(s, d), "propositura", ["IdDocumento", "Natureza", "NroLegislativo", "AnoLegislativo", "Ementa", "DtEntradaSistema", "DtPublicacao"], {"Natureza": ["PL"]}, ("DtEntradaSistema", "2024-01-01"))[0], "alesp", "alesp", "2024-01-31").select("source_id", "titulo", "content_hash", F.length("texto").cast("long").alias("n"))
)
query("s06_page_links", None)(lambda s, d: payloads.links_of(views.table(s, d, "pages")))
def _listing(spark, d) -> DataFrame:
    """The documents as listing pages of their sources, fifty ids each: nested and unclosed elements, whole texts, relative addresses,
    and rows that aren't items."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = views.table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    link = F.expr("concat(CASE doc_id % 5 WHEN 0 THEN '/d/' WHEN 1 THEN 'd/' WHEN 2 THEN 'https://other.org/' WHEN 3 THEN 'javascript:' ELSE '?q=' END, doc_id)")
    head = F.concat(F.lit('<li class="x row"><h3>'), esc(F.substring("text", 1, 10)), F.lit("<b>"), esc(F.substring("text", 11, 30)), F.lit("</b></h3><p>"), esc(F.col("text")))
    row = F.concat(head, F.expr("CASE doc_id % 4 WHEN 0 THEN '<span>' ELSE '</p>' END"), F.lit('<div><a class="go" rel=x href="'), link, F.lit('">more</a>'), F.expr("CASE doc_id % 3 WHEN 0 THEN '</div></li>' WHEN 1 THEN '</div>' ELSE '</section>' END"))
    page = t.groupBy("source", F.expr("doc_id div 50").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    html = F.concat(F.lit('<html><ul class="nav"><li class="row"><h3>no</h3><a class="go" href="/no">x</a></ul><ul class="items">'), "rows", F.lit('</ul><li class="row"><h3>no</h3><a class="go" href="/no">y</a>'))
    return page.select(F.col("source").alias("source_id"), F.lit("2024-01-31").cast("timestamp").alias("fetched_at"), F.concat(F.lit("https://"), "source", F.lit(".example.org/list/"), "n", F.lit(".html")).alias("url"), html.alias("html"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NAME = _STRIP.format("substr(text, 1, 10)") + " || " + _STRIP.format("substr(text, 11, 30)")
_AT = "'https://' || source || '.example.org'"
query("s06_selected_items", f"SELECT source AS source_id, {_NAME} AS titulo, CASE doc_id % 5 WHEN 0 THEN {_AT} || '/d/' || doc_id WHEN 1 THEN {_AT} || '/list/d/' || doc_id WHEN 2 THEN 'https://other.org/' || doc_id ELSE {_AT} || '/list/' || (doc_id // 50) || '.html?q=' || doc_id END AS url FROM documents WHERE doc_id % 5 <> 3 AND {_NAME} <> ''")(
    lambda s, d: selectors.selected_items(_listing(s, d), views.table(s, d, "documents").select(F.col("source").alias("source_id"), F.lit("ul.items > li.row").alias("item"), F.lit("h3").alias("titulo"), F.lit("li a.go@href").alias("link")).distinct())[0].select("source_id", "titulo", "url")
)
query("s19_sanitize_html", None)(lambda s, d: payloads.html_items(views.table(s, d, "pages"))[0])


def _payloads(spark, d) -> DataFrame:
    """The corpus as landed JSON payloads: ten documents each, in the shape of one family."""
    c = views.table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), F.col("text").alias("t"))
    one = F.struct(F.col("doc_id").alias("id"), F.lit("PL").alias("siglaTipo"), F.col("doc_id").alias("numero"), F.lit(2024).alias("ano"), F.col("t").alias("ementa"), F.when(F.col("doc_id") % 3 != 0, F.lit("2024-01-15")).alias("dataApresentacao"))
    p = c.groupBy("source_id", F.expr("doc_id div 200").alias("g")).agg(F.collect_list(one).alias("x"))
    body = F.when(F.col("g") % 4 == 3, F.lit("<html>")).otherwise(F.concat(F.lit('{"dados": '), F.to_json("x"), F.lit("}")))
    return p.select("source_id", F.lit("2024-01-31").cast("timestamp").alias("fetched_at"), F.lit("https://x.example.org").alias("base_url"), body.alias("body"))


query("s09_json_mapping", "SELECT source AS source_id, 'PL ' || doc_id || '/2024' AS titulo, sha256('camara:' || doc_id) AS content_hash, md5(text) AS texto, CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-15 00:00:00' END AS data_publicacao FROM documents WHERE (doc_id // 200) % 4 <> 3")(lambda s, d: payloads.map_json(_payloads(s, d), payloads.MAPPINGS["camara"])[0].select("source_id", "titulo", "content_hash", F.md5("texto").alias("texto"), "data_publicacao"))
query("s01_raw_items", "SELECT doc_id, sha256(source || '|' || 'https://' || source || '.example.org/' || doc_id || '|' || replace(substr(text, 1, 80), chr(10), ' ')) AS content_hash FROM documents")(lambda s, d: views.table(s, d, "documents").select("doc_id", *payloads.raw_item(F.col("source"), F.expr("replace(substr(text, 1, 80), '\n', ' ')"), F.expr("concat('https://', source, '.example.org/', doc_id)"), F.col("text"), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))).select("doc_id", "content_hash"))
_both("j01_item_source", "SELECT doc_id, trusted, s.tipo AS tipo_fonte FROM corpus c JOIN sources s ON s.id = c.source_id", lambda c, s: c.select("doc_id", "source_id").join(s.select(F.col("id").alias("source_id"), "trusted", F.col("tipo").alias("tipo_fonte")), "source_id").select("doc_id", "trusted", "tipo_fonte"))
query("j03_active_sources", "SELECT id FROM sources WHERE uf IN ('EN', 'FR')", "sources")(lambda s, d: views.sources(s, d).join(s.createDataFrame([("EN",), ("FR",)], "uf string"), "uf", "left_semi").select("id"))
_SHORT = _FORM.format("concat_ws(' ', titulo, resumo)")
query("j04_f18_watch_matches", f"""SELECT 'w1' AS watch_id, doc_id FROM corpus WHERE contains({_SHORT}, 'ration') UNION ALL SELECT 'w3', doc_id FROM {_SEARCH} WHERE regexp_matches(ctext, 'nd (of|to) ') AND (relevancia IS NULL OR relevancia >= 7) UNION ALL SELECT 'w4', doc_id FROM corpus WHERE numero_ato = '12/2024'
UNION ALL SELECT 'w2', doc_id FROM corpus WHERE uf = 'EN' AND contains({_SHORT}, 'the') AND (relevancia IS NULL OR relevancia >= 5) UNION ALL SELECT 'w6', doc_id FROM corpus WHERE uf = 'EN' AND list_contains(topics, 'sucessoes') AND (relevancia IS NULL OR relevancia >= 3) UNION ALL SELECT 'w8', doc_id FROM corpus WHERE numero_ato = '9/2024' AND uf = 'DE'""", "corpus")(lambda s, d: watches.matches(views.corpus(s, d), views.watches(s)))
# Matches as events of their documents' dates: a watch fires unless it did within six hours.
_FIRED = ORACLE_SQL["j04_f18_watch_matches"].removeprefix("WITH ")
_CUT = _FIRED.index("SELECT 'w1'")


def _hits(spark, d) -> DataFrame:
    c = views.corpus(spark, d)
    return watches.matches(c, views.watches(spark)).join(c.select("doc_id", F.col("fetched_at").alias("ts")), "doc_id").select("watch_id", "doc_id", "ts", F.lit(6).alias("cooldown_hours"))


query("t06_watch_stream", f"""WITH RECURSIVE {_FIRED[:_CUT]}, m AS ({_FIRED[_CUT:]}), e AS (SELECT m.watch_id, m.doc_id, c.fetched_at AS ts, row_number() OVER (PARTITION BY m.watch_id ORDER BY c.fetched_at, m.doc_id) AS n FROM m JOIN corpus c ON c.doc_id = m.doc_id),
s AS (SELECT watch_id, doc_id, ts, n, TRUE AS fires, ts AS at FROM e WHERE n = 1 UNION ALL SELECT e.watch_id, e.doc_id, e.ts, e.n, e.ts - s.at >= INTERVAL 6 HOUR, CASE WHEN e.ts - s.at >= INTERVAL 6 HOUR THEN e.ts ELSE s.at END FROM s JOIN e ON e.watch_id = s.watch_id AND e.n = s.n + 1)
SELECT watch_id, doc_id, ts FROM s WHERE fires""")(lambda s, d: replay(_hits(s, d), "ts", jobs.trigger_stream))
_both("j05_silent_sources", f"SELECT s.id AS source_id, ativo, coalesce(n, 0) AS n, last_seen, last_seen IS NULL OR NOT ({since('last_seen', 7)}) AS silent FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n, max(fetched_at) AS last_seen FROM corpus GROUP BY 1) b ON b.source_id = s.id", health.silent_sources)

# Clusters
_acted = lambda c: c.withColumn("titulo", F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('Lei nº ', doc_id % 15, '/2024 ', titulo) ELSE titulo END"))  # noqa: E731  a third of the titles name an act
_corpus("c02_cluster_key", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'numato:' || doc_id % 15 || '/2024' ELSE 'url:' || url END AS cluster_key FROM corpus", lambda c: _acted(c).select("doc_id", clusters.cluster_key().alias("cluster_key")))
_corpus("c03_clusters", None, lambda c: clusters.assign_clusters(c.select("doc_id", "titulo", "url", "content_hash")).select("doc_id", "cluster_id"))
_corpus("c04_duplicate_flags", "SELECT doc_id, content_hash IN (SELECT content_hash FROM corpus WHERE doc_id % 4 = 0) AS same_hash, doc_id % 3 = 0 AND doc_id % 15 IN (SELECT doc_id % 15 FROM corpus WHERE doc_id % 4 = 0 AND doc_id % 3 = 0) AS same_key FROM corpus WHERE doc_id % 4 <> 0", lambda c: clusters.duplicate_flags(_acted(c).where("doc_id % 4 <> 0"), _acted(c).where("doc_id % 4 = 0")).select("doc_id", "same_hash", "same_key"))
_THEME = "SELECT array_to_string(list_sort(topics), '+') AS topics, coalesce(numero_ato, '_') AS numero, string_agg(DISTINCT uf, '|' ORDER BY uf) AS ufs, count(*) AS n FROM corpus WHERE len(topics) > 0 GROUP BY 1, 2"
_flat = lambda g: g.select("topics", "numero", F.array_join("ufs", "|").alias("ufs"), "n")
_corpus("c07_thematic_clusters", _THEME, lambda c: _flat(clusters.thematic(c)))
_corpus("c08_multi_region", f"SELECT * FROM ({_THEME}) WHERE contains(ufs, '|')", lambda c: _flat(clusters.multi_region(clusters.thematic(c))))

# Tables
def _upserted(c: DataFrame) -> DataFrame:
    """A batch of the even documents, classified anew, some with another title, into a table of those that three doesn't divide."""
    batch = c.where("doc_id % 2 = 0").withColumn("relevancia", F.lit(99)).withColumn("titulo", F.expr("CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE titulo END"))
    table, conflicts = tables.upsert(c.where("doc_id % 3 <> 0"), batch)
    return table.select(F.lit("table").alias("part"), "doc_id", "relevancia").unionByName(conflicts.select(F.lit("conflict").alias("part"), "doc_id", F.lit(None).cast("int").alias("relevancia")))


_corpus("k01_upsert", "SELECT 'table' AS part, doc_id, CASE WHEN doc_id % 3 = 0 THEN 99 ELSE relevancia END AS relevancia FROM corpus WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0 UNION ALL SELECT 'conflict', doc_id, NULL FROM corpus WHERE doc_id % 10 = 0 AND doc_id % 3 <> 0", _upserted)
_corpus("k02_replace_classification", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 10 ELSE relevancia END AS relevancia FROM corpus", lambda c: tables.replace_classification(c, c.where("doc_id % 2 = 0").select("doc_id", F.lit(10).alias("relevancia"))).select("doc_id", "relevancia"))
_corpus("k03_set_status", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'notified' ELSE status END AS status FROM corpus", lambda c: tables.set_status(c, c.where("doc_id % 5 = 0").select("doc_id", F.lit("notified").alias("status"))).select("doc_id", "status"))
_corpus("k04_tags", "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'estrela|novo' ELSE 'novo' END AS user_tags FROM corpus", lambda c: tables.add_tag(tables.remove_tag(tables.rename_tag(c, "favorito", "estrela"), "lido"), "novo").select("doc_id", F.array_join("user_tags", "|").alias("user_tags")))
_corpus("k05_reindex", f"SELECT doc_id, 2 AS index_version, md5({_TEXT}) AS form FROM corpus", lambda c: tables.reindex(c, search.indexed(c).withColumn("index_version", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1))).select("doc_id", "index_version", F.md5("text").alias("form")))
_corpus("k06_retention", f"SELECT 'discarded' AS rule, count(*) AS n FROM corpus WHERE severity_tier = 'descartado' AND fetched_at < {AS_OF} - INTERVAL '10' DAY HAVING count(*) > 0 UNION ALL SELECT 'pending', count(*) FROM corpus WHERE status = 'pending' AND fetched_at < {AS_OF} - INTERVAL '20' DAY HAVING count(*) > 0", lambda c: tables.retention(c, rules=(("discarded", "severity_tier = 'descartado'", 10), ("pending", "status = 'pending'", 20)))[1])
_corpus("k10_csv_rows", "SELECT doc_id, source_id, uf, titulo, url, data_publicacao, fetched_at, tipo, relevancia, severity_tier, resumo, array_to_string(tags, ' | ') AS tags, array_to_string(topics, ' | ') AS topics FROM corpus", tables.csv_rows)
_corpus("k11_json_rows", "SELECT doc_id, source_id, uf, titulo, url, data_publicacao, fetched_at, tipo, relevancia, severity_tier, resumo, array_to_string(coalesce(tags, []), '|') AS tags, array_to_string(coalesce(topics, []), '|') AS topics, status, numero_ato, llm_model, prompt_version FROM corpus", lambda c: tables.json_rows(c).withColumn("tags", F.array_join("tags", "|")).withColumn("topics", F.array_join("topics", "|")).withColumn("numero_ato", F.col("metadados")["numero_ato"]).drop("metadados"))
def _longer(c: DataFrame) -> DataFrame:
    """The corpus with the classification's longer texts and lists, made of the documents' own."""
    return c.withColumn("resumo_completo", F.expr("CASE WHEN has_llm AND doc_id % 3 = 0 THEN texto END")).withColumn("motivo_relevancia", F.expr("CASE WHEN has_llm THEN concat('m', doc_id % 9) END")).withColumn("contexto", F.expr("CASE WHEN has_llm AND doc_id % 2 = 0 THEN resumo END")).withColumn("pontos_chave", F.expr("CASE WHEN has_llm THEN slice(split(texto, '\n'), 1, 3) END")).withColumn("assuntos_relacionados", F.col("topics"))


_LONG_DOCS = "(SELECT c.*, coalesce(s.nome, c.source_id) AS fonte, CASE WHEN has_llm AND doc_id % 3 = 0 THEN texto END AS longer, CASE WHEN has_llm THEN 'm' || doc_id % 9 END AS why, CASE WHEN has_llm AND doc_id % 2 = 0 THEN resumo END AS around, CASE WHEN has_llm THEN string_split(texto, chr(10))[1:3] END AS points FROM corpus c LEFT JOIN sources s ON s.id = c.source_id)"
_ISO = "strftime(data_publicacao, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(data_publicacao) % 1000000 > 0 THEN strftime(data_publicacao, '.%f') ELSE '' END || '+00:00'"
_told = lambda labels, c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
_both("k10_csv_export", f"SELECT doc_id::VARCHAR AS doc_id, uf, coalesce(tipo, '') AS tipo, coalesce(severity_tier, '') AS tier, coalesce(relevancia::VARCHAR, '') AS relevancia, coalesce({_ISO}, '') AS data_pub, fonte, titulo, url, coalesce(resumo, '') AS resumo, md5(coalesce(longer, '')) AS resumo_completo, md5(coalesce(array_to_string(points, ' | '), '')) AS pontos_chave, coalesce(array_to_string(topics, ' | '), '') AS assuntos_relacionados FROM {_LONG_DOCS}",
    lambda c, s: exports.csv_export(_longer(c), s).withColumn("resumo_completo", F.md5("resumo_completo")).withColumn("pontos_chave", F.md5("pontos_chave")))
_both("k11_json_export", f"SELECT doc_id, uf, fonte, url, titulo, {_ISO} AS data_publicacao, tipo, severity_tier, relevancia, resumo, md5(longer) AS resumo_completo, len(coalesce(points, [])) AS pontos_chave, why AS motivo_relevancia, array_to_string(coalesce(topics, []), '|') AS assuntos_relacionados, array_to_string(coalesce(tags, []), '|') AS tags, array_to_string(coalesce(topics, []), '|') AS topics, coalesce(numero_ato, '') AS metadados_extraidos, md5(array_to_string(list_sort({_TERMS}), '|')) AS search_terms FROM (SELECT *, {_TEXT} AS ctext FROM {_LONG_DOCS})",
    lambda c, s: exports.json_export(_longer(c), s, search.indexed(c)).withColumn("resumo_completo", F.md5("resumo_completo")).withColumn("pontos_chave", F.size("pontos_chave").cast("long")).withColumn("assuntos_relacionados", F.array_join("assuntos_relacionados", "|")).withColumn("tags", F.array_join("tags", "|")).withColumn("topics", F.array_join("topics", "|")).withColumn("metadados_extraidos", F.coalesce(F.col("metadados_extraidos")["numero_ato"], F.lit(""))).withColumn("search_terms", F.md5(F.array_join(F.array_sort("search_terms"), "|"))))
_both("d24_digest_items", f"SELECT doc_id, titulo, url, md5(coalesce(nullif(longer, ''), resumo, '')) AS resumo, coalesce(resumo, '') AS resumo_curto, uf, {_told(exports.TYPE_LABELS, 'tipo')} ELSE coalesce(tipo, 'Outro') END AS tipo_label, {_told(exports.TIER_SIGNS, 'severity_tier')} ELSE '⚪' END AS tier_emoji, {_told(exports.TIER_LABELS, 'severity_tier')} ELSE '—' END AS tier_label, {_told(exports.TIER_COLOURS, 'severity_tier')} ELSE '#1976d2' END AS tier_color, coalesce(strftime(data_publicacao, '%d/%m/%Y'), '') AS data_pub, fonte AS fonte_nome, coalesce(relevancia::VARCHAR, '—') AS relevancia, md5(coalesce(array_to_string(points, ' · '), '')) AS pontos_chave, coalesce(why, '') AS motivo_relevancia, coalesce(around, '') AS contexto, coalesce(array_to_string(topics, ', '), '') AS assuntos_relacionados, coalesce(array_to_string(topics, ', '), '') AS topics FROM {_LONG_DOCS}",
    lambda c, s: exports.digest_items(_longer(c), s).withColumn("resumo", F.md5("resumo")).withColumn("pontos_chave", F.md5("pontos_chave")))
_corpus("k12_feeds", "SELECT 'uf/' || uf AS feed, doc_id FROM (SELECT uf, doc_id, row_number() OVER (PARTITION BY uf ORDER BY fetched_at DESC, doc_id) AS r FROM corpus) WHERE r <= 50 UNION ALL SELECT 'tipo/' || tipo, doc_id FROM (SELECT tipo, doc_id, row_number() OVER (PARTITION BY tipo ORDER BY fetched_at DESC, doc_id) AS r FROM corpus WHERE tipo IS NOT NULL) WHERE r <= 50 UNION ALL SELECT * FROM (SELECT 'relevantes', doc_id FROM corpus WHERE relevancia >= 7 ORDER BY fetched_at DESC, doc_id LIMIT 50)", lambda c: tables.feeds(c).select("feed", "doc_id"))
_corpus("k13_exported_since", "SELECT doc_id FROM corpus WHERE CAST(fetched_at AS DATE) >= DATE '2024-01-03'", lambda c: tables.exported_since(c, "2024-01-03").select("doc_id"))
_corpus("k16_clean_keywords", "SELECT min(doc_id) AS pos, arg_min(kw, doc_id) AS kw FROM (SELECT doc_id, trim(regexp_replace(tags[1], '\\s+', ' ', 'g')) AS kw FROM corpus WHERE len(tags) > 0) WHERE length(kw) BETWEEN 1 AND 80 GROUP BY lower(kw)", lambda c: tables.clean_keywords(c.where("size(tags) > 0").select(F.col("doc_id").alias("pos"), F.col("tags")[0].alias("kw"))))
# Configuration by commands, made of the events.
_VERB = "CASE WHEN value < 20 THEN 'delete' ELSE 'save' END"
_SETTING = "CASE event_id % 3 WHEN 0 THEN 'state' WHEN 1 THEN 'topic' ELSE 'watch' END AS kind, CASE WHEN event_id % 3 = 1 AND event_id % 7 = 0 THEN 'itcd' ELSE 'k' || user_id % 50 END AS key"
_MUTE = "CASE event_id % 4 WHEN 0 THEN 'UF=U' || user_id % 9 WHEN 1 THEN 'tipo=' || event_type WHEN 2 THEN 'tag=t' || user_id % 20 ELSE 'x=' || user_id END"


def _commands(spark, d, *columns: str) -> DataFrame:
    e = views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("ts", F.col("event_id").alias("seq"), F.expr(_VERB).alias("verb"), *map(F.expr, columns))


query("k15_saved_settings", f"""WITH c AS (SELECT ts, event_id, {_VERB} AS verb, {_SETTING}, event_type AS value FROM events),
h AS (SELECT kind, key, arg_max(value, (ts, event_id)) AS value, arg_max(verb, (ts, event_id)) AS verb FROM c WHERE NOT (kind = 'topic' AND key = 'itcd' AND verb = 'delete') GROUP BY 1, 2)
SELECT kind, key, value FROM h WHERE verb = 'save' UNION ALL SELECT 'topic', t, NULL FROM (SELECT unnest(['itcd', 'sucessoes', 'regime_bens']) AS t) WHERE t NOT IN (SELECT key FROM h WHERE verb = 'save' AND kind = 'topic')""")(
    lambda s, d: config.saved_settings(_commands(s, d, "CASE event_id % 3 WHEN 0 THEN 'state' WHEN 1 THEN 'topic' ELSE 'watch' END AS kind", "CASE WHEN event_id % 3 = 1 AND event_id % 7 = 0 THEN 'itcd' ELSE concat('k', user_id % 50) END AS key", "event_type AS value")))
query("k18_active_mutes", f"""SELECT key, until FROM (SELECT key, arg_max(until, (ts, event_id)) AS until, arg_max(verb, (ts, event_id)) AS verb FROM (SELECT ts, event_id, {_VERB} AS verb, {_MUTE} AS key, ts + (event_id % 20) * INTERVAL '1' DAY AS until FROM events WHERE ts <= {AS_OF} AND event_id % 4 < 3 AND (event_id % 5 <> 4 OR {_VERB} = 'delete')) GROUP BY 1)
WHERE verb = 'save' AND until > {AS_OF}""")(
    lambda s, d: config.active_mutes(_commands(s, d, "concat(CASE event_id % 4 WHEN 0 THEN concat('UF=U', user_id % 9) WHEN 1 THEN concat('tipo=', event_type) WHEN 2 THEN concat('tag=t', user_id % 20) ELSE concat('x=', user_id) END, CASE event_id % 5 WHEN 4 THEN ' soon' ELSE concat(' ', event_id % 20, 'd') END) AS text")))
_corpus("k03_notifications", "SELECT doc_id, sent IS NOT NULL AS enviada, sent AS enviada_em, CASE WHEN sent IS NULL THEN '' WHEN severity_tier = 'critico' THEN 'telegram' WHEN severity_tier IN ('alta', 'normal') THEN 'email|telegram' WHEN severity_tier = 'baixa' THEN 'email' ELSE '' END AS canais FROM corpus LEFT JOIN (SELECT event_id // 3 AS i, min(ts) AS sent FROM events WHERE event_type = 'purchase' GROUP BY 1) ON i = doc_id", None)
QUERIES["k03_notifications"] = lambda s, d: config.notified(views.corpus(s, d), views.table(s, d, "events").where("event_type = 'purchase'").select(F.expr("event_id div 3").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))).select("doc_id", "enviada", "enviada_em", F.array_join("canais", "|").alias("canais"))
_BAD_SOURCE = "CASE n % 4 WHEN 0 THEN '' ELSE nome END AS nome, CASE n % 5 WHEN 1 THEN 'xx' ELSE uf END AS uf, CASE n % 6 WHEN 2 THEN 'blog' ELSE tipo END AS tipo, n % 10 IN (3, 4) AS keywords_bypass, CASE n % 7 WHEN 3 THEN -1 ELSE expected_min_items_per_week END AS expected_min_items_per_week"
query("f25_source_errors", f"SELECT id, concat_ws('|', CASE WHEN nome = '' THEN 'nome' END, CASE WHEN NOT regexp_matches(uf, '^([A-Z]{{2}}|_federal)$') THEN 'uf' END, CASE WHEN tipo = 'blog' THEN 'tipo' END, CASE WHEN keywords_bypass AND len(org_mentions) = 0 THEN 'org_mentions' END, CASE WHEN coalesce(expected_min_items_per_week, 0) < 0 THEN 'expected' END) AS errors FROM (SELECT id, org_mentions, {_BAD_SOURCE} FROM (SELECT *, CAST(substr(id, 4) AS INT) AS n FROM sources))", "sources")(
    lambda s, d: config.source_errors(views.sources(s, d).withColumn("n", F.expr("CAST(substr(id, 4) AS INT)")).select("id", "url", "org_mentions", *map(F.expr, re.split(r", (?=CASE|n % 10)", _BAD_SOURCE))), F.array(*[F.lit(k) for k in ("sefaz", "assembleia", "noticia", "doe", "jurisprudencia", "federal")])).select("id", F.array_join("errors", "|").alias("errors")))
_BAD_DOC = ("CASE doc_id % 6 WHEN 1 THEN '' ELSE titulo END AS titulo", "CASE doc_id % 5 WHEN 2 THEN repeat('u', 3000) ELSE url END AS url", "CASE doc_id % 4 WHEN 3 THEN 'abc' ELSE content_hash END AS content_hash", "CASE doc_id % 7 WHEN 0 THEN 'x1' ELSE uf END AS uf", "CASE doc_id % 8 WHEN 5 THEN 11 ELSE relevancia END AS relevancia")
_corpus("f25_damaged_documents", "SELECT doc_id, concat_ws('|', CASE WHEN titulo = '' THEN 'titulo' END, CASE WHEN length(url) > 2048 THEN 'url' END, CASE WHEN length(content_hash) <> 64 THEN 'content_hash' END, CASE WHEN uf = 'x1' THEN 'uf' END, CASE WHEN relevancia > 10 THEN 'relevancia' END, CASE WHEN doc_id % 9 = 4 THEN 'tags' END) AS errors FROM (SELECT doc_id, " + ", ".join(_BAD_DOC) + " FROM corpus)",
    lambda c: filters.model_errors(c.select("doc_id", *map(F.expr, _BAD_DOC), F.expr("CASE doc_id % 9 WHEN 4 THEN array_repeat('t', 21) ELSE tags END").alias("tags"))).select("doc_id", F.array_join("errors", "|").alias("errors")))
_corpus("k18_mutes", "SELECT doc_id FROM corpus WHERE has_llm AND uf <> 'DE' AND tipo <> 'click'", lambda c: filters.routed(c, c.sparkSession.createDataFrame([("UF=DE", "2024-02-10 00:00:00"), ("tipo=click", "2024-03-01 00:00:00"), ("UF=EN", "2024-01-01 00:00:00")], "key string, u string").select("key", F.to_timestamp("u").alias("until"))).select("doc_id"))
_corpus("k09_reconcile_owner", "SELECT 'new' AS owner_id, count(*) AS n FROM corpus", lambda c: tables.reconcile_owner(c, "owner", "new").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n")))
def _restored(c: DataFrame) -> DataFrame:
    rows = c.select(F.expr("CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END").alias("version"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE 'owner' END").alias("owner_id"), F.expr("CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE 'documents' END").alias("collection"), F.expr("CASE WHEN doc_id % 13 = 0 THEN concat(doc_id, ' ') ELSE CAST(doc_id AS STRING) END").alias("doc_id"))
    good, bad = tables.restore(rows, "owner", ("documents",))
    return bad.unionByName(good.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("accepted "), "collection").alias("reason"), "n"))


_corpus("k08_restore", "SELECT CASE WHEN doc_id % 7 = 0 THEN 'version' WHEN doc_id % 5 = 0 THEN 'owner' WHEN doc_id % 11 = 0 THEN 'collection' WHEN doc_id % 13 = 0 THEN 'doc_id' ELSE 'accepted documents' END AS reason, count(*) AS n FROM corpus GROUP BY 1", _restored)

# Pipeline


def _batch(spark, d) -> intake.Batch:
    """The corpus as a batch: of documents with the same content the first one, by the rules of its source."""
    c, s = views.corpus(spark, d), views.sources(spark, d)
    i = _items(c)
    new = i.groupBy("content_hash").agg(F.min_by(F.struct(*[x for x in i.columns if x != "content_hash"]), "doc_id").alias("x")).select("x.*", "content_hash").select(*i.columns).drop("doc_id")
    responses = c.where("has_llm").groupBy("content_hash").agg(F.min("tipo").alias("tipo"), F.max("relevancia").alias("relevancia"), F.min("topics").alias("topics"), F.min("tags").alias("tags"))
    return intake.run_batch(new, s, c.where("doc_id % 4 = 0").select("content_hash"), responses, KEYWORDS, cutoff=0.0)


_FLAGS = f"""(SELECT content_hash, arg_min(c.source_id, c.doc_id) AS source_id, arg_min(coalesce(len(k.f), 0) > 0, c.doc_id) AS f, bool_or(c.doc_id % 4 = 0) AS old, bool_or(c.has_llm) AS llm, max(c.relevancia) AS r
    FROM corpus c LEFT JOIN (SELECT doc_id, f FROM ({_KWORG})) k ON k.doc_id = c.doc_id GROUP BY 1)"""
_both("p01_a21_batch_funnel", f"SELECT count(*) AS collected, count_if(f)::BIGINT AS keywords, count_if(f)::BIGINT AS prescore, count_if(f AND NOT old)::BIGINT AS new, count_if(f AND NOT old AND llm)::BIGINT AS classified, count_if(f AND NOT old AND NOT (llm AND r < 5))::BIGINT AS stored, count_if(f AND NOT old AND llm AND r >= 5)::BIGINT AS notified FROM {_FLAGS}", None)
QUERIES["p01_a21_batch_funnel"] = lambda spark, d: _batch(spark, d).funnel.groupBy().pivot("stage", ["collected", "keywords", "prescore", "new", "classified", "stored", "notified"]).agg(F.max("n"))
_both("a21_items_by_source", f"SELECT source_id, count(*) AS collected, count_if(f AND NOT old AND NOT (llm AND r < 5))::BIGINT AS stored, count_if(f AND NOT old AND llm AND r < 5)::BIGINT AS discarded FROM {_FLAGS} GROUP BY 1", None)
QUERIES["a21_items_by_source"] = lambda spark, d: analytics.items_by_source(_batch(spark, d).steps)
_corpus("p03_reprocess", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 11 < 5 THEN 'archived' ELSE 'classified' END ELSE status END AS status FROM corpus", lambda c: intake.reprocess(c, c.where("doc_id % 2 = 0").select("doc_id", F.lit("lei").alias("tipo"), (F.col("doc_id") % 11).cast("int").alias("relevancia"))).select("doc_id", "status"))
_corpus("p04_dispatch_split", "SELECT doc_id, CASE WHEN severity_tier = 'critico' THEN 'immediate' ELSE 'digest' END AS queue FROM corpus WHERE severity_tier IS NOT NULL", intake.dispatch_split)
_corpus("p05_d24_digest_rows", f"SELECT doc_id, coalesce(titulo, '(sem título)') AS titulo, coalesce(tipo, 'outro') AS tipo, strftime(coalesce(data_publicacao, fetched_at), '%d/%m/%Y') AS data, array_to_string(coalesce(topics, []), ', ') AS topics FROM corpus WHERE severity_tier IS NOT NULL AND {early('fetched_at', 7)} ORDER BY fetched_at DESC, doc_id LIMIT 1000", lambda c: intake.digest_rows(c, EARLY).select("doc_id", "titulo", "tipo", "data", "topics"))
_corpus("p06_on_demand", f"SELECT doc_id, relevancia, (SELECT count(*) FROM corpus WHERE status = 'pending' AND {early('fetched_at', 7)}) AS pending FROM corpus WHERE severity_tier IS NOT NULL AND {early('fetched_at', 7)} ORDER BY relevancia DESC, fetched_at DESC, doc_id LIMIT 50", lambda c: intake.on_demand(c, EARLY).select("doc_id", "relevancia", "pending"))
_corpus("p07_grouped_digest", "SELECT uf, max(n) AS n, string_agg(doc_id::VARCHAR, '|' ORDER BY r) AS docs FROM (SELECT uf, doc_id, count(*) OVER (PARTITION BY uf) AS n, row_number() OVER (PARTITION BY uf ORDER BY relevancia DESC, doc_id) AS r FROM corpus WHERE severity_tier IS NOT NULL) WHERE r <= 10 GROUP BY 1", lambda c: intake.grouped_digest(c).select("uf", "n", F.array_join("docs", "|").alias("docs")))
_corpus("t07_periodic_digest", "SELECT time_bucket(INTERVAL '1 day', fetched_at) AS start, coalesce(severity_tier, 'n/a') AS tier, count(*) AS n FROM corpus GROUP BY 1, 2", jobs.periodic_digest)
_corpus("t08_rolling_trend", "SELECT start, topic, count(*) AS n FROM (SELECT time_bucket(INTERVAL '1 day', eff_date) - i * INTERVAL '1 day' AS start, unnest(topics) AS topic FROM corpus, range(0, 7) t(i)) GROUP BY 1, 2", jobs.rolling_trend)
query("t04_heartbeat", "SELECT source_id, max(CASE WHEN ok THEN ts END) AS last_ok, max(CASE WHEN NOT ok THEN ts END) AS last_failure FROM source_events GROUP BY 1", "source_events")(lambda s, d: jobs.heartbeat_stream(views.source_events(s, d)))

from lakewatch import entries_text  # noqa: E402, F401  registers its queries
