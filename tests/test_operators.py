import hashlib

import pytest
from pyspark.sql import functions as F

from lakewatch import entries, session
from lakewatch.operators import audit, clusters, filters, health, search, tables, watches
from lakewatch.plans import intake
from lakewatch.schema import AUDIT, DLQ, RAW_ITEM, SOURCE, WATCH, struct
from lakewatch.sources import catalog, payloads
from tests.conftest import SF

SMALL = SF.replace("0.01", "0.001")
DOCS = "doc_id long, titulo string, url string, content_hash string"


def test_boolean_queries(spark):
    rows = [("herança e doação",), ("doação",), ("herança com trust",)]
    df = spark.createDataFrame(rows, "t string")
    hits = lambda q: [r.t for r in df.where(search.boolean_condition(q, search.search_form(F.col("t")))).collect()]
    assert hits("heranca AND doacao") == ["herança e doação"]
    assert hits("herança AND NOT trust") == ["herança e doação"]
    assert len(hits("trust OR doação")) == 3 and hits("herança doação") == ["herança e doação"]
    titles = spark.createDataFrame([("a trust",), ("familiar note on holding",), ("holding familiar",)], "t string")
    found = lambda q: [r.t for r in titles.where(search.boolean_condition(q, search.search_form(F.col("t")))).collect()]
    assert found("trust OR holding familiar") == ["a trust", "holding familiar"]  # what lies between operators is one term
    assert found("holding not note on") == ["holding familiar"] and found("familiar holding") == ["familiar note on holding", "holding familiar"]


def test_regex_guard():
    for bad in ("(a+)+", "x" * 501, r"(a)\1\1\1\1"):
        with pytest.raises(ValueError):
            search.checked_pattern(bad)


def test_clusters(spark):
    rows = [(1, "Lei nº 1.234/2024 altera o ITCD", "u1", "a"), (2, "Nova Lei 1234/2024", "u2", "b"), (3, "Assembleia debate alíquota do imposto sobre heranças", "u3", "c"), (4, "Assembleia debate aliquota do imposto sobre heranças", "u4", "d"), (5, "Outro tema", "u5", "e"), (6, "Mais um", "u6", "e"), (7, None, "u7", "f")]
    got = {r.doc_id: r.cluster_id for r in clusters.assign_clusters(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == got[2] != got[3] == got[4] and got[5] == got[6] and len(set(got.values())) == 4
    assert got[1] == hashlib.sha256(b"a|numato:1234/2024").hexdigest()[:16]


def _links_by_all_pairs(rows, least):
    import difflib

    label = {d: d for d, _ in rows}

    def root(d):
        return d if label[d] == d else root(label[d])

    for k, (a, x) in enumerate(rows):
        for b, y in rows[k + 1 :]:
            if x and y and difflib.SequenceMatcher(None, x, y).ratio() >= least:
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d, _ in rows}


@pytest.mark.parametrize("piece", [4096, 3])
def test_similar_titles_have_the_components_of_all_pairs(spark, piece):
    import random

    r = random.Random(5)
    words = ["lei", "altera", "imposto", "herança", "doação", "de", "o", "sobre", "bens", "regime", "alíquota", "estado", "公告", "é"]
    rows = []
    for d in range(150):
        title = list(r.choice(rows)[1]) if rows and r.random() < 0.6 else list(" ".join(r.choice(words) for _ in range(r.randint(1, 9))))
        for _ in range(r.choice([0, 1, 2, 5, 9])):
            at = r.randrange(len(title) + 1) if title else 0
            title[at : at + r.randint(0, 2)] = r.choice(["x", "", "ab", "é "])
        rows.append((d, "".join(title)))
    df = spark.createDataFrame(rows, "item long, titulo string")
    norm = {x.item: x.n for x in df.select("item", clusters.compare_form(F.col("titulo")).alias("n")).collect()}
    want = _links_by_all_pairs([(d, norm[d]) for d, _ in rows], 0.85)
    clusters.shared_dir(spark)
    pairs = clusters.similar_pairs(df, 0.85, piece)
    got = {x.node: x.root for x in clusters.components(pairs, df.select(F.col("item").alias("node"))).collect()}
    assert got == want
    assert clusters.similar_pairs(df.limit(0)).count() == 0


def test_title_similarity_of_a_watch(spark):
    titles = [("Governo altera o ITCD em 2024",), ("governo altera o itcd em 2025",), ("Outro assunto",), (None,), ("",)]
    df = spark.createDataFrame(titles, "t string")
    assert [r.t for r in df.where(search.title_similar(F.col("t"), "Governo altera o ITCD em 2024")).collect()] == [t for t, in titles[:2]]


def test_checkpoint_folder_must_be_shared(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    assert session.shared_dir(spark)


def test_collection_isolates_failures(spark):
    rows = [("rss", "a", "<rss><item><title>T</title><link>http://x/1</link></item></rss>"), ("rss", "a", "oops"), ("camara", "b", "<html>"), ("nosuch", "c", "x")]
    p = spark.createDataFrame(rows, "parser string, source_id string, body string").withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp")).withColumn("base_url", F.lit("https://x.org"))
    items, bad = payloads.collect(p)
    assert [r.titulo for r in items.collect()] == ["T"]
    assert {(r.parser, r.source_id, r.reason) for r in bad.collect()} == {("rss", "a", "parse_error"), ("camara", "b", "parse_error"), ("nosuch", "c", "unknown")}


def test_keyword_rule_of_bypass_sources(spark):
    sources = spark.createDataFrame([("b", True, ["STF"], [], True, "sefaz"), ("k", False, ["STF"], [], True, "sefaz"), ("o", False, [], ["doação"], True, "sefaz")], "id string, keywords_bypass boolean, org_mentions array<string>, keywords_required array<string>, trusted boolean, tipo string")
    items = spark.createDataFrame([(s, t, "") for s in "bko" for t in ("STF decide", "ITCD sobe", "Doação cresce")], "source_id string, titulo string, texto string")
    got = {(r.source_id, r.titulo) for r in filters.keyword_or_org(items, sources, ("ITCD",)).collect()}
    assert got == {("b", "STF decide"), ("k", "STF decide"), ("k", "ITCD sobe"), ("o", "Doação cresce")}


def test_watch_cooldown_and_templates(spark):
    df = spark.createDataFrame([("a", None, 0, None), ("b", "2023-01-01", 0, None), ("c", None, 24, "2024-01-30 12:00:00"), ("d", None, 24, "2024-01-29 12:00:00"), ("e", None, 0, "2024-01-30 23:59:00")], "watch_id string, e string, cooldown_hours int, l string")
    w = df.select("watch_id", F.to_timestamp("e").alias("expires_at"), "cooldown_hours", F.to_timestamp("l").alias("last_triggered"))
    assert {r.watch_id for r in watches.active(w).collect()} == {"a", "d", "e"} and watches.templates(spark).count() == 7


def test_audit_chain_detects_any_edit(spark):
    rows = [("o", i, f"2024-01-01 00:00:{i:02d}", "act", f"p{i}") for i in range(20)]
    log = spark.createDataFrame(rows, "owner_id string, entry_id long, t string, action string, payload string").withColumn("timestamp", F.to_timestamp("t")).drop("t")
    chain = audit.append(log, spark.createDataFrame([], "owner_id string, last_hash string")).cache()
    assert audit.verify(chain).where("NOT valid").count() == 0
    for k in (0, 7, 18):
        edited = chain.withColumn("payload", F.when(F.col("entry_id") == k, "x").otherwise(F.col("payload")))
        assert [r.entry_id for r in audit.verify(edited).where("NOT valid").collect()] == [k + 1]
    last = chain.orderBy(F.col("entry_id").desc()).limit(1).select("owner_id", F.sha2(audit.canonical(), 256).alias("last_hash"))
    more = audit.append(log.where("entry_id < 2").withColumn("entry_id", F.col("entry_id") + 100).withColumn("timestamp", F.expr("timestamp + INTERVAL 1 DAY")), last)
    assert audit.verify(chain.unionByName(more)).where("NOT valid").count() == 0


def test_upsert_is_write_once(spark):
    cols = "doc_id long, source_id string, titulo string, url string, texto string, data_publicacao timestamp, content_hash string, relevancia int"
    stored = spark.createDataFrame([(1, "s", "t", "u", "x", None, "h1", 9)], cols)
    batch = spark.createDataFrame([(1, "s", "t", "u", "x", None, "h1", None), (2, "s", "t", "u", "x", None, "h2", None)], cols)
    table, conflicts = tables.upsert(stored, batch)
    assert {(r.doc_id, r.relevancia) for r in table.collect()} == {(1, 9), (2, None)} and conflicts.count() == 0
    assert [r.doc_id for r in tables.upsert(stored, batch.withColumn("titulo", F.lit("z")))[1].collect()] == [1]


def test_tags_are_sets(spark):
    df = spark.createDataFrame([(["a"],), (None,)], "user_tags array<string>")
    twice = tables.add_tag(tables.add_tag(df, "b"), "b")
    assert [r.user_tags for r in twice.collect()] == [["a", "b"], ["b"]]
    assert tables.rename_tag(twice, "a", "b").first().user_tags == ["b"]


def test_gazette_numbers_end_with_their_line(spark):
    rows = [(1, "Diário\nLEI Nº 1.656\n4754 e 5434 são textos. DECRETO Nº 5 5 trata"), (2, "PORTARIA Nº\n7.1\t\n.9 resto")]
    acts = payloads.gazette_acts(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "pos").collect()
    assert [(r.titulo, r.numero) for r in acts] == [("LEI Nº 1.656", "1.656"), ("DECRETO Nº 5 5 trata", "55"), ("PORTARIA Nº", "7.1")]


def test_feed_json_xml_and_gazette(spark, tmp_path):
    rss = '<rss><item><title>Lei A</title><link>http://x/1</link><guid>g1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>sem link</title></item></rss>'
    atom = '<feed><entry><title>B</title><link href="http://x/2"/><updated>2024-02-01T00:00:00Z</updated><summary>&lt;b&gt; x</summary></entry></feed>'
    p = spark.createDataFrame([("s", rss), ("s", atom), ("s", "oops")], "source_id string, body string").withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp"))
    items, bad = payloads.parse_feed(p)
    assert {(r.titulo, r.url, str(r.data_publicacao)[:10], r.content_hash) for r in items.collect()} == {("Lei A", "http://x/1", "2024-01-01", hashlib.sha256(b"g1").hexdigest()), ("B", "http://x/2", "2024-02-01", hashlib.sha256(b"http://x/2|B").hexdigest())}
    assert bad.count() == 1
    body = '{"sucesso": true, "lista": [{"codigo": 7, "tipo": "PL", "numero": "3", "ano": "2024", "ementa": "x", "data": "2024-01-05"}, {"codigo": 7, "tipo": "PL", "numero": "3", "ano": "2024"}, {"tipo": "PL"}]}'
    j = spark.createDataFrame([("alep", body), ("alep", '{"sucesso": false, "lista": []}')], "source_id string, body string").withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp")).withColumn("base_url", F.lit("https://x"))
    items, bad = payloads.map_json(j, payloads.MAPPINGS["alep"])
    assert [r.titulo for r in items.collect()] == ["PL 3/2024"] and bad.count() == 1
    (tmp_path / "d.xml").write_text("<r><propositura><IdDocumento>1</IdDocumento><Natureza>PL</Natureza><NroLegislativo>9</NroLegislativo><AnoLegislativo>2024</AnoLegislativo><Ementa>sobre ITCMD</Ementa><DtEntradaSistema>2024-01-01</DtEntradaSistema></propositura><propositura><IdDocumento>2</IdDocumento><Natureza>PL</Natureza><Ementa>outra</Ementa></propositura></r>")
    tag, schema = payloads.XML["alesp"][:2]
    rows = payloads.map_xml(payloads.read_xml(spark, str(tmp_path / "d.xml"), tag, schema), "alesp", "alesp", "2024-02-01", ["ITCMD"], "2023-01-01", ["PL"])
    assert [r.titulo for r in rows.collect()] == ["PL 9/2024"]
    acts = payloads.gazette_acts(spark.createDataFrame([(1, "Diário\nLEI Nº 1.234, de hoje\ntexto doação DECRETO Nº 55 de ontem\nresto")], "doc_id long, text string"))
    assert [(r.titulo, r.numero) for r in acts.orderBy("pos").collect()] == [("LEI Nº 1.234, de hoje", "1.234"), ("DECRETO Nº 55 de ontem", "55")]
    assert payloads.prefilter_acts(acts, [], ["doação"]).count() == 1 and payloads.prefilter_acts(acts, [], []).count() == 2
    hit = '<div class="hit"><dl><dt>Título</dt><dd>Lei 1</dd><dt>Localidade</dt><dd>São Paulo</dd><dt>Data</dt><dd>01/02/2024</dd></dl>urn:lex:br;sp:lei:1</div>'
    found = payloads.labelled_hits(spark.createDataFrame([("lexml", hit * 2 + hit.replace("São Paulo", "Acre"))], "source_id string, body string").withColumn("fetched_at", F.lit("2024-03-01").cast("timestamp")), ["sao paulo"])
    assert [(r.titulo, str(r.data_publicacao)[:10]) for r in found.collect()] == [("Lei 1", "2024-02-01")]


def test_links_and_catalog(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://x.org/a/b?q", '<a href="c">C</a><a href="/d"><b>D</b></a><a href="javascript:x">E</a><a href="//y.org/f">F</a><a href="https://z.org">G</a><a href="h"></a>')], "page_id long, url string, html string")
    assert {(r.titulo, r.url) for r in payloads.links_of(pages).collect()} == {("C", "https://x.org/a/c"), ("D", "https://x.org/d"), ("F", "https://y.org/f"), ("G", "https://z.org")}
    (tmp_path / "s.json").write_text('{"id": "b", "ativo": true}\n{"id": "a", "ativo": false}\n{"id": "c"}\n{"id": "c"}\n{"ativo": true}\n{"id": "d", "ativo": "maybe"}\n{oops\n')
    rows, bad = catalog.read_catalog(spark, str(tmp_path / "s.json"))
    assert [r.id for r in rows.collect()] == ["a", "b"]
    assert sorted((r.id or "", r.reason) for r in bad.collect()) == [("", "malformed"), ("", "no_id"), ("c", "duplicate_id"), ("d", "malformed")]


def test_export_restore_and_queue(spark, tmp_path):
    df = spark.createDataFrame([("me", 1), ("you", 2)], "owner_id string, doc_id long")
    assert [(r.collection, r.n) for r in tables.export_owner({"documents": df}, "me", str(tmp_path / "x")).collect()] == [("documents", 1)]
    assert spark.read.json(str(tmp_path / "x/documents")).count() == 1
    q = spark.createDataFrame([("1", "parse_error", "p", None), ("2", "unknown", "p", None)], DLQ)
    assert tables.dlq_by_reason(q, "unknown").count() == 1 and tables.dlq_remove(tables.enqueue(q, q.withColumn("entry_id", F.lit("3"))), q).count() == 2
    extras, defaults, new = (spark.createDataFrame([(x,) for x in v], "kw string") for v in (["Trust"], ["ITCD"], ["itcd", "TRUST", "ab", "Novo termo"]))
    assert [r.kw for r in tables.added_keywords(extras, defaults, new).collect()] == ["Trust", "Novo termo"]


def test_schemas_parse():
    for ddl in (AUDIT, DLQ, RAW_ITEM, SOURCE, WATCH):
        assert struct(ddl).names


def test_cutoff_is_monotone(spark):
    items, sources = entries._items(entries.views.corpus(spark, SMALL)), entries.views.sources(spark, SMALL)
    s = filters.scored(filters.keyword_or_org(items, sources, entries.KEYWORDS)).cache()
    n = [s.where(filters.passes(F.col("score"), c)).count() for c in (0.0, 0.3, 0.5, 0.7, 1.1)]
    assert n == sorted(n, reverse=True) and n[-1] == 0


def test_batch_keeps_pending_documents(spark):
    b = entries._batch(spark, SMALL)
    assert b.stored.where("status = 'pending'").count() > 0 and b.stored.where("severity_tier = 'descartado'").count() == 0
    assert intake.dispatch_split(b.stored.where("severity_tier IS NOT NULL")).count() == b.dispatch.count()
    assert health.zero_run_report(entries.views.run_history(spark, SMALL)).count() > 0


def test_batch_asks_a_provider_for_new_items_only(spark):
    asked = []

    def provider(items):
        asked.append(items)
        return intake.rule_provider({"itcd": ("license", "the and")})(items)

    c, s = entries.views.corpus(spark, SMALL), entries.views.sources(spark, SMALL)
    items = entries._items(c).drop("doc_id").dropDuplicates(["content_hash"])
    b = intake.run_batch(items, s, c.where("doc_id % 4 = 0").select("content_hash"), provider, entries.KEYWORDS, cutoff=0.0)
    n = {r.stage: r.n for r in b.funnel.collect()}
    assert asked[0].count() == n["new"] == n["classified"] > 0 and n["stored"] <= n["new"]


def test_audit_chain_is_streamed(spark):
    log = spark.range(500).selectExpr("concat('o', id % 3) AS owner_id", "id AS entry_id", "timestamp_seconds((id * 7) % 90) AS timestamp", "'view' AS action", "'p' AS payload")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")  # owners go over batches
    try:
        chain = audit.append(log, spark.createDataFrame([("o1", "f" * 64)], "owner_id string, last_hash string"))
        assert "PandasGroup" not in (plan := chain._jdf.queryExecution().toString()) and "InPandas" not in plan  # no owner's log is held whole
        checked = {(r.owner_id, r.entry_id): r for r in audit.verify(chain).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    broken = [(k, r.prev_hash) for k, r in checked.items() if not r.valid]
    assert len(checked) == 500 and len(broken) == 1 and broken[0][0][0] == "o1" and broken[0][1] == "f" * 64  # its first goes on from the last hash


def test_reindex_builds_a_text_once_and_sorts_none(spark):
    from lakewatch.operators import search, tables
    from lakewatch.sources import corpus as views

    c = views.corpus(spark, "/root/testdata/sf0.001")
    plan = tables.reindex(c, search.indexed(c).withColumn("index_version", F.lit(2))).select("doc_id", F.md5("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3 and "SortMergeJoin" not in plan.split("LeftAnti")[0].splitlines()[-1]
    stored = spark.createDataFrame([(1, "kept", ["a"], 2), (2, "", ["b"], 2), (3, None, ["c"], 2), (4, "older", ["d"], 1), (-1, "no document", [], 3)], "doc_id long, text string, terms array<string>, index_version int")
    got = {r.doc_id: r for r in tables.reindex(c.where("doc_id BETWEEN 1 AND 5"), stored).collect()}
    assert got[1].text == "kept" and got[-1].text == "no document" and set(got) == {-1, 1, 2, 3, 4, 5}
    assert all(got[k].text.startswith(f"{k} ") and got[k].index_version == 2 for k in (2, 3, 4, 5))
