"""Landed payloads -> raw items. Each parser is a DataFrame function; bad records go to a quarantine beside the items."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewatch.functions.text import collapse, lenient_timestamp, plain, sanitize_html
from lakewatch.operators.filters import found_keywords, strings
from lakewatch.schema import RAW_ITEM

FIELDS = tuple(c.split()[0] for c in RAW_ITEM.split(", "))
#: Bytes of HTML beyond which a payload is quarantined.
MOST_HTML = 5_000_000


def raw_item(source_id: Column, title: Column, url: Column, text: Column, published: Column, fetched: Column, key: Column | None = None) -> list[Column]:
    """The columns of an item. Its hash is over `key`, or source, address and title; text is sanitised if it has markup."""
    own = F.concat_ws("|", source_id, url, title)
    hashed = own if key is None else F.coalesce(F.nullif(key, F.lit("")), own)
    clean = F.when(F.contains(text, F.lit("<")), sanitize_html(text)).otherwise(text)
    columns = (source_id, title, url, clean, published, fetched, F.sha2(hashed, 256))
    return [c.alias(n) for c, n in zip(columns, FIELDS)]


def distinct_items(items: DataFrame) -> DataFrame:
    """One item of each content, the one with the smallest address."""
    return items.groupBy("content_hash").agg(F.min_by(F.struct(*[c for c in items.columns if c != "content_hash"]), F.struct("url", "titulo")).alias("x")).select("x.*", "content_hash").select(*items.columns)


def parse_feed(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads(source_id, fetched_at, body) of RSS or Atom -> (items, quarantine). Entries need a title and a link."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<(?:item|entry)\b[^>]*>.*?</(?:item|entry)>"), F.lit(0))
    p = payloads.withColumn("blocks", blocks)
    rows = p.select("source_id", "fetched_at", F.explode("blocks").alias("block"))
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract("block", rf"(?is)<{n}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{n}>", 1), r"\s+", " ")), F.lit("")) for n in names])
    href = F.nullif(F.regexp_extract("block", r"""(?is)<link\b[^>]*href=["']([^"']+)["']""", 1), F.lit(""))
    link = F.coalesce(tag("link"), href)
    when = tag("published", "updated", "pubDate", "dc:date")
    rfc = F.try_to_timestamp(F.regexp_replace(when, r"^[A-Za-z]{3},\s*|\s+GMT$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    items = rows.select(*raw_item(F.col("source_id"), tag("title"), link, F.coalesce(tag("summary", "description", "content"), F.lit("")), F.coalesce(lenient_timestamp(when), rfc), F.col("fetched_at"), F.coalesce(tag("id", "guid"), F.concat_ws("|", link, tag("title")))))
    bad = p.where(F.size("blocks") == 0).select("source_id", F.lit("parse_error").alias("reason"), F.substring("body", 1, 500).alias("payload"))
    return items.where("titulo IS NOT NULL AND url IS NOT NULL"), bad


def absolute_url(link: Column, page: Column) -> Column:
    """The link resolved against its page; null unless the result is http(s)."""
    origin = F.regexp_extract(page, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<=[^/:]/)[^/]*$", "")
    folder = F.when(folder.rlike(r"^https?://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    out = F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(page, r"^(https?:)", 1), link)).when(link.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), None).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(folder, link))
    return F.when(out.rlike(r"(?i)^https?://[^/]"), out)


def links_of(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> the anchors with a title and an http(s) address, once each."""
    anchors = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)[^>]*>(.*?)</a>"""), F.lit(0))
    a = pages.select("page_id", F.col("url").alias("page"), F.explode(anchors).alias("a"))
    link = F.trim(F.regexp_extract("a", r"""(?is)\bhref\s*=\s*["']([^"'#]+)""", 1))
    title = collapse(F.regexp_replace(F.regexp_extract("a", r"(?is)^<a\b[^>]*>(.*)</a>$", 1), r"<[^>]+>", " "))
    return a.select("page_id", title.alias("titulo"), absolute_url(link, F.col("page")).alias("url")).where("titulo <> '' AND url IS NOT NULL").distinct()


def labelled_hits(payloads: DataFrame, localities: list[str], label: str = r"<dt>([^<]+)</dt>\s*<dd>(.*?)</dd>") -> DataFrame:
    """payloads(source_id, fetched_at, body) with hits of label and value rows -> items. A hit needs a URN and, by its
    locality without accents, one of `localities`; the same content on several pages counts once."""
    hits = payloads.select("source_id", "fetched_at", F.explode(F.filter(F.split("body", r"(?i)<div class=.hit.[^>]*>"), lambda x: F.lower(x).contains("<dt>"))).alias("hit"))
    keys = F.transform(F.regexp_extract_all("hit", F.lit("(?is)" + label), F.lit(1)), lambda x: plain(F.lower(F.trim(x))))
    values = F.transform(F.regexp_extract_all("hit", F.lit("(?is)" + label), F.lit(2)), lambda x: collapse(F.regexp_replace(x, r"<[^>]+>", " ")))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    of = lambda name: F.get(F.filter("pairs", lambda e: e["k"] == name), F.lit(0))["v"]
    m = hits.withColumn("pairs", pairs)
    urn = F.nullif(F.regexp_extract("hit", r"urn:lex:[^\s\"'<]+", 0), F.lit(""))
    near = F.exists(strings([x for x in localities]), lambda x: F.contains(plain(F.lower(F.coalesce(of("localidade"), F.lit("")))), plain(F.lower(x))))
    items = m.where(urn.isNotNull() & near).select(*raw_item(F.col("source_id"), of("titulo"), F.concat(F.lit("https://www.lexml.gov.br/urn/"), urn), F.coalesce(of("ementa"), F.lit("")), lenient_timestamp(of("data")), F.col("fetched_at"), urn))
    return distinct_items(items.where("titulo IS NOT NULL"))


@dataclass(frozen=True)
class Mapping:
    """How a family's records become items. `record` is the record's DDL; `paths` are tried in order in the payload."""

    record: str
    paths: tuple[str, ...]
    key: str
    title: str
    url: str
    text: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    success: str | None = None
    required: str = "true"
    keyword_fields: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict)


#: The families' mappings, as SQL over the record `r` (and the source's id).
MAPPINGS = {
    "almg": Mapping("STRUCT<numeroDoc: STRING, numDoc: STRING, proposicao: STRING, norma: STRING, ementa: STRING, assunto: STRING, dataPublicacao: STRING, url: STRING>", ("$.resultado.listaItem",), "coalesce(r.numeroDoc, r.numDoc)", "coalesce(r.proposicao, r.norma)", "r.url", ("r.ementa", "r.assunto"), ("r.dataPublicacao",), required="coalesce(r.numeroDoc, r.numDoc) IS NOT NULL"),
    "alep": Mapping("STRUCT<codigo: BIGINT, tipo: STRING, numero: STRING, ano: STRING, ementa: STRING, data: STRING>", ("$.lista",), "concat('alep:', r.codigo)", "concat(r.tipo, ' ', r.numero, '/', r.ano)", "concat('https://www.assembleia.pr.leg.br/proposicao/', r.codigo)", ("r.ementa",), ("r.data",), "$.sucesso", "r.codigo IS NOT NULL"),
    "sapl": Mapping("STRUCT<id: BIGINT, __str__: STRING, ementa: STRING, data_apresentacao: STRING>", ("$.results",), "concat('sapl:', source_id, ':', r.id)", "coalesce(r.__str__, concat('Matéria ', r.id))", "concat(base_url, '/materia/', r.id)", ("r.ementa",), ("r.data_apresentacao",), None, "r.id IS NOT NULL"),
    "camara": Mapping("STRUCT<id: BIGINT, siglaTipo: STRING, numero: BIGINT, ano: BIGINT, ementa: STRING, dataApresentacao: STRING>", ("$.dados",), "concat('camara:', r.id)", "concat(r.siglaTipo, ' ', r.numero, '/', r.ano)", "concat('https://www.camara.leg.br/propostas-legislativas/', r.id)", ("r.ementa",), ("r.dataApresentacao",), None, "r.id IS NOT NULL"),
    "senado": Mapping("STRUCT<identificacao: STRING, tipo: STRING, ementa: STRING, dataApresentacao: STRING, url: STRING>", ("$", "$.processos", "$.items", "$.data", "$.results", "$.lista"), "concat('senado:', r.identificacao)", "concat_ws(' ', r.tipo, r.identificacao)", "r.url", ("r.ementa",), ("r.dataApresentacao",), None, "r.identificacao IS NOT NULL", ("r.ementa", "r.identificacao")),
    "sharepoint": Mapping("STRUCT<ID: BIGINT, PesqLegisTitle: STRING, Title: STRING, Ementa: STRING, DataPublicacao: STRING, DataAto: STRING, Url: STRING>", ("$.d.results",), "concat('sefaz-sp:', r.ID)", "coalesce(r.PesqLegisTitle, r.Title)", "r.Url", ("regexp_replace(r.Ementa, '<[^>]+>', ' ')",), ("r.DataPublicacao", "r.DataAto"), None, "r.ID IS NOT NULL AND r.Url IS NOT NULL"),
}


def map_json(payloads: DataFrame, mapping: Mapping, keywords: list[str] | None = None, cutoff: str | None = None) -> tuple[DataFrame, DataFrame]:
    """payloads(source_id, fetched_at, base_url, body) -> (items, quarantine), by a mapping. Undated items pass the cut-off."""
    lists = [F.when(F.get_json_object("body", p).startswith("["), F.get_json_object("body", p)) for p in mapping.paths]
    p = payloads.withColumn("listed", F.from_json(F.coalesce(*lists), f"ARRAY<{mapping.record}>"))
    failed = F.col("listed").isNull()
    if mapping.success:
        failed = failed | ~F.coalesce(F.get_json_object("body", mapping.success) == "true", F.lit(False))
    bad = p.where(failed).select("source_id", F.lit("parse_error").alias("reason"), F.substring("body", 1, 500).alias("payload"))
    r = p.where(~failed).select("source_id", "fetched_at", "base_url", F.explode("listed").alias("r")).where(F.expr(mapping.required))
    if keywords and mapping.keyword_fields:
        r = r.where(F.size(found_keywords(F.concat_ws(" ", *map(F.expr, mapping.keyword_fields)), tuple(keywords))) > 0)
    when = F.coalesce(*[lenient_timestamp(F.expr(d)) for d in mapping.dates]) if mapping.dates else F.lit(None).cast("timestamp")
    items = r.select(*raw_item(F.col("source_id"), F.expr(mapping.title), F.expr(mapping.url), F.concat_ws("\n", *map(F.expr, mapping.text)), when, F.col("fetched_at"), F.expr(mapping.key)))
    if cutoff:
        items = items.where(F.col("data_publicacao").isNull() | (F.col("data_publicacao") >= F.lit(cutoff).cast("timestamp")))
    return distinct_items(items.where("titulo IS NOT NULL")), bad


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Landed XML by row tag, streamed and split by Spark; attributes are columns with a leading underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


#: XML families: row tag, schema, key, title, address, texts, dates, keyword fields; SQL over the row's columns.
XML = {
    "alepe": ("projeto", "_docid STRING, _tipo STRING, _numero STRING, _ano STRING, _ementa STRING, _data STRING, _autores STRING", "concat('alepe:', _docid)", "concat(_tipo, ' ', _numero, '/', _ano)", "concat('https://www.alepe.pe.gov.br/proposicao/', _docid)", ("_ementa", "_autores"), ("_data",), ("_ementa",)),
    "sru": ("record", "identifier STRING, title STRING, link STRING, description STRING, date STRING", "identifier", "title", "link", ("description",), ("date",), ()),
    "alesp": ("propositura", "IdDocumento STRING, Natureza STRING, NroLegislativo STRING, AnoLegislativo STRING, Ementa STRING, DtEntradaSistema STRING, DtPublicacao STRING", "concat('alesp:', IdDocumento)", "concat(Natureza, ' ', NroLegislativo, '/', AnoLegislativo)", "concat('https://www.al.sp.gov.br/propositura/?id=', IdDocumento)", ("Ementa",), ("DtEntradaSistema", "DtPublicacao"), ("Ementa",)),
}


def map_xml(rows: DataFrame, family: str, source_id: str, fetched_at: str, keywords: list[str] | None = None, cutoff: str | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Rows of read_xml -> items; keyword, date and kind filters run before the items are built."""
    _, _, key, title, url, text, dates, own = XML[family]
    when = F.coalesce(*[lenient_timestamp(F.expr(d)) for d in dates])
    r = rows.where(F.expr(key).isNotNull())
    if keywords and own:
        r = r.where(F.size(found_keywords(F.concat_ws(" ", *map(F.expr, own)), tuple(keywords))) > 0)
    if kinds and family == "alesp":
        r = r.where(F.col("Natureza").isin(*kinds))
    if cutoff:
        r = r.where(when.isNull() | (when >= F.lit(cutoff).cast("timestamp")))
    items = r.select(*raw_item(F.lit(source_id), F.expr(title), F.expr(url), F.concat_ws("\n", *map(F.expr, text)), when, F.lit(fetched_at).cast("timestamp"), F.expr(key)))
    return distinct_items(items.where("titulo IS NOT NULL AND url IS NOT NULL"))


#: An act's number: digits, points and spaces of one line; digits that begin the next line are text.
ACT_NUMBER = r"(?:Nº|N°|N\.)\s*([\d. \t]*\d)"
#: A gazette act's header: kind, number.
HEADER = r"(?:LEI(?: COMPLEMENTAR)?|DECRETO|PORTARIA|RESOLUÇÃO|INSTRUÇÃO NORMATIVA)\s+" + ACT_NUMBER.replace("([", "(?:[")


def gazette_acts(texts: DataFrame, header: str = HEADER) -> DataFrame:
    """texts(doc_id, text) -> acts: text from header to header, title its first line that isn't blank, number without spaces."""
    broken = F.regexp_replace("text", rf"(?<=\S)[ \t]*(?={header})", "\n")
    parts = texts.select("doc_id", F.posexplode(F.filter(F.split(broken, rf"(?m)(?=^\s*{header})"), lambda x: x.rlike(rf"^\s*{header}"))).alias("pos", "act"))
    title = F.trim(F.regexp_extract("act", r"^\s*([^\n]+)", 1))
    number = F.regexp_replace(F.regexp_replace(F.regexp_extract("act", ACT_NUMBER, 1), r"\s+", ""), r"\.$", "")
    return parts.select("doc_id", "pos", title.alias("titulo"), number.alias("numero"), F.trim("act").alias("texto"))


def prefilter_acts(acts: DataFrame, orgs: list[str], keywords: list[str]) -> DataFrame:
    """Acts with an organisation's mention, else with a keyword; without terms all pass."""
    if not orgs and not keywords:
        return acts
    return acts.where(F.size(found_keywords(F.col("texto"), tuple(orgs) + tuple(keywords))) > 0)


#: Parsers by name: payloads -> (items, quarantine). Others are added with `register`.
PARSERS = {"rss": parse_feed}


def register(name: str, parser) -> None:
    """A parser is a function of a payload table that returns (items, quarantine)."""
    PARSERS[name] = parser


for _name, _mapping in MAPPINGS.items():
    register(_name, lambda p, m=_mapping: map_json(p, m))


def collect(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """payloads(parser, source_id, fetched_at, base_url, body) -> (items of every registered parser, quarantine by parser). What
    one source lands broken never stops the others; payloads of an unknown parser are quarantined."""
    parts = [(n, parser(payloads.where(F.col("parser") == n))) for n, parser in PARSERS.items()]
    unknown = payloads.where(~F.coalesce(F.col("parser").isin(*PARSERS), F.lit(False))).select("parser", "source_id", F.lit("unknown").alias("reason"), F.substring("body", 1, 500).alias("payload"))
    items = reduce(DataFrame.unionByName, [p[0] for _, p in parts])
    bad = reduce(DataFrame.unionByName, [p[1].select(F.lit(n).alias("parser"), "source_id", "reason", "payload") for n, p in parts])
    return items, bad.unionByName(unknown)


def failures(payloads: DataFrame) -> DataFrame:
    """The report of a collection: parser, source_id, reason and how many payloads were quarantined."""
    return collect(payloads)[1].groupBy("parser", "source_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def html_items(pages: DataFrame, most: int = MOST_HTML) -> tuple[DataFrame, DataFrame]:
    """pages(page_id, url, html) -> (sanitised, quarantine of those over the limit)."""
    big = F.octet_length("html") > most
    return pages.where(~big).select("page_id", "url", sanitize_html(F.col("html")).alias("html")), pages.where(big).select("page_id", F.lit("too_large").alias("reason"))
