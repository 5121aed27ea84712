"""Standing queries: a join of watches and documents, split by the kind of pattern."""

from __future__ import annotations

import re
import re._parser as re_parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.operators.analytics import AS_OF, moment, split_list
from lakewatch.operators.search import checked_pattern, corpus_text
from lakewatch.functions.text import search_form, search_term
from lakewatch.session import shared_dir, ship_package

# Ready-made watches (name, pattern, type).
TEMPLATES = (
    ("aliquota_sp", "alíquota.*SP|SP.*alíquota", "regex"),
    ("holding_familiar", "holding familiar", "term"),
    ("pec_itcd_federal", "PEC.*ITCD|ITCD.*federal|unificação.*ITCD", "regex"),
    ("modulacao_efeitos", "modulação de efeitos", "term"),
    ("stf_repercussao", "Tema.*STF|repercussão geral", "regex"),
    ("doacao_usufruto", "doação com reserva de usufruto", "term"),
    ("offshore", "offshore", "term"),
)


def templates(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "name string, pattern string, pattern_type string")


def active(watches: DataFrame, as_of=AS_OF) -> DataFrame:
    """Not expired and not cooling: within the cooldown's hours of the last trigger, unless there is none or it is 0."""
    now = moment(as_of)
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    cooling = (F.col("cooldown_hours") > 0) & F.col("last_triggered").isNotNull() & ((F.unix_micros(now) - F.unix_micros("last_triggered")) < F.col("cooldown_hours") * 3_600_000_000)
    return watches.where(live & ~F.coalesce(cooling, F.lit(False)))


def _floor(uf: str = "w_uf") -> Column:
    """Region and relevance of a pair; unclassified documents pass the relevance."""
    return (F.col(uf).isNull() | (F.col(uf) == F.col("uf"))) & (F.col("relevancia").isNull() | (F.col("relevancia") >= F.coalesce("relevancia_min", F.lit(0))))


#: Characters of an indexed gram; the counts of what a search form has of them choose a watch's key.
GRAM = 3
#: Different terms, or runs of expressions, that documents are searched for directly.
FEW = 64


def grams(c: Column, n: int = GRAM) -> Column:
    """The distinct runs of n characters; every text has the empty one."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(" + "." * n + "))"), F.lit(1))) if n else F.array(F.lit(""))


def _literal(pattern: str) -> str | None:
    """The longest run of ASCII characters that every match of an expression holds, in lower case; None if it is refused."""
    try:
        checked_pattern(pattern)
        parsed = re_parser.parse(pattern)
    except (ValueError, re.error, RecursionError, OverflowError):
        return None
    if parsed.state.flags & re.VERBOSE:
        return ""
    runs = [""]

    def walk(part) -> None:
        for op, value in part:
            if op is re_parser.LITERAL and value < 128:
                runs[-1] += chr(value).lower()
                continue
            runs.append("")
            if op is re_parser.SUBPATTERN:
                walk(value[-1])
            elif op in (re_parser.MAX_REPEAT, re_parser.MIN_REPEAT) and value[0] > 0:
                walk(value[2])
            runs.append("")

    walk(parsed)
    return max(runs, key=len)


def _mapped(fn, c: Column) -> Column:
    """A function of strings over a column of patterns; null stays null."""

    @F.pandas_udf("string")
    def mapped(patterns: pd.Series) -> pd.Series:
        return patterns.map(fn, na_action="ignore")

    return mapped(c)


def index_terms(watches: DataFrame, counts: DataFrame, literal: str = "literal") -> DataFrame:
    """`watches` with their key: of the grams of `literal` (of GRAM characters, or of its own length if that is less) the one
    that `counts` (gram, n) knows least often. Any choice gives the same matches."""
    long = F.length(literal) >= GRAM
    own = watches.withColumn("gram", F.explode(F.when(long, grams(F.col(literal))).otherwise(F.array(literal))))
    least = own.join(counts, "gram", "left").groupBy("watch_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return watches.join(least, "watch_id")


def _grams_of(docs: DataFrame, text: str, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """(gram, doc_id) of the documents' grams of the given sizes that are some watch's key."""
    every = docs.select("doc_id", F.explode(F.concat(*[grams(F.col(text), n) for n in sizes])).alias("gram"))
    return every.join(wanted, "gram", "left_semi")


def text_matches(docs: DataFrame, watches: DataFrame) -> DataFrame:
    """(watch_id, doc_id) of watches that are terms or expressions, by an index.

    A document can only match a term if it has each of the term's grams. So every watch is filed under one gram, its rarest, and
    joined by equality with the documents that have it; `contains`, or the expression, then decides. An expression is
    filed under the longest run of characters that all its matches hold. Watches are a table of any size: nothing is
    collected but which sizes of grams occur (at most four), and their patterns are never literals of the plan. A shorter
    term or expression is filed under what it has, down to nothing, which is to be held against every document. Up to FEW
    different terms or runs are themselves what a document is filed under. Expressions that are refused or don't compile
    match nothing."""
    out = watches.select("watch_id").limit(0).join(docs.select("doc_id").limit(0))
    short, whole = F.concat_ws(" ", "titulo", "resumo"), corpus_text()
    kinds = (("term", search_form(short), _mapped(search_term, F.col("pattern")), F.lit(True)), ("regex", whole, _mapped(_literal, F.col("pattern")), F.expr("form RLIKE concat('(?iU)', pattern)")))
    for kind, form, literal, hit in kinds:
        texts = docs.select("doc_id", "uf", "relevancia", form.alias("form"))
        own = watches.where(F.col("pattern_type") == kind).select("watch_id", "pattern", literal.alias("literal"), "w_uf", "relevancia_min").where("literal IS NOT NULL").checkpoint()
        few = [r[0] for r in own.select("literal").distinct().limit(FEW + 1).collect()]
        if not few:
            continue
        if len(few) <= FEW:
            held = F.filter(F.array(*map(F.lit, few)), lambda x: F.contains(F.col("form"), x))
            found = texts.withColumn("literal", F.explode(held)).join(own, "literal")
        else:
            counts = docs.select(F.explode(grams(search_form(short))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            filed = index_terms(own, counts).checkpoint()
            sizes = sorted(r[0] for r in filed.select(F.length("gram")).distinct().collect())
            found = _grams_of(texts, "form", filed.select("gram").distinct(), sizes).join(filed, "gram").join(texts, "doc_id").where(F.contains("form", F.col("literal")))
        out = out.unionByName(found.where(_floor()).where(hit).select("watch_id", "doc_id"))
    return out


def matches(docs: DataFrame, watches: DataFrame, as_of=AS_OF) -> DataFrame:
    """(watch_id, doc_id) of active watches: acts and region-topic pairs join by equality, terms and expressions by an index."""
    shared_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    w = active(watches, as_of).withColumnRenamed("uf", "w_uf")
    d = docs.select("doc_id", "uf", "relevancia", "titulo", "resumo", "topics", "metadados", "source_id", "tipo", "severity_tier", "user_tags", "tags", "url", "texto", "data_publicacao", "fetched_at")
    acts = w.where("pattern_type = 'pl_number'").select("watch_id", "w_uf", "relevancia_min", F.col("pattern").alias("act"))
    by_act = d.select("doc_id", "uf", "relevancia", F.col("metadados")["numero_ato"].alias("act")).join(acts, "act").where(_floor())
    pairs = w.where("pattern_type = 'uf_topic'").select("watch_id", "w_uf", "relevancia_min", F.split_part("pattern", F.lit(":"), F.lit(1)).alias("uf"), F.explode(split_list(F.split_part("pattern", F.lit(":"), F.lit(2)))).alias("topic"))
    by_topic = d.select("doc_id", "uf", "relevancia", F.explode("topics").alias("topic")).join(pairs, ["uf", "topic"]).where(_floor())
    out = by_act.select("watch_id", "doc_id").unionByName(by_topic.select("watch_id", "doc_id"))
    return out.unionByName(text_matches(d, w)).distinct()
