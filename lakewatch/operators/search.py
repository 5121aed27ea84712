"""Search over the corpus. Every limit has a deterministic order."""

from __future__ import annotations

import difflib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewatch.functions.similarity import Strings, common, least_matches
from lakewatch.functions.text import search_form, search_term
from lakewatch.operators.analytics import AS_OF, moment
from lakewatch.session import ship_package

# Month names of a period, and the characters of a stored term.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
TERM_CHARS = 64


def corpus_text(raw_chars: int | None = None, text_chars: int | None = None) -> Column:
    """The searchable form of a document: its whole text, unless a caller limits the raw text's or the form's characters."""
    meta = F.array_join(F.transform(F.map_entries("metadados"), lambda e: F.concat_ws(" ", e["key"], e["value"])), "\n")
    parts = [F.col("doc_id").cast("string"), F.col("titulo"), F.col("source_id"), F.col("uf"), F.array_join("topics", " "), F.array_join("user_tags", " "), F.col("tipo"), F.col("severity_tier"), F.col("resumo"), F.array_join("tags", " "), meta, F.col("url"), F.col("texto") if raw_chars is None else F.substring("texto", 1, raw_chars), F.date_format(F.coalesce("data_publicacao", "fetched_at"), "yyyy-MM-dd")]
    form = search_form(F.concat_ws("\n", *parts))
    return form if text_chars is None else F.substring(form, 1, text_chars)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\d{1,6}/\d{4}|[\wÀ-ÿ]{3,}"), F.lit(0))


def indexed(docs: DataFrame, most_terms: int | None = None, keep: tuple[str, ...] = (), **limits) -> DataFrame:
    """doc_id, text and terms: structured terms first, then the text's tokens, each once and cut; all of them, unless a caller
    limits their number or the text. Columns of `docs` to `keep` come after them."""
    d = docs.withColumn("text", corpus_text(**limits))
    own = F.transform(F.array_compact(F.array(F.lower("source_id"), F.lower("uf"), "tipo", "severity_tier")), lambda x: F.substring(x, 1, TERM_CHARS))
    listed = F.concat(own, F.coalesce("topics", F.array()), F.coalesce("user_tags", F.array()), F.transform(tokens(F.col("text")), lambda x: F.substring(x, 1, TERM_CHARS)))
    terms = F.array_distinct(listed)
    return d.select("doc_id", "text", (terms if most_terms is None else F.slice(terms, 1, most_terms)).alias("terms"), *keep)


def stored_or_built(stored: Column) -> Column:
    return F.coalesce(F.nullif(stored, F.lit("")), corpus_text())


def _term(t: str) -> Column:
    return F.lit(search_term(t))


def indexed_search(docs: DataFrame, index: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """Documents whose index has the longest term without a space and whose text has all terms; not archived, newest first."""
    whole = [t for t in terms if " " not in t.strip()]
    hits = index
    if whole:
        hits = hits.where(F.array_contains("terms", _term(max(whole, key=len))))
    for t in terms:
        hits = hits.where(F.contains("text", _term(t)))
    d = docs.where("status <> 'archived'").join(hits.select("doc_id"), "doc_id", "left_semi")
    return d.orderBy(F.col("fetched_at").desc(), "doc_id").limit(limit)


def scan_search(docs: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    d = docs.withColumn("text", corpus_text())
    for t in terms:
        d = d.where(F.contains("text", _term(t)))
    return d.orderBy(F.col("fetched_at").desc(), "doc_id").limit(limit)


def period_start(period: str, as_of=AS_OF) -> Column | None:
    """The lower bound of `30d`, `abril 2026`, `Q1 2026` or an ISO month or day; None if it is none of these."""
    p = period.strip().lower()
    if m := re.fullmatch(r"(\d{1,3})([dwmy])", p):
        return moment(as_of) - F.expr(f"INTERVAL '{int(m[1]) * {'d': 1, 'w': 7, 'm': 30, 'y': 365}[m[2]]}' DAY")
    if (m := re.search(r"(" + "|".join(MONTHS) + r")\w*\s+(\d{4})", p)) is not None:
        return F.lit(f"{m[2]}-{MONTHS.index(m[1]) + 1:02d}-01").cast("timestamp")
    if m := re.fullmatch(r"q([1-4])\s+(\d{4})", p):
        return F.lit(f"{m[2]}-{3 * int(m[1]) - 2:02d}-01").cast("timestamp")
    if m := re.fullmatch(r"(\d{4})-(\d{2})(?:-(\d{2}))?", p):
        return F.lit(f"{m[1]}-{m[2]}-{m[3] or '01'}").cast("timestamp")
    return None


def faceted_search(docs: DataFrame, *, uf=None, source_tipo=None, tipo=None, tier=None, least_relevance=None, model=None, prompt=None, tag=None, term=None, period=None, period_end=None, as_of=AS_OF, limit: int = 50) -> DataFrame:
    """All given facets; unclassified rows fail any facet of the classification."""
    d = docs
    for column, value in (("uf", uf), ("source_tipo", source_tipo), ("tipo", tipo), ("severity_tier", tier), ("llm_model", model), ("prompt_version", prompt)):
        d = d if value is None else d.where(F.col(column) == value)
    d = d if least_relevance is None else d.where(F.col("relevancia") >= least_relevance)
    d = d if tag is None else d.where(F.array_contains("user_tags", tag))
    d = d if term is None else d.where(F.contains(corpus_text(), _term(term)))
    start = None if period is None else period_start(period, as_of)
    d = d if start is None else d.where(F.col("eff_date") >= start)
    d = d if period_end is None else d.where(F.col("eff_date") < F.lit(period_end).cast("timestamp"))
    return d.orderBy("doc_id").limit(limit)


def boolean_condition(query: str, text: Column) -> Column:
    """Terms between AND, OR and NOT from left to right, without precedence; what lies between two operators is one term,
    spaces included. NOT after another operator (AND NOT) negates its term. Without an operator, all words."""
    parts = [p.strip() for p in re.split(r"\s+(and|or|not)(?=\s)", query.strip().lower())]
    if len(parts) == 1:
        return reduce(lambda a, b: a & b, [F.contains(text, _term(w)) for w in query.split()], F.lit(True))
    out, op, negate = None, "and", False
    for part in parts:
        if part == "not":
            negate = True  # the operator before it, if there is one, stays
        elif part in ("and", "or"):
            op = part
        elif part:
            c = F.contains(text, _term(part))
            c = ~c if negate else c
            out = c if out is None else (out & c if op == "and" else out | c)
            op, negate = "and", False
    return F.lit(True) if out is None else out


def boolean_search(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    d = docs.withColumn("text", corpus_text())
    return d.where(boolean_condition(query, F.col("text"))).orderBy("doc_id").limit(limit)


def title_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """SequenceMatcher's ratio of two strings; null where the longest common subsequence, found for a batch at once, keeps it
    below `least`."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = [s or "" for s in x], [s or "" for s in y]
        out = np.full(len(p), np.nan)
        for k in range(0, len(p), 1024):
            i, j = Strings(p[k : k + 1024]), Strings(q[k : k + 1024])
            both = np.arange(len(i.size))
            for n in np.flatnonzero(common(i, both, j, both) >= least_matches(i.size + j.size, least)).tolist():
                out[k + n] = difflib.SequenceMatcher(None, p[k + n], q[k + n]).ratio()
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    ship_package(SparkSession.getActiveSession())
    return ratio(a, b)


def title_similar(title: Column, target: str, least: float = 0.85) -> Column:
    """Whether a title's ratio to a fixed one, both in lower case, reaches `least`; lengths alone rule out most rows first."""
    low, n = F.lower(title), len(target)
    near = 2.0 * F.least(F.length(low), F.lit(n)) / F.greatest(F.length(low) + n, F.lit(1)) >= least
    return F.coalesce(title_ratio(F.lit(target.lower()), F.when(near, low), least) >= least, F.lit(False)) & F.coalesce(near, F.lit(False))


def similar_titles(docs: DataFrame, query: str, least: float = 0.7, limit: int = 50) -> DataFrame:
    """Titles by their ratio to the query; lengths alone rule out most rows before Python sees any."""
    title, n = F.lower("titulo"), len(query)
    bound = 2.0 * F.least(F.length(title), F.lit(n)) / (F.length(title) + n)
    d = docs.where(bound >= least).withColumn("ratio", title_ratio(F.lit(query.lower()), title, least))
    return d.where(F.col("ratio") >= least).orderBy(F.col("ratio").desc(), "doc_id").limit(limit)


def more_like(docs: DataFrame, doc_id: int, least: float = 0.5, limit: int = 5) -> DataFrame:
    """Other documents whose titles are alike; the target is one row."""
    target = docs.where(F.col("doc_id") == doc_id).select(F.lower("titulo").alias("target")).limit(1)
    d = docs.where(F.col("doc_id") != doc_id).crossJoin(F.broadcast(target))
    bound = 2.0 * F.least(F.length("titulo"), F.length("target")) / (F.length("titulo") + F.length("target"))
    d = d.where(bound >= least).withColumn("ratio", title_ratio(F.col("target"), F.lower("titulo"), least))
    return d.where(F.col("ratio") >= least).orderBy(F.col("ratio").desc(), "doc_id").limit(limit).drop("target")


def checked_pattern(pattern: str) -> str:
    """The pattern, or ValueError if it is too long, nests quantifiers or has over 3 back-references."""
    if len(pattern) > 500 or re.search(r"\([^)]*[+*?]\)[+*?]", pattern) or len(re.findall(r"\\[1-9]", pattern)) > 3:
        raise ValueError("pattern refused")
    re.compile(pattern)
    return pattern


def regex_search(docs: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    return docs.withColumn("text", corpus_text()).where(F.col("text").rlike("(?iU)" + checked_pattern(pattern))).orderBy("doc_id").limit(limit)


def highlight(c: Column, term: str, mark: str = "**") -> Column:
    return F.regexp_replace(c, r"(?iU)\Q" + term.replace(r"\E", "") + r"\E", f"{mark}$0{mark}")


def ranked_search(docs: DataFrame, terms: list[str], *, uf=None, year=None, topic=None, tipo=None, tier=None, limit: int = 10) -> DataFrame:
    d = docs.withColumn("text", corpus_text())
    for t in terms:
        d = d.where(F.contains("text", _term(t)))
    for column, value in (("uf", uf), ("tipo", tipo), ("severity_tier", tier)):
        d = d if value is None else d.where(F.col(column) == value)
    d = d if year is None else d.where(F.year("fetched_at") == year)
    d = d if topic is None else d.where(F.array_contains("topics", topic))
    return d.orderBy(F.coalesce("relevancia", F.lit(0)).desc(), F.col("fetched_at").desc(), "doc_id").limit(max(1, min(50, limit)))


def archive(docs: DataFrame, month: str | None = None, uf: str | None = None) -> DataFrame:
    d = docs if month is None else docs.where(F.date_format("data_publicacao", "yyyy-MM") == month)
    return d if uf is None else d.where(F.col("uf") == uf)


def favourites(docs: DataFrame, tag: str = "favorito", limit: int = 20) -> DataFrame:
    return docs.where(F.array_contains("user_tags", tag)).orderBy(F.col("fetched_at").desc(), "doc_id").limit(limit)


def bypass_listing(docs: DataFrame, sources: DataFrame, as_of=AS_OF, days: int = 30, k: int = 30) -> DataFrame:
    """Newest documents of bypass sources, and how many the limit leaves out."""
    own = sources.where("keywords_bypass").select(F.col("id").alias("source_id"))
    d = docs.where(F.col("eff_date") >= moment(as_of) - F.expr(f"INTERVAL '{days}' DAY")).join(own, "source_id", "left_semi")
    omitted = d.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - k).alias("omitted"))
    return d.orderBy(F.col("eff_date").desc(), "doc_id").limit(k).crossJoin(omitted)  # one row


def page(docs: DataFrame, *, since=None, status=None, uf=None, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of the corpus, newest first."""
    d = docs if since is None else docs.where(F.col("fetched_at") >= F.lit(since).cast("timestamp"))
    d = d if status is None else d.where(F.col("status") == status)
    d = d if uf is None else d.where(F.col("uf") == uf)
    return d.orderBy(F.col("fetched_at").desc(), "doc_id").offset(offset).limit(limit)


def by_id_prefix(docs: DataFrame, prefix: str) -> DataFrame:
    """The document of that id, or the one whose id alone starts with it; else nothing."""
    d = docs.where(F.col("doc_id").cast("string").startswith(prefix))
    exact = F.col("doc_id").cast("string") == prefix
    n = d.agg(F.count(F.lit(1)).alias("__n"), F.count_if(exact).alias("__exact"))
    return d.crossJoin(F.broadcast(n)).where(exact | ((F.col("__exact") == 0) & (F.col("__n") == 1))).drop("__n", "__exact")
