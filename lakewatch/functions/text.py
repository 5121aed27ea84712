"""String, date and map helpers as columns; Unicode compatibility forms by an Arrow UDF on the rows that need it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their plain forms.
_ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


#: A character that a compatibility form or the stripping of marks may change and `plain` doesn't. Single characters and one range:
#: a class of many ranges takes ten times as long.
BEYOND_LATIN = r"[\u00A0¨ª\u00AD¯²³´µ¸¹º¼½¾×÷\u0100-\x{10FFFF}]"


def plain(c: Column) -> Column:
    """Latin letters without their accents; only text that has some is gone through letter by letter."""
    return F.when(c.rlike(r"[\u00C0-\u00FF]"), F.translate(c, _ACCENTED, _PLAIN)).otherwise(c)


#: A character that may be space, but for plain ones and newlines.
OTHER_SPACE = BEYOND_LATIN.replace("[", r"[\t\x0B\f\r\x85", 1)


def collapse(c: Column) -> Column:
    """Single spaces; text whose only spaces are plain ones and newlines, as most is, needs no class by property, which is slow."""
    few = F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"  +", " ")
    return F.trim(F.when(c.rlike(OTHER_SPACE), F.regexp_replace(c, r"(?U)\s+", " ")).otherwise(few))


def nfkc(c: Column) -> Column:
    """NFKC; only text with a character that it may change is sent to Python."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.coalesce(normal(F.when(c.rlike(BEYOND_LATIN), c)), c)


def _bare(s: str) -> str:
    d = unicodedata.normalize("NFKD", s)
    for k in set(d):  # a text has few different characters, and fewer marks
        if k > "\u02ff" and unicodedata.category(k) == "Mn":
            d = d.replace(k, "")
    return d


def unmarked(c: Column) -> Column:
    """Compatibility form without accents and other marks; only text beyond plain and accented Latin is sent to Python."""

    @F.pandas_udf("string")
    def bare(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else _bare(x))

    return F.coalesce(bare(F.when(c.rlike(BEYOND_LATIN), c)), plain(c))


def strip_controls(c: Column) -> Column:
    """Without characters of category C, but for newline, tab and carriage return."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]", "")


def search_form(c: Column) -> Column:
    """Compatibility form, lower case, no accents or other marks, nothing unprintable, single spaces."""
    return collapse(F.lower(F.regexp_replace(unmarked(F.coalesce(c, F.lit(""))), r"[\p{C}&&[^\s]]", "")))


def search_term(s: str) -> str:
    """`search_form` of one string, for terms that the caller gives."""
    return " ".join("".join(k for k in _bare(s) if k.isspace() or unicodedata.category(k)[0] != "C").lower().split())


def compare_form(c: Column) -> Column:
    """For titles: compatibility form, lower case, punctuation as space, single spaces."""
    return collapse(F.regexp_replace(F.lower(nfkc(c)), r"(?U)[^\w\s/]", " "))


def detection_form(c: Column, cap: int | None = None) -> Column:
    """For detectors: compatibility form without control characters; null is empty. The whole text is read, unless `cap` is
    given: then texts over `cap` bytes are read up to half of it."""
    c = F.coalesce(c, F.lit(""))
    c = c if cap is None else F.when(F.octet_length(c) > cap, F.substring(c, 1, cap // 2)).otherwise(c)
    return F.regexp_replace(nfkc(c), r"[\p{C}&&[^\s]]", "")


# Blocks that go with their content, and tags that stay.
DANGEROUS = ("script", "style", "iframe", "object", "embed", "noscript", "noembed", "applet", "frame", "frameset")
ALLOWED = ("p", "br", "ul", "ol", "li", "strong", "b", "em", "i", "u", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "code", "pre", "table", "thead", "tbody", "tr", "th", "td", "hr")


def sanitize_html(c: Column) -> Column:
    """Dangerous blocks with their content, comments, other tags and all attributes removed."""
    blocks = "|".join(DANGEROUS)
    c = F.regexp_replace(c, rf"(?is)<({blocks})\b[^>]*>.*?</\1\s*>", "")
    c = F.regexp_replace(c, rf"(?i)<({blocks})\b[^>]*/?>", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, rf"(?i)<(?!/?(?:{'|'.join(ALLOWED)})\b)/?[a-z!][^>]*>", "")
    return F.regexp_replace(c, rf"(?i)<(/?)({'|'.join(ALLOWED)})\b[^>]*>", "<$1$2>")


def lenient_timestamp(c: Column) -> Column:
    """ISO, dd/MM/yyyy or yyyyMMdd in UTC; anything else is null."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def effective_date(published: str = "data_publicacao", fetched: str = "fetched_at") -> Column:
    return F.coalesce(published, fetched)


def age_days(c: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(c)) / F.lit(86_400_000_000.0)


def duration_days(c: Column) -> Column:
    """`7d`, `2w`, `1m`, `1y` in days; anything else is null."""
    unit = F.create_map(*[F.lit(x) for x in ("d", 1, "w", 7, "m", 30, "y", 365)])
    part = lambda g: F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^(\d{1,3})([dwmy])$", g), F.lit(""))
    return F.expr("try_cast(NULL AS INT)") if c is None else part(1).cast("int") * F.try_element_at(unit, part(2))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# Fixed value: the notations of an act's number and year.
ACT_NOTATION = r"(?iU)(?:lei|decreto|portaria|resolu\w+|instru\w+|in)?\s*(?:n[ºo°.]?\s*)?(\d{1,3}(?:\.\d{3})*|\d{1,5})\s*[/.,\s\-de]+\s*(\d{4})"


def act_number(c: Column) -> Column:
    """Number and year of an act in any notation, as NUMBER/YEAR."""
    return F.concat_ws("/", F.replace(first_match(c, ACT_NOTATION), F.lit("."), F.lit("")), first_match(c, ACT_NOTATION, 2)).substr(1, 32)
