"""Quality rules: every rule is evaluated once, its failures kept as bits beside the measurements; policies (masks of
rules, by version) and ablations are then bit operations on that ledger. DataFrame functions only.

Nulls: a null text has no words. Empty tables give empty ledgers. Repeated rows are judged one by one and alike. Texts of any
length are measured whole. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import SEPARATORS

#: Rules in order of their bits, as SQL over the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "few_letters": "100 * n_letters < 60 * word_chars",
    "shouting": "100 * n_upper > 50 * n_letters",
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that they apply.
POLICIES = {"base-1": BASE, "full-1": tuple(RULES)}


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column) -> Column:
    """How many of the words stand in a 3-word window that occurs twice or more."""

    def of_sorted(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        twice = lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False))
        return _let(F.sort_array(F.transform(F.filter(at, twice), lambda j: F.get(s, j)["i"])), of_places)

    def of_places(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), x - F.get(p, k - 1)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(_let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)), of_sorted))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its text, as longs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _covered(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    d = docs.select("doc_id", of_words.alias("w"), of_lines.alias("l"), F.length(F.regexp_replace(text, SEPARATORS, "")).alias("word_chars"), (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"), F.length(F.regexp_replace(text, "\\P{L}+", "")).alias("n_letters"), F.length(F.regexp_replace(text, "\\P{Lu}+", "")).alias("n_upper"))
    names = {"n_words": "w.n_words", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_letters": "n_letters", "n_upper": "n_upper"}
    return d.select("doc_id", *[F.col(c).cast("long").alias(n) for n, c in names.items()])


def mask(rules) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failures`, whose bit i is set if rule i of RULES fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    return measure(docs).withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(rows: DataFrame, version: str = "full-1") -> DataFrame:
    """A ledger with base_failed and the verdict `kept` of a policy, which always has the base rules."""
    fails = lambda rules: F.col("failures").bitwiseAND(F.lit(mask(rules))) != 0
    return rows.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails({*BASE, *POLICIES[version]})).withColumn("policy", F.lit(version))


def ablations(rows: DataFrame, version: str = "full-1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would be kept without it. One aggregation."""
    own = mask(POLICIES[version])
    failed = F.col("failures").bitwiseAND(F.lit(own))
    counts = [F.struct(F.lit(r).alias("rule"), F.count_if(failed.bitwiseAND(F.lit(mask([r]))) != 0).alias("n_failed"), F.count_if(failed == mask([r])).alias("n_only")) for r in POLICIES[version]]
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.array(*counts).alias("r")).select("n_docs", F.inline("r"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
t AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM t) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '\P{L}+', '', 'g')) AS BIGINT) AS n_letters, CAST(length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS BIGINT) AS n_upper FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 8 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_letters < 60 * word_chars THEN 32 ELSE 0 END)
  + (CASE WHEN 100 * n_upper > 50 * n_letters THEN 64 ELSE 0 END) AS BIGINT) AS failures FROM m)
SELECT *, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, 'full-1' AS policy FROM b
"""
