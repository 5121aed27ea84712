"""Secret scans: fixed patterns, and values in credential contexts by their guess cost.

Every value that follows a credential word is split into dictionary words, dates, repeats, keyboard walks and brute-force
spans so that the product of their guesses is least (dynamic programming over log10 guesses); from `least_guesses` on it
is reported as a span of kind `guess`. Everything is per text, in one pass, without a shuffle.

Nulls: a null text is empty: no spans, the digest of an empty list. Repeated rows get equal results; a null doc_id is kept.
Texts of any length are read whole and a value of any length is costed whole; its pieces that recur are found in time in
proportion to it. Empty tables give no rows. Offsets are code points, ends exclusive. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import map_arrow, texts, utf8

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses that make a value in a credential context a secret.
LEAST_GUESSES = 10.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret|auth)[_-]?key|credentials?|auth(?:orization)?)["']?"""
    r"""(?:\x20{0,3}(?::=|=>|[:=])\x20{0,3}(?:bearer\x20|basic\x20)?|\x20is\x20|\x20bearer\x20)["']?([^\s"'`<>]+)""",
    re.A | re.I,
)
# Common words of passwords, commonest first; their place is their number of guesses.
_WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc123 iloveyou princess football baseball sunshine shadow "
    "secret superman batman trustno1 hello freedom whatever summer winter spring autumn hunter killer pepper ginger cookie computer "
    "internet server database root test guest user default changeme example sample demo token key access private public service "
    "account company office love money angel star tiger eagle falcon silver golden purple orange yellow green black white red blue "
    "one two three four five six seven eight nine ten the and for you this that with from your have not are was all can has"
).split()
_LEET = str.maketrans("4301$@57", "aeolsast")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_BESIDE = {a + b for row in _ROWS for a, b in zip(row, row[1:])} | {a + b for x, y in zip(_ROWS, _ROWS[1:]) for i, b in enumerate(y) for a in x[i : i + 2]}
_BESIDE |= {p[::-1] for p in _BESIDE}
_YEAR, _MONTH, _DAY, _CUT = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])", r"[-/._]?"
#: The forms of a date, for a whole span: year first or last (there with 2 digits too), or a year alone.
_DATE = re.compile(rf"{_YEAR}{_CUT}{_MONTH}{_CUT}{_DAY}|(?:{_DAY}{_CUT}{_MONTH}|{_MONTH}{_CUT}{_DAY}){_CUT}(?:{_YEAR}|\d\d)|{_YEAR}", re.A)
_DATE_CHARS = frozenset("0123456789-/._")
#: log10 guesses of a date, a year, how often something repeats, and a walk: a key, a direction and a length; of one more span.
_ONE_DATE, _ONE_YEAR, _TIMES, _WALK, _STEP = math.log10(365 * 119), math.log10(119), 1.0, math.log10(47 * 4 * 8), math.log10(2)
_MOST_PERIOD = 8


@functools.lru_cache(maxsize=1)
def _ranks() -> tuple[dict[str, int], int]:
    """Each word's number of guesses, and the longest word's length: the words of passwords, then the whole words of 4 letters
    or more, and the parts of words of 5 or more, of an English and a multilingual byte-level BPE vocabulary in turn, each in its order, commonest first, so that
    prose costs little."""
    import public_tokenizers

    def words(name: str):
        with open(public_tokenizers.path(name), "rb") as lines:
            for token in (base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in lines):
                if len(token) >= 5 and token.lstrip(" ").isalpha():
                    yield token.lstrip(" ").lower()

    found = dict.fromkeys(_WORDS)
    for pair in itertools.zip_longest(words("byte_bpe_50k.tiktoken"), words("byte_bpe_multi_50k.tiktoken")):
        found.update((w, None) for w in pair if w)
    return {w: i + 1 for i, w in enumerate(found)}, max(map(len, found))


def _alphabet(value: str) -> float:
    """log10 of the characters that a brute-force search over the value's kinds of characters tries at each place."""
    kinds = ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33))
    return math.log10(sum(n for p, n in kinds if re.search(p, value)) or 1)


def _fixed_spans(value: str, low: str) -> dict[int, list[tuple[int, float]]]:
    """By their ends, the words and dates that stand anywhere in the value: (start, log10 guesses)."""
    n, (rank, longest) = len(value), _ranks()
    plain, found = low.translate(_LEET), {}
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.3)):
                if form[i:j] in rank:
                    cost = math.log10(rank[form[i:j]]) + extra * (low[i:j] != plain[i:j]) + 0.3 * (value[i:j] != low[i:j])
                    found.setdefault(j, []).append((i, cost))
        if value[i] in _DATE_CHARS:
            for j in range(i + 4, min(n, i + 10) + 1):
                if value[j - 1] not in _DATE_CHARS:
                    break
                if _DATE.fullmatch(value, i, j):
                    found.setdefault(j, []).append((i, _ONE_YEAR if j - i == 4 and value[i : i + 2] in ("19", "20") else _ONE_DATE))
    return found


def guesses(value: str) -> float:
    """log10 of the least guesses over all segmentations into words, dates, repeats, walks and brute-force spans; each further
    span costs a factor of 2.

    Words and dates are spans that are looked up. Repeats (of 1 to 8 characters, twice or more and 3 characters at least) and
    walks (3 characters or more, each beside the one before on the keyboard, or each the next or each the last of the alphabet)
    are states of the dynamic program, which may begin and end anywhere: all of it takes time in proportion to the value."""
    low, n, char = value.lower(), len(value), _alphabet(value)
    if len(low) != n:  # a character whose lower case is longer: told as it is
        low = value
    ends = _fixed_spans(value, low)
    best = [0.0] * (n + 1)
    brute = math.inf
    repeats = [[math.inf] * (n + 1) for _ in range(_MOST_PERIOD + 1)]
    same = [0] * (_MOST_PERIOD + 1)  # how many characters in a row equal the one a period before
    walk = {kind: [math.inf] * (n + 1) for kind in ("keys", 1, -1)}
    for j in range(1, n + 1):
        brute = min(brute, best[j - 1] + _STEP) + char
        least = min([brute, *(best[i] + cost + _STEP for i, cost in ends.get(j, ()))])
        for p in range(1, _MOST_PERIOD + 1):
            same[p] = same[p] + 1 if j > p and value[j - 1] == value[j - 1 - p] else 0
            if same[p] >= p:  # the last p characters repeat those before
                here = repeats[p][j - p]
                first = max(2, -(-3 // p)) * p
                if j >= first and same[p] >= first - p:
                    unit = value[j - p : j]
                    here = min(here, best[j - first] + _STEP + _alphabet(unit) * p + _TIMES)
                repeats[p][j] = here
                least = min(least, here)
        if j >= 2:
            a, b = low[j - 2], low[j - 1]
            for kind, own in walk.items():
                if not (a + b in _BESIDE if kind == "keys" else ord(b) - ord(a) == kind):
                    continue
                here = own[j - 1]
                if j >= 3 and (low[j - 3] + a in _BESIDE if kind == "keys" else ord(a) - ord(low[j - 3]) == kind):
                    here = min(here, best[j - 3] + _STEP + _WALK)
                own[j] = here
                least = min(least, here)
        best[j] = least
    return max(0.0, best[n] - _STEP)


def scan(text: str, least_guesses: float = LEAST_GUESSES) -> tuple[list[tuple[str, int, int]], float]:
    """Spans (kind, start, end) of a text by start, then kind; log10 guesses of its costliest value in a context."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)] + [("hex", *m.span()) for m in _HEX.finditer(text)]
    most = 0.0
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        if value:
            cost = guesses(value)
            most = max(most, cost)
            if cost >= least_guesses:
                found.append(("guess", m.start(1), m.start(1) + len(value)))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2])), most


def find_secrets(docs: DataFrame, least_guesses: float = LEAST_GUESSES) -> DataFrame:
    """doc_id; found: array of (kind, start, end, value); log10_guesses of the costliest value in a context."""

    def run(batches):
        for batch in batches:
            rows, most = [], []
            for text in texts(batch.column(1)):
                spans, cost = scan(text, least_guesses)
                rows.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in spans])
                most.append(cost)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
            yield pa.record_batch([batch.column(0), pa.array(rows, kind), pa.array(most, pa.float64())], names=["doc_id", "found", "log10_guesses"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, "doc_id long, found array<struct<kind: string, start: long, end: long, value: string>>, log10_guesses double")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and the guess figures."""
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, told), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] != "guess")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"), "log10_guesses")
