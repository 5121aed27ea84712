"""Personal data: fixed patterns, and spans of a character-level bidirectional LSTM with CRF transitions.

The model reads overlapping windows: the text is laid in cells of half a window, and every cell with a digit, an at sign
or a written one, (at) or [at], is covered twice (all kinds that pass the exact check have one of these; a cell before and
after is read too). Each window is decoded by Viterbi; spans of one
kind that overlap or meet in two windows' common part are one span; of overlapping spans of different kinds those with the
greatest total lead are kept over the whole text (weighted interval scheduling). An exact check follows: a card has 13 to 19
digits and passes Luhn, a phone has 7 to 15, an address has its parts; a number grouped as a person's number (3-2-4 digits,
or 3.3.3-2) is told as `id` whatever the model took it for. What overlaps a fixed span isn't added.

Nulls: a null text is empty. Repeated rows get equal results; a null doc_id is kept. Texts of any length are read whole, empty
tables give no rows. Offsets are code points, ends exclusive. Other columns are ignored. Everything is per text, in one pass, without a shuffle.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.llm import pii_model
from lakewatch.llm.common import map_arrow, texts, utf8
from lakewatch.llm.pii_model import KINDS

#: Characters of a window; windows start at every half of it. Windows decoded at a time.
WINDOW, AT_ONCE = 96, 1024

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+|[(\[](?:at|AT)[)\]]")
_ID = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}")
#: Kinds of spans in order: those of the fixed patterns, then what only the model finds.
ORDER = (*KINDS, "id")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind, then start."""
    found = [("email", *m.span()) for m in _EMAIL.finditer(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return found


def plausible(kind: str, value: str) -> bool:
    """The exact check of a span that the model gives."""
    d = _digits(value)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+(?:@|\x20@\x20|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", value))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", value)) and all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return bool(re.fullmatch(r"[0-9](?:[\x20-]?[0-9])+", value)) and 13 <= len(d) <= 19 and luhn(d)
    return bool(re.fullmatch(r"(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{2,4}[\x20.-]?[0-9]{3,6}|0[0-9]{1,4}[\x20/-][0-9]{3,8}|\+[0-9][\x20().0-9-]+[0-9]", value)) and 7 <= len(d) <= 15


def _starts(text: str) -> list[int]:
    """Starts of the windows that cover each triggered cell, and the cells beside it, twice."""
    half = WINDOW // 2
    cells = set()
    for m in _TRIGGER.finditer(text):
        cells.update(range(m.start() // half - 1, (m.end() - 1) // half + 2))
    last = max(0, (len(text) - 1) // half)
    return sorted({c * half for k in cells for c in (k - 1, k) if 0 <= c <= last})


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(kind, start, end, lead) of all windows -> the spans of the whole text: one kind's overlapping spans joined, then
    the choice of spans without overlap whose leads' sum is greatest."""
    joined: list[list] = []
    for k, a, b, w in sorted(spans):
        if joined and joined[-1][0] == k and a <= joined[-1][2] and (a < joined[-1][2] or b == a):
            joined[-1][2], joined[-1][3] = max(joined[-1][2], b), max(joined[-1][3], w)
        else:
            joined.append([k, a, b, w])
    joined.sort(key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in joined]
    best, take = [0.0], []
    for i, (_, a, _, w) in enumerate(joined):
        j = bisect.bisect_right(ends, a, 0, i)
        take.append(j if best[j] + max(w, 1e-6) > best[i] else None)
        best.append(max(best[i], best[j] + max(w, 1e-6)))
    out, i = [], len(joined)
    while i:
        if take[i - 1] is None:
            i -= 1
        else:
            out.append(tuple(joined[i - 1][:3]))
            i = take[i - 1]
    return out[::-1]


def _window_spans(tags: np.ndarray, lead: np.ndarray, at: int):
    """(kind, start, end, lead) of one window's tags, places in the text."""
    i, n = 0, len(tags)
    while i < n:
        if not tags[i]:
            i += 1
            continue
        kind, j = (tags[i] - 1) // 2, i + 1
        while j < n and tags[j] == 2 + 2 * kind:
            j += 1
        yield int(kind), at + i, at + j, float(lead[i:j].sum())
        i = j


def model_spans(model: pii_model.Model, batch: list[str]) -> list[list[tuple[str, int, int]]]:
    """The model's spans of each text, checked."""
    coded: dict[int, np.ndarray] = {}
    windows = []
    for d, text in enumerate(batch):
        if starts := _starts(text):
            coded[d] = pii_model.classes(text)
            windows += [(d, a) for a in starts]
    found: list[list] = [[] for _ in batch]
    for k in range(0, len(windows), AT_ONCE):
        some = windows[k : k + AT_ONCE]
        seq = np.zeros((len(some), WINDOW), np.uint8)
        for r, (d, a) in enumerate(some):
            part = coded[d][a : a + WINDOW]
            seq[r, : len(part)] = part
        tags, lead = pii_model.decode(model, seq)
        for r in np.flatnonzero(tags.any(1)):
            d, a = some[r]
            found[d] += _window_spans(tags[r], lead[r], a)
    told = lambda k, value: "id" if _ID.fullmatch(value) else KINDS[k] if plausible(KINDS[k], value) else None
    return [[(kind, a, b) for k, a, b in reconcile(s) if (kind := told(k, text[a:b]))] if s else [] for s, text in zip(found, batch)]


def spans_of(model: pii_model.Model, batch: list[str]) -> list[list[tuple[str, int, int, str]]]:
    """(kind, start, end, origin) of each text, by kind, then start; origin is base or model."""
    out = []
    for text, more in zip(batch, model_spans(model, batch)):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
        free = lambda a, b: not (i := bisect.bisect_left(taken, (b,))) or reach[i - 1] <= a
        rows = [(*s, "base") for s in base] + [(k, a, b, "model") for k, a, b in more if free(a, b)]
        out.append(sorted(rows, key=lambda s: (ORDER.index(s[0]), s[1], s[2])))
    return out


def find_pii(docs: DataFrame, model: pii_model.Model | None = None) -> DataFrame:
    """doc_id; found: array of (kind, start, end, origin, value)."""
    sent = docs.sparkSession.sparkContext.broadcast(model or pii_model.trained())

    def run(batches):
        for batch in batches:
            rows, strings = [], texts(batch.column(1))
            for i in range(0, len(strings), 256):
                part = strings[i : i + 256]
                rows += [[{"kind": k, "start": a, "end": b, "origin": o, "value": t[a:b]} for k, a, b, o in s] for s, t in zip(spans_of(sent.value, part), part)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("origin", pa.string()), ("value", pa.string())]))
            yield pa.record_batch([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, "doc_id long, found array<struct<kind: string, start: long, end: long, origin: string, value: string>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, all spans, how many the model added and how many there are."""
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, told), ",")
    count = lambda k: F.size(F.filter("found", lambda s: (s["kind"] == k) & (s["origin"] == "base"))).cast("long")
    base = F.filter("found", lambda s: s["origin"] == "base")
    added = F.size(F.filter("found", lambda s: s["origin"] == "model")).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("found").alias("spans"), added.alias("n_added"), F.size("found").cast("long").alias("n_spans"))
