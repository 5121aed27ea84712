"""Quality classifier: a generalised additive model with pairwise interactions, trained by cyclic boosting.

Every feature is cut into bins at quantiles. Boosting goes round the features: each in turn gets a shallow tree on its bins,
fitted to the current gradient, and the tree is added to the feature's look-up table. Then the pairs of features whose
tables would gain most get shallow trees on their common bins in the same way. A score is the sigmoid of the sum of the
looked-up values, for a batch of documents at a time.

Training takes at most SAMPLE labelled rows (in order of a hash of doc_id), never the held-out ones; their features are
computed by Spark and only the numbers come to the driver. Nulls: a null text is empty; a null label trains nothing; a
null doc_id trains nothing and isn't held out. Without rows of both labels every score is the share of label 1 (a half
without rows). Several labels of a doc_id count as rows of their own. Texts without words have features and a score like
any others; those of any length are read whole. Repeated rows get equal scores. Empty tables give no rows. Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import buffers, chunks, map_arrow, span_hashes, utf8, word_spans

SAMPLE = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 8, 120, 6, 40, 0.15
NAMES = (
    "log_words", "word_length", "word_length_sd", "longest_word", "symbols", "exclamations", "pipes", "upper", "digits", "marks", "beyond_ascii",
    "words_a_line", "duplicate_lines", "distinct_words", "repeated_triples", "commonest_word", "short_words", "capitalised", "words_a_stop",
)

_KIND = np.zeros((8, 256), bool)
for _row, _chars in enumerate((b"#*$%&<>{}[]^~@=_\\/", b"!", b"|", bytes(range(65, 91)), b"0123456789", b".,;:?!\"'()", bytes(range(128, 192)), b".?!")):
    _KIND[_row, list(_chars)] = True


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share_repeated(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: distinct values, and the count of its commonest."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    starts = np.flatnonzero(new)
    counts = np.diff(np.concatenate([starts, [len(h)]]))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[starts], counts)
    return np.bincount(d[starts], minlength=n), most


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, NAMES) features of a run of texts."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = []
    for k in range(len(_KIND)):
        upto = np.concatenate([[0], np.cumsum(_KIND[k][data])])
        counts.append(upto[offsets[1:]] - upto[offsets[:-1]])
    symbols, exclamations, pipes, upper, digits, marks, beyond, stops = counts
    starts, ends = word_spans(data, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    length = (ends - starts).astype(float)
    words = np.bincount(doc, minlength=n)
    w, chars = np.maximum(1, words), np.maximum(1, size)
    total, squares = np.bincount(doc, length, n), np.bincount(doc, length**2, n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    lines = newlines[offsets[1:]] - newlines[offsets[:-1]] + 1
    out = [np.log1p(words), total / w, np.sqrt(np.maximum(0, squares / w - (total / w) ** 2)), longest, symbols / w, exclamations / w, pipes / w, upper / chars, digits / chars, marks / w, beyond / chars, words / lines]
    if len(starts):
        hashes = span_hashes(data, starts, ends, lower=True)
        number = newlines[starts] - newlines[offsets[doc]]
        head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])])
        first = np.flatnonzero(head)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * (np.uint64(2) * (np.arange(len(hashes)) - first[np.cumsum(head) - 1]).astype(np.uint64) + np.uint64(1)))])
        of_line = sums[np.concatenate([first[1:], [len(hashes)]])] - sums[first]
        solid = np.maximum(1, np.bincount(doc[first], minlength=n))
        distinct_lines, _ = _share_repeated(of_line, doc[first], n)
        distinct, most = _share_repeated(hashes, doc, n)
        triple = (hashes[:-2] + hashes[1:-1] * np.uint64(3) + hashes[2:] * np.uint64(7)) if len(hashes) > 2 else hashes[:0]
        inside = doc[:-2] == doc[2:] if len(hashes) > 2 else np.zeros(0, bool)
        triples = np.bincount(doc[: len(triple)][inside], minlength=n)
        distinct_triples, _ = _share_repeated(triple[inside], doc[: len(triple)][inside], n) if inside.any() else (triples, None)
        capital = np.bincount(doc, _KIND[3][data[starts]], n)
        out += [(solid - distinct_lines) / solid * (words > 0), distinct / w, (triples - distinct_triples) / np.maximum(1, triples), most / w, np.bincount(doc, length <= 3, n) / w, capital / w, words / (stops + 1)]
    else:
        out += [np.zeros(n)] * 7
    return np.stack(out, 1)


@dataclass
class Gam:
    cuts: list[np.ndarray]
    tables: np.ndarray  # (features, BINS)
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray  # (pairs, PAIR_BINS, PAIR_BINS)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
        total = np.full(len(x), self.base)
        for f, b in enumerate(bins):
            total += self.tables[f][b]
        for t, (f, g) in zip(self.pair_tables, self.pairs):
            total += t[bins[f] * PAIR_BINS // BINS, bins[g] * PAIR_BINS // BINS]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values by bin of a tree of `leaves` leaves on the bins' sums of gradient and hessian: best splits first."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in parts:
            for c in range(a + 1, b):
                won = gain(a, c) + gain(c, b) - gain(a, b)
                if won > best[0]:
                    best = (won, (a, b), c)
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 4.0) -> tuple[np.ndarray, float]:
    """Values of the best tree with one cut of each of two features' bins (four leaves), and its gain."""
    best = (1e-9, None)
    cg, ch = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1), np.pad(h, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    n = len(g)
    for a in range(1, n):
        for b in range(1, n):
            gs = [cg[a, b], cg[a, n] - cg[a, b], cg[n, b] - cg[a, b], cg[n, n] - cg[a, n] - cg[n, b] + cg[a, b]]
            hs = [ch[a, b], ch[a, n] - ch[a, b], ch[n, b] - ch[a, b], ch[n, n] - ch[a, n] - ch[n, b] + ch[a, b]]
            won = sum(x * x / (y + ridge) for x, y in zip(gs, hs))
            if won > best[0]:
                best = (won, (a, b, [x / (y + ridge) for x, y in zip(gs, hs)]))
    out = np.zeros_like(g)
    if best[1]:
        a, b, v = best[1]
        out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
    return out, best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of features x (rows, features) and labels y (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    flat = Gam([np.zeros(0)] * x.shape[1], np.zeros((x.shape[1], BINS)), [], np.zeros((0, PAIR_BINS, PAIR_BINS)), float(np.log(np.clip(share, 1e-3, 0.999) / (1 - np.clip(share, 1e-3, 0.999)))))
    if share in (0.0, 1.0) or len(y) < 2:
        return flat
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    coarse = [b * PAIR_BINS // BINS for b in bins]
    total, tables = np.full(len(y), flat.base), np.zeros((x.shape[1], BINS))
    slope = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slope()
            step = RATE * _tree(np.bincount(b, g, BINS), np.bincount(b, h, BINS))
            tables[f] += step
            total += step[b]
    g, h = slope()
    at = lambda f, k: coarse[f] * PAIR_BINS + coarse[k]
    sums = lambda f, k, v: np.bincount(at(f, k), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = sorted(((-_pair_tree(sums(f, k, g), sums(f, k, h))[1], (f, k)) for f, k in combinations(range(x.shape[1]), 2)))
    pairs = [p for _, p in gains[:PAIRS]]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for t, (f, k) in zip(pair_tables, pairs):
            g, h = slope()
            step = RATE * _pair_tree(sums(f, k, g), sums(f, k, h))[0]
            t += step
            total += step[coarse[f], coarse[k]]
    return Gam(cuts, tables, pairs, pair_tables, flat.base)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and x, the features of the text in order of NAMES."""
    return _per_text(docs, measures, pa.list_(pa.float64()), "x array<double>")


def _per_text(docs: DataFrame, fn, kind, column: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            rows = [fn(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
            values = np.concatenate(rows) if rows else np.zeros(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(values.tolist(), kind)], names=["doc_id", "held_out", column.split()[0]])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), utf8().alias("text")), run, f"doc_id long, held_out boolean, {column}")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """The model of the labelled documents that aren't held out, at most `sample` label rows."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality").limit(sample)
    own = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # `sample` ids at most
    rows = measured(own.select("doc_id", "text")).join(chosen, "doc_id").orderBy("doc_id", "quality", "x").select("x", "quality").limit(sample).toPandas()
    x = np.array(rows.x.tolist(), float).reshape(-1, len(NAMES))
    return fit(x, rows.quality.to_numpy(float))


def score(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = _per_text(docs, lambda data, offsets: sent.value.score(measures(data, offsets)), pa.float64(), "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
