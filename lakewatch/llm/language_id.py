"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds a row of bits for each slot, two for each language: an n-gram's languages are the bits that
all of its slots share, so one look-up gives every language that contains it, and, by the second bit, those that have at
least a tenth of its greatest share. A text's score for a language is the number of its n-grams with the first bit plus
that with the second, each corrected for the false positives that the bit's fill lets through; the highest decides. The
second count keeps n-grams that have strayed into a language by single mislabelled or mixed texts from deciding.

N-grams are 4 bytes of the UTF-8 text, A-Z lower-cased, with everything but letters and bytes over 127 as a space; those
with two spaces in a row are left out. A language contains the n-grams with at least MIN_SHARE of its n-grams in the
training texts, whatever their share in others. Training reads the whole texts of at
most SAMPLE labelled documents, taken in order of a hash of doc_id; counting is distributed, and what reaches the driver
is bounded by 1 / MIN_SHARE n-grams a language.

Nulls: a text that is null or has no letter is `und` with score 0; a null lang trains nothing; a null doc_id trains
nothing and isn't held out. Without training rows every text is `und`. A text with letters but without a known n-gram gets
the commonest language with score 0. Ties go to the language that comes first. Repeated rows get equal results, and rows
that share a doc_id each their own. Texts of any length are read whole. Empty tables give no rows. Other columns are ignored
by `identify` and kept by `annotate` and `keep_identified`, but for lang_pred and score, which `annotate` replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import buffers, chunks, map_arrow, mix64, utf8

#: Labelled documents that train the filter, at most.
SAMPLE = 20_000
#: Least share of a language's n-grams that puts an n-gram in its filter.
MIN_SHARE = 2e-5
#: Share of an n-gram, by its greatest in a language, that sets a language's second bit.
STRONG = 0.1
#: N-grams whose numbers a task sums before it gives them.
COUNTED = 1 << 18
#: Slots of the filter and slots of an n-gram.
SLOTS, HASHES = 1 << 20, 2
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a run of texts as numbers, and how many there are before each text's start and the end."""
    x = _FOLD[data].astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    v = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    gap = x == 0x20
    pair = gap[:-1] & gap[1:]
    ok = ~(pair[:-2] | pair[1:-1] | pair[2:])
    for k in (1, 2, 3):  # none across texts
        at = offsets[1:-1] - k
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return v[ok], np.concatenate([[0], np.cumsum(ok)])[np.minimum(offsets, len(ok))]


def _slots(grams: np.ndarray):
    h = mix64(grams.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    for k in range(HASHES):
        yield ((h >> np.uint64(k * 24)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def gram_counts(labelled: DataFrame, counted: int = COUNTED) -> DataFrame:
    """(lang, gram, n) over whole texts; tasks sum their own first, `counted` rows at a time."""

    def summed(some):
        keys, n = map(np.concatenate, zip(*some))
        keys, own = np.unique(keys, return_inverse=True)
        return keys, np.bincount(own, n, len(keys)).astype(np.int64)

    def rows(names, keys, n):
        langs = pa.array(list(names), pa.string()).take(pa.array((keys >> np.uint64(32)).astype(np.int64)))
        return pa.record_batch([langs, pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    def run(batches):
        names, some, held = {}, [], 0
        for batch in batches:
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.uint64)
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets):
                at = offsets[i : j + 1]
                grams, upto = _ngrams(data[at[0] : at[-1]], at - at[0])
                some.append(np.unique(np.repeat(langs[i:j] << np.uint64(32), np.diff(upto)) | grams, return_counts=True))
                held += len(some[-1][0])
                if held >= counted:
                    some = [summed(some)]
                    held = len(some[0][0])
                    if 2 * held >= counted:
                        yield rows(names, *some[0])
                        some, held = [], 0
        if held:
            yield rows(names, *summed(some))

    return map_arrow(labelled.select("lang", utf8().alias("text")), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE, min_share: float = MIN_SHARE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, commonest first; filter of (SLOTS, words of 64 bits): a bit for each language that contains an n-gram, then one
    for each that has a strong share of it; false-positive rate of each bit)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = labelled.select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    counts = gram_counts(labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi"))  # `sample` ids at most
    share = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang").withColumn("share", F.col("n") / F.col("all")).where(F.col("share") >= min_share)
    rows = share.select("lang", "gram", "share", "n").toPandas()  # 1 / min_share rows a language at most
    if not len(rows):
        return [], np.zeros((SLOTS, 1), np.uint64), np.zeros(0)
    langs = rows.groupby("lang").n.sum().reset_index().sort_values(["n", "lang"], ascending=[False, True]).lang.tolist()
    strong = rows[rows.share >= STRONG * rows.groupby("gram").share.transform("max")]
    table = np.zeros((SLOTS, (2 * len(langs) + 63) // 64), np.uint64)
    rates = np.zeros(2 * len(langs))
    for i, (lang, own) in enumerate([(x, rows) for x in langs] + [(x, strong) for x in langs]):
        word, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
        for slot in _slots(own.gram[own.lang == lang].to_numpy(np.uint64)):
            table[slot, word] |= bit
        rates[i] = np.mean((table[:, word] & bit) != 0) ** HASHES
    return langs, table, rates


def annotate(docs: DataFrame, model=None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` (all columns) with lang_pred and score (the winner's share of the corrected counts), or columns of other `names`;
    columns of `docs` with these names are replaced."""
    langs, table, rates = model or train(docs)
    kept = docs.sparkSession.sparkContext.broadcast(table)
    columns = [c for c in docs.columns if c not in names]
    at_text = columns.index("text")

    def run(batches):
        table = kept.value
        for batch in batches:
            data, offsets = buffers(batch.column(at_text))
            pred, scores = [], []
            for i, j in chunks(offsets):
                at = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                grams, upto = _ngrams(part, at)
                mask = np.zeros((0, table.shape[1]), np.uint64)
                for k, slot in enumerate(_slots(grams)):
                    mask = mask & table[slot] if k else table[slot]
                total = np.diff(upto)
                hits = np.zeros((len(langs), j - i))
                for k in range(len(rates)):
                    sums = np.concatenate([[0], np.cumsum((mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1))])
                    count = sums[upto[1:]].astype(float) - sums[upto[:-1]]
                    hits[k % len(langs)] += np.maximum(0, (count - rates[k] * total) / (1 - rates[k]))
                for d in range(j - i):
                    if not langs or not _has_letter(part[at[d] : at[d + 1]].tobytes()):
                        pred.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        pred.append(langs[int(hits[:, d].argmax())])
                        scores.append(float(hits[:, d].max() / max(hits[:, d].sum(), 1e-9)))
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(scores, pa.float64())], names=[*columns, *names])

    own = docs.select(*columns)
    schema = own.withColumn(names[0], F.lit("")).withColumn(names[1], F.lit(0.0)).schema
    return map_arrow(own, run, schema)


def identify(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `docs`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return annotate(own, model or train(docs)).drop("text")


def keep_identified(docs: DataFrame, model=None) -> DataFrame:
    """Rows of `docs` (all columns) whose text has a language; those without a letter go."""
    taken = {c.lower() for c in docs.columns}
    pred, score = (next(n for n in (f"{name}_{k}" for k in range(len(taken) + 1)) if n not in taken) for name in ("own_pred", "own_score"))
    return annotate(docs, model or train(docs), (pred, score)).where(F.col(pred) != UNKNOWN).select(*docs.columns)
