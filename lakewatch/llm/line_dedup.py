"""Line dedup by an exact set-similarity join.

A line is a part of a text between newlines; its tokens are the set of its words, A-Z lower-cased. A line with words is
removed if a line at an earlier place, by (doc_id, line number), has a Jaccard similarity of `threshold` or more to it,
whether or not that one is removed itself. So the first of every group of alike lines stays.

1. One scan gives every line's place with a 128-bit key of its word sequence, and the tokens' counts in a table sized by
   the input (a hashed token's count orders it; any fixed order keeps the join exact). Lines with a key seen at an earlier
   place go; within a task they are found at once, so of a line on every page only a row for each task is shuffled.
2. A second scan sorts each line's tokens by rarity and gives its prefix of n - ceil(threshold * n) + 1 tokens, for the
   first line of each key, without tokens that stand in one line only. A token in over `dense` lines is no key by itself:
   two alike lines share a second token in the prefix that is one longer, so the pairs of both are the keys.
3. Keys travel in packed blocks, a task's keys of one range of them each; a key's row takes some 20 bytes in them, however many
   tasks the keys are dealt to. Each key's list, in order of place, shows every line the list's first `block` ones. Length and positional filters, and
   a bound from token signatures of 64 to 256 bits, leave candidates; a line stops looking after `most` of them.
4. The candidates' lines are fetched and their Jaccard verified, the most alike first. Lines that found no match and have
   not seen all of a list go on in it, in blocks eight times larger each round, until none is left: a dense list costs its
   length, not its square.

Nulls: rows with a null doc_id or text stay as they are. Rows that share a doc_id are one document: what is removed from
one is removed from all, and equal places don't remove each other. Blank lines are never removed. Empty tables give empty
tables. Very long lines have as many tokens as they have words; nothing is cut. All columns of `docs` are kept, also those
named like the ones used inside; n_chars, if there is one, follows the text.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewatch.llm.common import BROADCAST_BYTES, buffers, chunks, discard, map_arrow, materialize, mix64, powers, sized_join, span_hashes, utf8, word_spans

THRESHOLD = 0.8
#: Bytes of text for each slot of the token-count table, and its least and greatest size as powers of 2.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS = 256, 16, 24
#: Parts in which tasks hand over the table.
PARTS = 32
#: Lines with a token from which it is a key only together with a second one.
DENSE = 1024
#: Bits of a key: enough to tell keys apart; lists that share one by chance only cost comparisons.
KEY_BITS = 40
#: Ranges of keys that are dealt to tasks, and keys that a task packs into blocks at a time.
RANGES, PACKED = 1024, 1 << 17
#: Tokens of a line above which its signature has 128 bits and 256 bits; it has 64 else.
WIDER, WIDEST = 48, 144
#: Earlier lines of a key's list that are looked at first, and the candidates after which a line stops looking.
BLOCK, MOST = 256, 8
#: Lines whose earliest place a task remembers, to give repeated ones once; then it starts anew (which only costs rows).
REMEMBERED = 1 << 17
#: Rows that a task puts in order at a time at least, if ranges of keys are small, and rows of a range up to which it does so.
GROUPED, HELD = 1 << 16, 1 << 21


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Of the lines with words in a run of texts: their words' 64-bit hashes, one line after the other; each line's
    document, number in it, first word and end."""
    starts, ends = word_spans(data, offsets)
    newlines = np.flatnonzero(data == 10)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    number = np.cumsum(np.bincount(np.searchsorted(starts, newlines), minlength=len(starts)))[: len(starts)] - np.searchsorted(newlines, offsets)[doc]
    cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(number) != 0)) + 1
    a = np.concatenate([[0], cut]) if len(starts) else cut
    return span_hashes(data, starts, ends, lower=True), doc[a], number[a].astype(np.int32), a, np.concatenate([cut, [len(starts)]])[: len(a)]


def _runs(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(line)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(line)]])


def _by_line(line: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The order by line, then token, of tokens whose lines ascend: by one number of both, which is fast, unless it ties tokens that
    differ."""
    bits = np.uint64(max(1, int(line[-1] - line[0]).bit_length())) if len(line) else np.uint64(1)
    both = (line - line[:1]).astype(np.uint64) << (np.uint64(64) - bits) | token >> bits
    order = np.argsort(both)
    tied = both[order[1:]] == both[order[:-1]]
    return np.lexsort((token, line)) if (tied & (token[order[1:]] != token[order[:-1]])).any() else order


def _keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each run of words, in order."""
    up, down = powers(len(hashes) + 1)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix64(hashes ^ np.uint64(salt)) * up[: len(hashes)], out=sums[1:])
        out.append(mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


class _Firsts:
    """The earliest place of each line that a task has seen."""

    def __init__(self):
        self.places: dict[bytes, int] = {}

    def fresh(self, k1: np.ndarray, k2: np.ndarray, doc_ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Whether each line stands at an earlier place than all of its kind so far."""
        if len(self.places) > REMEMBERED:
            self.places.clear()
        out, places = np.zeros(len(k1), bool), self.places
        for x, (key, d, k) in enumerate(zip(np.stack([k1, k2], 1).view("V16")[:, 0].tolist(), doc_ids.tolist(), lines.tolist())):
            place = d << 32 | k
            known = places.get(key)
            if known is None or place < known:
                places[key], out[x] = place, True
            elif place == known:
                out[x] = True
        return out


def table_slots(docs: DataFrame) -> int:
    """Slots of the token-count table by the optimizer's estimate of the bytes to read, a power of 2 between bounds."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # not known
        size = SLOT_BYTES << 20
    return 1 << min(MOST_SLOTS, max(LEAST_SLOTS, (size // SLOT_BYTES).bit_length()))


def _occurrences(docs: DataFrame, slots: int) -> DataFrame:
    """kind 0: key (k1, k2) and place of each line that is the first of its kind in the task so far; kind 2: places of the
    others, which have an earlier equal; kind 1: the task's numbers of tokens by slot, a part (k1) of the table a row."""
    names = ["kind", "k1", "k2", "doc_id", "line", "counts"]

    def rows(kind, k1, k2, doc_id, line):
        return pa.record_batch([pa.array(np.full(len(k1), kind, np.int8)), pa.array(k1), pa.array(k2), pa.array(doc_id, pa.int64()), pa.array(line, pa.int32()), pa.nulls(len(k1), pa.binary())], names=names)

    def run(batches):
        counts, firsts = np.zeros(slots, np.uint32), _Firsts()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets):
                at = offsets[i : j + 1]
                hashes, doc, number, a, b = _lines(data[at[0] : at[-1]], at - at[0])
                if len(hashes):
                    np.add.at(counts, _slot(hashes, slots), np.uint32(1))
                    k1, k2 = _keys(hashes, a, b)
                    own = ids[i:j][doc]
                    new = firsts.fresh(k1, k2, own, number)
                    yield rows(0, k1[new], k2[new], own[new], number[new])
                    none = np.zeros(int((~new).sum()), np.int64)
                    yield rows(2, none, none, own[~new], number[~new])
        if counts.any():
            parts = [zlib.compress(c.astype("<u4").tobytes(), 1) for c in counts.reshape(PARTS, -1)]
            none = np.zeros(PARTS, np.int64)
            yield pa.record_batch([pa.array(np.ones(PARTS, np.int8)), pa.array(np.arange(PARTS)), pa.array(none), pa.array(none), pa.array(none.astype(np.int32)), pa.array(parts, pa.binary())], names=names)

    return map_arrow(docs, run, "kind byte, k1 long, k2 long, doc_id long, line int, counts binary")


def _table(parts: DataFrame, slots: int) -> np.ndarray:
    """A byte for each slot, 8 times the base-2 logarithm of its count and one, rounded up, from the tasks' parts (k1, counts):
    each part is summed by one task as its rows stream in."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
                sums[k] = sums[k] + more if k in sums else more
        coded = [np.minimum(255, np.ceil(8 * np.log2(v + 1))).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array(coded, pa.binary())], names=["k1", "rarity"])

    rows = map_arrow(parts.repartition(PARTS, "k1"), run, "k1 long, rarity binary", rows=64).collect()  # PARTS rows, a table in all
    table = np.zeros((PARTS, slots // PARTS), np.uint8)
    for r in rows:
        table[r.k1] = np.frombuffer(r.rarity, np.uint8)
    return table.reshape(-1)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _line_keys(token: np.ndarray, count: np.ndarray, a: np.ndarray, n: np.ndarray, threshold: float, dense: int):
    """(line, key, i) of lines whose tokens by rarity start at `a`, n each: a prefix token and its place; for a dense one its
    pairs with a later token, where i says how many of the line's tokens are past both, as if it were a token's place."""
    lines, place = np.repeat(np.arange(len(a)), n), np.arange(len(token)) - np.repeat(a, n)
    prefix = np.repeat(_prefix(n, threshold), n)
    key = (place < prefix) & (count > 1)
    pairs = key & (count > dense) & (np.repeat(n, n) > 1) if threshold > 0.5 else np.zeros(len(key), bool)
    one, two = np.flatnonzero(key & ~pairs), np.flatnonzero(pairs)
    more = np.minimum(prefix[two] + 1, np.repeat(n, n)[two]) - place[two] - 1  # later tokens of the prefix that is one longer
    first = np.repeat(two, more)
    second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
    first, second = first[count[second] > 1], second[count[second] > 1]
    own = np.concatenate([one, first])
    keys = np.concatenate([mix64(token[one]), mix64(token[first] ^ mix64(token[second]))])
    return lines[own], keys >> np.uint64(64 - KEY_BITS), np.concatenate([place[one], place[second] - 1])


SIGNATURE = ("s0", "s1", "s2", "s3")
#: A key's row: the line's place, its number of tokens n and the key's place i among them in one number, its signature.
POSTING = ("token", "doc_id", "line", "ni", *SIGNATURE)


def _signatures(token: np.ndarray, a: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Four words a line with a bit flipped for each token; shorter lines' words are folded into two or one, the others 0."""
    word, bit = (token >> np.uint64(6)) & np.uint64(3), np.uint64(1) << (token & np.uint64(63))
    w = [np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), a) for k in range(4)]
    two, one = n <= WIDEST, n <= WIDER
    w = [np.where(two, w[0] ^ w[2], w[0]), np.where(two, w[1] ^ w[3], w[1]), np.where(two, np.uint64(0), w[2]), np.where(two, np.uint64(0), w[3])]
    return [np.where(one, w[0] ^ w[1], w[0]).view(np.int64), np.where(one, np.uint64(0), w[1]).view(np.int64), w[2].view(np.int64), w[3].view(np.int64)]


def _scanned(batches, rank: np.ndarray, threshold: float, dense: int):
    """The lines with keys that are the first of their kind in the task so far: place, number of tokens, signature, and the keys, each
    with its place among the tokens in the low bits (a place beyond them is given as less, which only loosens a filter)."""
    firsts = _Firsts()
    most = np.floor(2 ** (np.arange(256) / 8)).astype(np.int64) - 1  # the count that a rarity stands for, at most
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = buffers(batch.column(1))
        for i, j in chunks(offsets):
            at = offsets[i : j + 1]
            hashes, doc, number, a, b = _lines(data[at[0] : at[-1]], at - at[0])
            if not len(hashes):
                continue
            fresh = firsts.fresh(*_keys(hashes, a, b), ids[i:j][doc], number)
            word = np.repeat(fresh, b - a)
            if not word.any():
                continue
            own, h = np.repeat(np.arange(len(a)), b - a)[word], hashes[word]
            rarity = rank[_slot(h, len(rank))]
            token = (rarity.astype(np.uint64) << np.uint64(55)) | (mix64(h) >> np.uint64(9))
            order = _by_line(own, token)
            own, token, rarity = own[order], token[order], rarity[order]
            once = np.concatenate([[True], (own[1:] != own[:-1]) | (token[1:] != token[:-1])])
            own, token, rarity = own[once], token[once], rarity[once]
            a, b = _runs(own)
            n, rows = b - a, own[a]
            sig = _signatures(token, a, n)
            line, key, place = _line_keys(token, most[rarity], a, n, threshold, dense)
            order = np.argsort(line, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(a)))])
            words = key[order] << np.uint64(64 - KEY_BITS) | np.minimum(place[order], (1 << 64 - KEY_BITS) - 1).astype(np.uint64)
            keys = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(words.astype("<u8"))])
            batch_out = pa.record_batch([pa.array(ids[i:j][doc[rows]]), pa.array(number[rows]), pa.array(n.astype(np.int32)), *map(pa.array, sig), keys], names=["doc_id", "line", "n", *SIGNATURE, "keys"])
            yield batch_out.filter(pa.array(np.diff(ends) > 0))


def _line_postings(docs: DataFrame, told, threshold: float, dense: int) -> DataFrame:
    """`_scanned` as a table; `told` broadcasts the table of counts."""
    return map_arrow(docs, lambda batches: _scanned(batches, told.value, threshold, dense), "doc_id long, line int, n int, s0 long, s1 long, s2 long, s3 long, keys binary")


class _Places:
    """Some places, in order, and which of others are among them."""

    def __init__(self, doc_id: np.ndarray, line: np.ndarray):
        self.docs, doc = np.unique(doc_id, return_inverse=True)
        self.places = np.sort(doc.astype(np.int64) << 32 | line)

    def hold(self, doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
        if not len(self.docs):
            return np.zeros(len(doc_id), bool)
        doc = np.minimum(np.searchsorted(self.docs, doc_id), len(self.docs) - 1)
        place = doc << 32 | line
        at = np.minimum(np.searchsorted(self.places, place), len(self.places) - 1)
        return (self.docs[doc] == doc_id) & (self.places[at] == place)


def _pack(columns: list[np.ndarray]):
    """(range of keys, rows, block) of rows with POSTING columns. A block holds its rows in order of key, the key as what it is more
    than the one before, and of each column the lowest bytes together, then the next, so that what is zero takes no room."""
    order = np.argsort(columns[0])
    token = columns[0][order]
    width = KEY_BITS - (RANGES - 1).bit_length()
    part = token >> width
    starts, ends = _runs(part)
    steps = np.diff(token, prepend=0)
    steps[starts] = token[starts] - (part[starts] << width)
    planes = np.empty((len(columns), 8, len(token)), np.uint8)
    for k, c in enumerate(columns):
        planes[k] = (c[order] if k else steps).astype("<i8").view(np.uint8).reshape(-1, 8).T
    codec = pa.Codec("zstd", compression_level=1)
    for a, b in zip(starts, ends):
        yield int(part[a]), int(b - a), codec.compress(np.ascontiguousarray(planes[:, :, a:b]), asbytes=True)


def _unpack(part: int, rows: int, block: bytes) -> np.ndarray:
    """The POSTING columns of a block."""
    return _unpack_all([(part, rows, block)])


def _unpack_all(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The POSTING columns of blocks, one after the other."""
    parts, rows = (np.array([b[k] for b in blocks], np.int64) for k in (0, 1))
    ends = np.cumsum(rows)
    out = np.empty((len(POSTING), int(ends[-1])), "<i8")
    planes, codec = out.view(np.uint8).reshape(len(POSTING), -1, 8), pa.Codec("zstd")
    for (_, n, block), b in zip(blocks, ends.tolist()):
        planes[:, b - n : b] = np.frombuffer(codec.decompress(block, 64 * n, asbytes=True), np.uint8).reshape(len(POSTING), 8, n).transpose(0, 2, 1)
    sums = np.concatenate([[0], np.cumsum(out[0])])
    out[0] = sums[1:] + np.repeat((parts << KEY_BITS - (RANGES - 1).bit_length()) - sums[ends - rows], rows)
    return out


def _packed(batches, gone: _Places | None = None):
    """(part, rows, block) of what `_scanned` gives, PACKED keys or more at a time, without the lines at `gone`."""

    def packed(some):
        parts, rows, blocks = zip(*_pack([np.concatenate(c) for c in zip(*some)]))
        return pa.record_batch([pa.array(parts, pa.int32()), pa.array(rows, pa.int32()), pa.array(blocks, pa.binary())], names=["part", "rows", "block"])

    some, held = [], 0
    for batch in batches:
        if gone is not None:
            batch = batch.filter(pa.array(~gone.hold(batch.column(0).to_numpy(), batch.column(1).to_numpy())))
        doc_id, line, n, *sig = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        data, offsets = buffers(batch.column(7))
        words, own = data.view("<u8"), np.repeat(np.arange(len(n)), np.diff(offsets) // 8)
        token, i = (words >> np.uint64(64 - KEY_BITS)).view(np.int64), (words & np.uint64((1 << 64 - KEY_BITS) - 1)).view(np.int64)
        some.append([token, doc_id[own], line[own], n[own].astype(np.int64) << 32 | i, *[s[own] for s in sig]])
        held += len(own)
        if held >= PACKED:
            yield packed(some)
            some, held = [], 0
    if held:
        yield packed(some)


def _blocks(docs: DataFrame, table: np.ndarray, repeated: DataFrame, threshold: float, dense: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(part, rows, block): the keys of the first line of each kind, packed by range of keys; lines of `repeated`, which other tasks
    have, too, have none. They are left out in the scan that packs the keys if they are few enough for a broadcast, else by a join."""
    sc, schema = docs.sparkSession.sparkContext, "part int, rows int, block binary"
    told = sc.broadcast(table)  # a byte a slot
    if repeated.count() * 48 <= broadcast_bytes:
        rows = repeated.toArrow()
        gone = sc.broadcast(_Places(rows.column("doc_id").to_numpy(), rows.column("line").to_numpy()))
        return map_arrow(docs, lambda batches: _packed(_scanned(batches, told.value, threshold, dense), gone.value), schema)
    first = _line_postings(docs, told, threshold, dense).join(repeated, ["doc_id", "line"], "left_anti")
    return map_arrow(first.select("doc_id", "line", "n", *SIGNATURE, "keys"), _packed, schema)


def _postings(blocks: DataFrame) -> DataFrame:
    """POSTING columns of packed keys, all rows of a key in one partition."""

    def run(batches):
        for batch in _unpacked(batches):
            yield pa.record_batch([pa.array(c.astype(np.int32) if name == "line" else c) for name, c in zip(POSTING, batch)], names=list(POSTING))

    return map_arrow(blocks.repartition("part"), run, "token long, doc_id long, line int, ni long, s0 long, s1 long, s2 long, s3 long")


def _unpacked(batches, rows: int = 1 << 15):
    """The columns of as many blocks at a time as have `rows` rows."""
    some, n = [], 0
    for block in _rows(batches):
        some.append(block)
        n += block[1]
        if n >= rows:
            yield _unpack_all(some)
            some, n = [], 0
    if n:
        yield _unpack_all(some)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(3)))


def _in_order(token: np.ndarray, doc_id: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order by token, then place: by one number for each, which is fast, where 63 bits hold them."""
    span = lambda x: (int(x.max()) - int(x.min())).bit_length()
    low = int(line.max()).bit_length()
    if span(doc_id) + low > 63 or span(token) + len(token).bit_length() > 63:
        return np.lexsort((line, doc_id, token))
    at = np.argsort((doc_id - doc_id.min()) << low | line)
    return at[np.argsort((token[at] - token.min()) << len(token).bit_length() | np.arange(len(token)))]


def _gathered(batches, rows: int):
    """The columns of as many batches at a time as have `rows` rows."""
    some, n = [], 0
    for batch in batches:
        some.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*some)]
            some, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*some)]


def _list_heads(batches, threshold: float, block: int, most: int):
    """`_heads` over batches with POSTING columns."""
    return _heads(_gathered(batches, 1 << 15), threshold, block, most)


def _heads(columns, threshold: float, block: int, most: int):
    """Over each key's list in order of place: kind 0, a line and the first `most` of the list's first `block` lines that it
    may match, the most alike first, `far` bits from it; kind 1, rows at `rank` (from 0) that have not seen those between rank
    `since` and their own; kind 2, the first `block` rows of lists with such rows. Lists stream through; only their first
    rows are held."""
    held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, *[np.int64] * 5)]
    before, open_list = 0, False  # rows of the list that have passed, and whether it has rows of kind 1
    for new in columns:
        k = len(held[0]) if before and held[0][0] == new[0][0] else 0
        open_list = open_list and k > 0
        cols = [np.concatenate([h[:k], x]) for h, x in zip(held, new)]
        token, doc_id, line, n, i = *cols[:3], (cols[3] >> 32).astype(np.int32), (cols[3] & 0xFFFFFFFF).astype(np.int32)
        idx = np.arange(len(token), dtype=np.int32)
        head = np.concatenate([[True], token[1:] != token[:-1]])
        start = np.maximum.accumulate(np.where(head, idx, 0))
        rank = idx.astype(np.int64) - start
        rank[k:] += np.where(start[k:] == 0, before - k, 0) if k else 0
        totals = np.arange(2 * int(n.max()) + 1)
        need_of = np.ceil(totals * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
        apart_of = totals - 2 * need_of  # words that are in one of both only, at most
        seen, since = np.zeros(len(idx), np.int16), np.minimum(rank, block)
        words = [c.view(np.uint64) for c in cols[4:]]
        halves = [words[0] ^ words[2], words[1] ^ words[3]]
        folded = halves[0] ^ halves[1]
        own, other, far, x = [idx[:0]], [idx[:0]], [np.zeros(0, np.int16)], idx[k:]
        for j in range(block):
            x = x[(rank[x] > j) & (seen[x] < most)]
            if not len(x):
                break
            t = start[x] + j
            total = n[x] + n[t]
            apart = np.bitwise_count(folded[x] ^ folded[t])
            ok = apart <= apart_of[total]
            a, b, apart, total = x[ok], t[ok], apart[ok].astype(np.int16), total[ok]
            for parts, least in ((halves, WIDER), (words, WIDEST)):  # the wider signatures that both have
                both = np.flatnonzero((n[a] > least) & (n[b] > least))
                if len(both):
                    apart[both] = sum(np.bitwise_count(w[a[both]] ^ w[b[both]]).astype(np.int16) for w in parts)
                    ok = apart <= apart_of[total]
                    a, b, apart, total = a[ok], b[ok], apart[ok], total[ok]
            need = need_of[total]
            ok = (np.minimum(n[a] - i[a], n[b] - i[b]) >= need) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9)
            ok &= (doc_id[b] != doc_id[a]) | (line[b] != line[a])
            a = a[ok]
            own.append(a)
            other.append(b[ok])
            far.append(apart[ok])
            seen[a] += 1
            since[a[seen[a] == most]] = j + 1
        own, other, far = np.concatenate(own), np.concatenate(other), np.concatenate(far)
        order = np.lexsort((far, own))  # a line's candidates of this list in one row, the most alike first
        own, other, far = own[order], other[order], far[order]
        a, b = _runs(own) if len(own) else (own, own)
        segment = np.cumsum(head) - 1
        left = (idx >= k) & ((since < rank) | (rank >= block))
        opened = np.zeros(segment[-1] + 1, bool)
        opened[segment[left]] = True
        told = open_list  # the held rows of the first list have been given
        opened[0] |= open_list
        heads = np.flatnonzero((rank < block) & opened[segment] & ((idx >= k) | (not told)))
        left = np.flatnonzero(left)
        at = np.concatenate([own[a], left, heads])
        ends = np.concatenate([[0], b, np.full(len(left) + len(heads), len(own))]).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(doc_id[other]), pa.array(line[other])], names=["t_doc_id", "t_line"]))
        out = {"kind": pa.array(np.repeat(np.array([0, 1, 2], np.int8), [len(a), len(left), len(heads)])), "rank": pa.array(rank[at]), "since": pa.array(since[at])} | {c: pa.array(v[at]) for c, v in zip(POSTING, cols)}
        out |= {"far": pa.array(np.concatenate([far[a], np.zeros(len(left) + len(heads), np.int16)]).astype(np.int32)), "found": found}
        if len(at):
            yield pa.record_batch(list(out.values()), names=list(out))
        last = int(start[-1])
        before, open_list = int(rank[-1]) + 1, bool(opened[-1])
        held = [c[last : last + block].copy() for c in cols]


def _part_heads(batches, threshold: float, block: int, most: int, held: int):
    """`_list_heads` over the keys of blocks that come in order of part, whole parts at a time; parts of over `held` rows are given
    as they are, as rows of kind 3."""
    ready, some, n, part, over = [], [], 0, None, False  # blocks of whole parts, and of the one that is read, with n rows in all

    def heads():
        cols = _unpack_all(ready)
        order = _in_order(*cols[:3])
        slices = ([c.astype(np.int32) if k == 2 else c for k, c in enumerate(cols[:, order[i : i + GROUPED]])] for i in range(0, len(order), GROUPED))
        yield from _heads(slices, threshold, block, most)

    def as_they_are():
        cols = _unpack_all(some)
        none = np.zeros(cols.shape[1], np.int64)
        out = {"kind": np.full(len(none), 3, np.int8), "rank": none, "since": none} | dict(zip(POSTING, cols)) | {"line": cols[2].astype(np.int32), "far": none.astype(np.int32)}
        found = pa.ListArray.from_arrays(pa.array(none[:1].repeat(len(none) + 1).astype(np.int32)), pa.StructArray.from_arrays([pa.array(none[:0]), pa.array(none[:0].astype(np.int32))], names=["t_doc_id", "t_line"]))
        return pa.record_batch([*map(pa.array, out.values()), found], names=[*out, "found"])

    for row in _rows(batches):
        if row[0] != part:
            if over and some:
                yield as_they_are()
            elif not over:
                ready += some
            if ready and (over or n >= GROUPED):
                yield from heads()
                ready = []
            n = sum(r[1] for r in ready)
            part, some, over = row[0], [], False
        some.append(row)
        n += row[1]
        if not over and n > held and ready:  # the parts before may be what is much
            yield from heads()
            ready, n = [], sum(r[1] for r in some)
        if n > held or (over and n >= 1 << 15):
            yield as_they_are()
            some, n, over = [], 0, True
    if over and some:
        yield as_they_are()
    elif not over:
        ready += some
    if ready:
        yield from heads()


def _first_blocks(blocks: DataFrame, threshold: float, block: int, most: int, held: int = HELD) -> DataFrame:
    """`_list_heads` over the lists of all keys, each in one task. A range of keys is put in order by its task if it has no more than
    `held` rows; what is in larger ones is written and sorted by Spark, so a list may be longer than memory."""
    kinds = "kind byte, rank long, since long, token long, doc_id long, line int, ni long, s0 long, s1 long, s2 long, s3 long, far int, found array<struct<t_doc_id: long, t_line: int>>"
    ranges = blocks.repartition("part").sortWithinPartitions("part")
    out = materialize(map_arrow(ranges, lambda batches: _part_heads(batches, threshold, block, most, held), kinds, rows=1 << 15), "line-blocks")
    large = out.where("kind = 3").select(*POSTING)
    if large.isEmpty():
        return out
    ordered = large.repartition("token").sortWithinPartitions("token", "doc_id", "line")
    rest = materialize(map_arrow(ordered, lambda batches: _list_heads(batches, threshold, block, most), kinds, rows=1 << 15), "line-blocks")
    return out.where("kind < 3").unionByName(rest)


def _token_sets(wanted: DataFrame) -> DataFrame:
    """(doc_id, line, text) with one line's text -> (doc_id, line, tokens): the set of its words' hashes."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            own, token = [], []
            for i, j in chunks(offsets):
                at = offsets[i : j + 1]
                hashes, doc, _, a, b = _lines(data[at[0] : at[-1]], at - at[0])
                row = np.repeat(doc + i, b - a)
                order = _by_line(row, hashes)
                row, h = row[order], hashes[order]
                once = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])[: len(row)]
                own.append(row[once])
                token.append(h[once])
            sizes = np.bincount(np.concatenate(own), minlength=batch.num_rows) if own else np.zeros(batch.num_rows, np.int64)
            values = np.concatenate(token).view(np.int64) if token else np.zeros(0, np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))
            yield pa.record_batch([batch.column(0), batch.column(1), tokens], names=["doc_id", "line", "tokens"])

    return map_arrow(wanted, run, "doc_id long, line int, tokens array<long>", rows=1 << 14)


def _may_match(s, t, threshold: float):
    """Length, positional and signature filters for a list's row `s` and an earlier one `t` (prefixes of columns)."""
    parts = {"n": lambda x: F.shiftright(x, 32), "i": lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))}
    c = lambda side, name: parts[name](F.col(f"{side}ni")) if name in parts else F.col(f"{side}{name}")
    most = F.least(c(s, "n") - c(s, "i"), c(t, "n") - c(t, "i"))
    need = F.ceil((c(s, "n") + c(t, "n")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    flips = lambda *k: F.bit_count(reduce(lambda x, y: x.bitwiseXOR(y), [c(side, SIGNATURE[j]) for side in (s, t) for j in k]))
    shorter = F.least(c(s, "n"), c(t, "n"))
    apart = F.when(shorter > WIDEST, flips(0) + flips(1) + flips(2) + flips(3)).when(shorter > WIDER, flips(0, 2) + flips(1, 3)).otherwise(flips(0, 1, 2, 3))
    earlier = (c(t, "doc_id") < c(s, "doc_id")) | ((c(t, "doc_id") == c(s, "doc_id")) & (c(t, "line") < c(s, "line")))
    return earlier & (F.least(c(s, "n"), c(t, "n")) >= F.greatest(c(s, "n"), c(t, "n")) * threshold - 1e-9) & (most >= need) & (apart <= c(s, "n") + c(t, "n") - 2 * need)


def _alike(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, line) of the pairs (doc_id, line, t_doc_id, t_line) whose Jaccard reaches the threshold, from the lines' words."""
    pairs = materialize(pairs, "line-pairs")
    n = pairs.count()
    if not n:
        return pairs.select("doc_id", "line")
    ends = pairs.select("doc_id", "line").unionByName(pairs.select(F.col("t_doc_id").alias("doc_id"), F.col("t_line").alias("line")))
    asked = ends.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))  # of each pair's two lines at most a document each
    wanted = sized_join(docs, asked, 2 * n, 56, "doc_id", "inner")
    parts = F.split(F.col("text").cast("string"), "\n")
    own = F.element_at(F.transform(F.array(parts), lambda p: F.transform("lines", lambda k: F.struct(k.alias("line"), F.get(p, k).cast("binary").alias("text")))), 1)
    sets = materialize(_token_sets(wanted.select("doc_id", F.inline(own))), "line-sets")
    pair = F.xxhash64("doc_id", "line", "t_doc_id", "t_line")
    numbered = pairs.select(F.col("doc_id"), F.col("line"), pair.alias("pair"), F.lit(0).alias("side"))
    asking = numbered.unionByName(pairs.select(F.col("t_doc_id").alias("doc_id"), F.col("t_line").alias("line"), pair.alias("pair"), F.lit(1).alias("side")))
    told = sized_join(sets, asking, 2 * n, 64, ["doc_id", "line"], "inner")  # a line's tokens, for each pair it is in
    left = told.where("side = 0").select("pair", "doc_id", "line", "tokens")
    right = told.where("side = 1").select("pair", F.col("tokens").alias("t_tokens"))
    both = left.join(right.hint("merge"), "pair")  # no estimate of the optimizer is to broadcast token sets
    need = F.ceil((F.size("tokens") + F.size("t_tokens")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    out = materialize(both.where(F.size(F.array_intersect("tokens", "t_tokens")) >= need).select("doc_id", "line").distinct(), "line-near")
    discard(pairs, sets)
    return out


def _removed(docs: DataFrame, threshold: float, block: int, most: int, dense: int) -> list[DataFrame]:
    """Tables of (doc_id, line), places of the lines that go; a place may be given twice.

    Each line's most alike candidate is verified first. Lines that it doesn't settle have all of theirs verified, together with
    those of the lists that they have not seen to the end, so a dense group costs its lines, not its pairs."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    slots = table_slots(docs)
    seen = materialize(_occurrences(docs, slots), "line-occurrences")
    table = _table(seen.where("kind = 1").select("k1", "counts"), slots)
    firsts = seen.where("kind = 0").select("k1", "k2", "doc_id", "line")
    place = Window.partitionBy("k1", "k2").orderBy("doc_id", "line")  # a row for each task that has the line, and few more
    repeated = materialize(firsts.withColumn("rank", F.rank().over(place)).where("rank > 1").select("doc_id", "line"), "line-repeated")
    gone = [repeated, seen.where("kind = 2").select("doc_id", "line")]

    blocks = _first_blocks(_blocks(docs, table, repeated, threshold, dense), threshold, block, most)
    found = blocks.where("kind = 0").select("doc_id", "line", "far", "found")
    best = found.groupBy("doc_id", "line").agg(F.min_by(F.col("found")[0], F.struct("far", F.col("found")[0])).alias("t")).select("doc_id", "line", "t.*")
    gone.append(_alike(docs, best, threshold))
    pairs = found.join(gone[-1], ["doc_id", "line"], "left_anti").select("doc_id", "line", F.inline("found"))
    names = ("rank", *POSTING[1:])
    earlier = blocks.where(f"(kind = 1 AND rank >= {block}) OR kind = 2").select("token", *[F.col(c).alias(f"t_{c}") for c in names])
    left, size = blocks.where("kind = 1").select("token", "since", *names), block
    while True:
        size *= 8
        left = materialize(left.where(F.col("since") < F.col("rank")).join(gone[-1], ["doc_id", "line"], "left_anti"), "line-left")
        more = sized_join(earlier, left, left.count(), 96, "token", "inner").where((F.col("t_rank") >= F.col("since")) & (F.col("t_rank") < F.col("since") + size) & (F.col("t_rank") < F.col("rank")) & _may_match("", "t_", threshold))
        more = more.select("doc_id", "line", "t_doc_id", "t_line")
        gone.append(_alike(docs, (more if pairs is None else more.unionByName(pairs)).distinct(), threshold))
        left, pairs = left.withColumn("since", F.col("since") + size), None
        if left.where(F.col("since") < F.col("rank")).isEmpty():
            discard(blocks)
            return gone


def removed_lines(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most: int = MOST, dense: int = DENSE) -> DataFrame:
    """(doc_id, line): places of the lines that go, line numbers from 0."""
    return reduce(DataFrame.unionByName, _removed(docs, threshold, block, most, dense)).distinct()


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, most: int = MOST, dense: int = DENSE) -> DataFrame:
    """`docs` with the removed lines cut out of `text`, and `removed_lines` (their numbers, ascending)."""
    places = _removed(docs, threshold, block, most, dense)
    gone = materialize(reduce(DataFrame.unionByName, places).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("removed")), "line-removed")
    discard(*places)
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size("removed"))).first()
    columns = [c for c in docs.columns if c != "removed_lines"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*columns).alias("row"))  # no name of theirs can clash
    out = sized_join(rows, gone, size[0], 48 + 4 * ((size[1] or 0) // max(1, size[0])), "doc_id", "left")
    text = F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    new = {"text": F.when(F.col("removed").isNull(), text).otherwise(kept)}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("removed").isNull(), F.col("row.n_chars")).otherwise(F.length(kept).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns], F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))
