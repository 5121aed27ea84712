"""Cross-tokenizer alignment by inverted pair bitmaps.

Each text is encoded by tokenizer A (byte-level BPE) and B (pieces with byte fallback). Byte offsets where tokens of both
end cut the text into groups; every A token and B token of a group are linked.

1. One scan encodes the texts. A cut before a single space between two characters that are no white space changes neither
   tokenizer's result (B has no piece with a space after another character), so the parts between such cuts are aligned
   once and looked up in a bounded cache. Documents are numbered: a container is a run of 2^14 of a task's documents, a slot
   is a place in it. For each (A id, B id) the scan writes bitmaps of slots: plane 0 holds the documents that link
   the pair, plane j the documents whose number of links less one has bit j - 1 set. A bitmap is a sorted list of 16-bit slots
   below 1,024 documents, else 2,048 bytes of bits.
2. The bitmaps of the same container, pair and plane are OR-merged. Their popcounts give a pair's documents and links.
3. Postings return scores: every bitmap is read with its pair's document count, and each slot in it collects that count, times
   two to the plane's power, so that nothing is spread out to a row for each link.

Rows of bitmaps are dealt by (container, hash of the pair), so that a pair of all documents is as many rows as there are
containers, in as many tasks. Pair counts have at most |A| times |B| rows; they are broadcast if their counted size allows it.

Nulls: null and empty texts have no tokens. So have texts whose token bytes, joined, differ from a space and the text (a
literal U+2581, for one); broken UTF-8 is replaced first. Rows that share a doc_id (null as well) are documents of their own. A text of any length is taken
whole, in its task's memory. Empty tables give no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import BROADCAST_BYTES, map_arrow, materialize, sized_join, texts, utf8
from lakewatch.llm.packing import _WHITE as WHITE

#: Documents of a container; below how many a bitmap is a list of slots; bytes of a bitmap of bits.
SLOTS, SPARSE, BYTES = 1 << 14, 1 << 10, 1 << 11
#: (document, part's pair) entries at which a task writes its bitmaps; parts that its cache holds before it starts anew.
ENTRIES, CACHED = 1_500_000, 400_000
#: Bits of a B id within a pair; links from which a group is told by its distinct ids.
B_BITS, MANY = 15, 1 << 12
#: Shares of a container by a hash of the pair; containers of which a task keeps sums at a time.
SHARES, OPEN = 8, 64
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Numbers(dict):
    """Parts and their numbers; a part that is asked for and not there gets the next one, and waits to be aligned."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = k = len(self)
        self.new.append(part)
        return k


_tables: dict[tuple[str, str], Aligner] = {}


def tokenizer_paths() -> tuple[str, str]:
    """Ranks of the byte-level BPE of 50,257 ids (the vocabulary of its JSON) and the piece model of 32,000 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Aligned parts of texts: each is encoded once and has a number, under which its counts and pairs stand. A pair is one
    integer: the A id, then B_BITS bits of the B id."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        assert len(self.b_bytes) <= 1 << B_BITS
        self.a_size, self.b_size = np.zeros(max(ranks.values()) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        self.a_size[list(ranks.values())] = [len(x) for x in ranks]
        n_a, n_b = len(self.a_size), len(self.b_size)
        self.told = np.array([f"{i}{end}" for n, end in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)], object)
        self.whole = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.string: list[str] = []
        self.rows = np.zeros((0, 6), np.int64)  # n_a, n_b, n_groups, n_links, fits, pairs
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of all parts, one after the other
        self.start = np.zeros(0, np.int64)

    def parts(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        return _SAFE_CUT.split(text) if odd(text) else text.split(" ")

    def numbers(self, parts: list[list[str]]) -> np.ndarray:
        """The numbers of all parts, one list after the other; new parts are aligned."""
        out = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        if self.number.new:
            self.add(self.number.new)
            self.number.new = []
        return out

    def add(self, parts: list[str]) -> None:
        b, whole = self.b.encode(parts, num_threads=1), [(" " + p).encode("utf-8", "replace") for p in parts]
        told = self.b_bytes.__getitem__
        fits = np.ones(len(parts), bool)
        if b"".join(map(told, chain.from_iterable(b))) != b"".join(whole):
            fits = np.array([b"".join(map(told, own)) == x for own, x in zip(b, whole)])
        here = np.flatnonzero(fits).tolist()
        # the parts that fit stand one after the other: an A token, a B token and a part end at the same bytes
        a_ids = np.array(chain_ids(self.a, [parts[k] for k in here], self.whole), np.int64)
        b_ids = np.fromiter(chain.from_iterable(b[k] for k in here), np.int64)
        a_end, b_end, part_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]), np.cumsum([len(whole[k]) for k in here], dtype=np.int64)
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        group_part = np.searchsorted(part_end, cuts)
        rows = np.zeros((len(parts), 6), np.int64)
        count = lambda of, weights=None: np.bincount(group_part if of is None else group_part[of], weights, len(here)).astype(np.int64)
        rows[here, :5] = np.stack([count(a_group), count(b_group), count(None), count(None, n_a * n_b), np.ones(len(here), np.int64)], 1)
        part, pair, times = self.links(a_ids, b_ids, n_a, n_b, group_part)
        rows[here, 5] = np.bincount(part, minlength=len(here))
        # the tokens' texts in the order of the groups, A before B
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        last_a, last_b = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        last_a[first_a + n_a - 1], last_b[first_b + n_b - 1] = len(self.a_size), len(self.b_size)
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + first_b[a_group]] = a_ids + last_a
        order[np.arange(len(b_ids)) + (first_a + n_a)[b_group]] = b_ids + last_b + 2 * len(self.a_size)
        out = self.told[order]
        out, strings, at = out.tolist(), [""] * len(parts), 0
        for k, n in zip(here, (rows[here, 0] + rows[here, 1]).tolist()):
            strings[k] = "".join(out[at : at + n])
            at += n
        self.string += strings
        self.rows, self.pair, self.times = np.concatenate([self.rows, rows]), np.concatenate([self.pair, pair]), np.concatenate([self.times, times])
        self.start = np.cumsum(self.rows[:, 5]) - self.rows[:, 5]

    def links(self, a_ids: np.ndarray, b_ids: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, group_part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, pair, links) by part and pair: each A token of a group with each B token of it. Groups of more links than MANY are
        told by their distinct ids, so that a long run of odd tokens takes no more room than that."""
        first_a, first_b, found = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, []
        many = n_a * n_b > MANY
        each = np.where(many, 0, n_a * n_b)
        group = np.repeat(np.arange(len(n_a)), each)
        k = np.arange(len(group)) - np.repeat(np.cumsum(each) - each, each)
        i, j = first_a[group] + k // n_b[group], first_b[group] + k % n_b[group]
        found.append((group_part[group], a_ids[i] << B_BITS | b_ids[j], np.ones(len(group), np.int64)))
        for g in np.flatnonzero(many).tolist():
            x, n = np.unique(a_ids[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, m = np.unique(b_ids[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            found.append((np.full(len(x) * len(y), group_part[g]), (x[:, None] << B_BITS | y).ravel(), (n[:, None] * m).ravel()))
        part, pair, times = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((pair, part))
        part, pair, times = part[order], pair[order], times[order]
        new = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(pair, prepend=-1))
        return part[new], pair[new], np.add.reduceat(times, new) if len(new) else times


def odd(text: str) -> bool:
    """Whether a space of the text, or one put before or after it, stands beside white space."""
    return not text or text[0].isspace() or text[-1].isspace() or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in WHITE)


def chain_ids(encoder, parts: list[str], apart: bool) -> list[int]:
    """A's ids of the parts, each after a space, one after the other: encoded as one text where a cut between them is safe."""
    if not apart and not odd(joined := " ".join(parts)):
        return encoder.encode_ordinary(" " + joined)
    return list(chain.from_iterable(encoder.encode_ordinary(" " + p) for p in parts))


def aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _tables:
        _tables[paths] = Aligner(*paths)
    return _tables[paths]


def encode_bitmaps(counts: np.ndarray, slots: np.ndarray) -> pa.Array:
    """Bitmaps of runs of sorted slots: `counts` slots each, one run after the other."""
    flat, ends = slots.astype("<u2"), np.cumsum(counts)
    dense = np.flatnonzero(counts >= SPARSE)
    sizes = 2 * counts
    sizes[dense] = BYTES
    if len(dense):
        kept, at = [], 0
        for k in dense.tolist():
            kept.append(flat[at : ends[k] - counts[k]].tobytes())
            bits = np.zeros(SLOTS, np.uint8)
            bits[slots[ends[k] - counts[k] : ends[k]]] = 1
            kept.append(np.packbits(bits).tobytes())
            at = ends[k]
        data = b"".join([*kept, flat[at:].tobytes()])
    else:
        data = flat.tobytes()
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def decode_bitmaps(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every set bit, by row and then slot."""
    if not len(bitmaps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(bitmaps.buffers()[1], np.int32)[bitmaps.offset : bitmaps.offset + len(bitmaps) + 1].astype(np.int64)
    raw = np.frombuffer(bitmaps.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    dense = sizes == BYTES
    rows = np.repeat(np.arange(len(sizes)), np.where(dense, 0, sizes // 2))
    slots = np.frombuffer(raw[np.repeat(~dense, sizes)].tobytes(), "<u2").astype(np.int64)
    if dense.any():
        at, bit = np.nonzero(np.unpackbits(raw[np.repeat(dense, sizes)].reshape(-1, BYTES), axis=1))
        rows, slots = np.concatenate([rows, np.flatnonzero(dense)[at]]), np.concatenate([slots, bit])
        order = np.lexsort((slots, rows))
        rows, slots = rows[order], slots[order]
    return rows, slots


def merge_bitmaps(group: np.ndarray, bitmaps: pa.Array, n: int) -> tuple[np.ndarray, pa.Array]:
    """The OR of the bitmaps of each of `n` groups, and their popcounts."""
    rows, slots = decode_bitmaps(bitmaps)
    keys = np.unique(group[rows] * SLOTS + slots)
    counts = np.bincount(keys // SLOTS, minlength=n)
    return counts, encode_bitmaps(counts, keys % SLOTS)


_SCAN = "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, container long, plane int, a int, b int, bits binary"
_DOCUMENT = ["number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_BITMAP = ["container", "plane", "a", "b", "bits"]


def _batch(names: list[str], columns: list) -> pa.RecordBatch:
    """Columns of one kind of row; those of the other kind are null."""
    kinds = {"groups_sha256": pa.string(), "plane": pa.int32(), "a": pa.int32(), "b": pa.int32(), "bits": pa.binary()}
    given = dict(zip(names, columns))
    every = [f.split(" ")[0] for f in _SCAN.split(", ")]
    n = len(columns[0])
    return pa.record_batch([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], kinds.get(c, pa.int64())) if c in given else pa.nulls(n, kinds.get(c, pa.int64())) for c in every], names=every)


def _planes(container: int, held: list[tuple[np.ndarray, np.ndarray]]):
    """The bitmaps of the entries (pair and slot, links) that a task holds, plane by plane."""
    key, links = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
    order = np.argsort(key, kind="stable")
    key, first = np.unique(key[order], return_index=True)
    more = np.add.reduceat(links[order], first) - 1 if len(key) else links
    for plane in range(1 + int(more.max(initial=0)).bit_length()):
        own = key[(more >> (plane - 1)) & 1 == 1] if plane else key
        pair, counts = np.unique(own // SLOTS, return_counts=True)
        coded = encode_bitmaps(counts, own % SLOTS)
        for i in range(0, len(pair), 1 << 16):
            own_pair = pair[i : i + (1 << 16)]
            yield _batch(_BITMAP, [np.full(len(own_pair), container), np.full(len(own_pair), plane, np.int32), own_pair >> B_BITS, own_pair & ((1 << B_BITS) - 1), coded[i : i + (1 << 16)]])


def scan(docs: DataFrame, paths: tuple[str, str] | None = None, entries: int = ENTRIES) -> DataFrame:
    """Two kinds of rows: a document's counts and hash under its number, and bitmaps of (container, plane, a, b)."""
    paths = paths or tokenizer_paths()

    def run(batches):
        table, container = aligner(paths), TaskContext.get().partitionId() << 22
        taken, size, held = 0, 0, []
        for batch in batches:
            bodies = texts(batch.column(1))
            if held and (taken + len(bodies) > SLOTS or size > entries):
                yield from _planes(container, held)
                size, held = 0, []
            if taken + len(bodies) > SLOTS:
                container, taken = container + 1, 0
            if len(table.rows) > CACHED:
                table.clear()
            parts = [table.parts(body) if body else [] for body in bodies]
            part = table.numbers(parts)
            rows, size_of = table.rows, np.array([len(own) for own in parts])
            which, ends = np.repeat(np.arange(len(parts)), size_of), np.cumsum(size_of).tolist()
            bad = np.bincount(which[rows[part, 4] == 0], minlength=len(parts)) > 0
            string = list(map(table.string.__getitem__, part.tolist()))
            marks = [hashlib.sha256("".join(string[end - len(own) : end])[:-1].encode()).hexdigest() if own and not wrong else "" for own, end, wrong in zip(parts, ends, bad)]
            keep = ~bad[which]
            both, n = np.unique(which[keep] * (len(rows) + 1) + part[keep], return_counts=True)
            which, part = np.divmod(both, len(rows) + 1)
            sums = [np.bincount(which, n * rows[part, k], len(parts)).astype(np.int64) for k in range(4)]
            yield _batch(_DOCUMENT, [container * SLOTS + taken + np.arange(len(parts)), batch.column(0), *sums, marks])
            each = rows[part, 5]
            at = np.repeat(table.start[part] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            held.append((table.pair[at] * SLOTS + np.repeat(taken + which, each), table.times[at] * np.repeat(n, each)))
            size, taken = size + len(at), taken + len(parts)
        if held:
            yield from _planes(container, held)
        table.clear()

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, _SCAN, rows=250)


def merged(parts: DataFrame) -> DataFrame:
    """One bitmap for each container, plane and pair, and its popcount `n`; dealt by container and share."""

    def run(batches):
        for batch in batches:
            lists = batch.column("parts")
            counts, bits = merge_bitmaps(np.repeat(np.arange(len(lists)), np.diff(lists.offsets)), lists.flatten(), len(lists))
            yield pa.record_batch([*(batch.column(c) for c in ("container", "share", "plane", "a", "b")), bits, pa.array(counts, pa.int64())], names=["container", "share", "plane", "a", "b", "bits", "n"])

    keys = ["container", "share", "plane", "a", "b"]
    dealt = parts.withColumn("share", F.pmod(F.xxhash64("a", "b"), F.lit(SHARES)).cast("int")).repartition("container", "share")
    return map_arrow(dealt.groupBy(*keys).agg(F.collect_list("bits").alias("parts")), run, "container long, share int, plane int, a int, b int, bits binary, n long", rows=4096)


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """a, b, the documents that hold the pair linked, their links, and whether no other B id of the A id has more documents."""
    n_links = F.when(F.col("plane") == 0, F.col("n")).otherwise(F.expr("n * shiftleft(1L, plane - 1)"))
    counts = bitmaps.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("n_docs"), F.sum(n_links).alias("n_links"))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("best"))


def scores(postings: DataFrame) -> DataFrame:
    """number, n_best, count_sum: what a document's slots collect from the bitmaps that hold them."""

    def run(batches):
        open_: dict[int, np.ndarray] = {}

        def rows():
            for container, sums in open_.items():
                own = np.flatnonzero(sums[1])
                yield pa.record_batch([pa.array(container * SLOTS + own), *(pa.array(c[own]) for c in sums)], names=["number", "n_best", "count_sum"])
            open_.clear()

        for batch in batches:
            container = batch.column("container").to_numpy()
            row, slot = decode_bitmaps(batch.column("bits"))
            times = np.left_shift(np.int64(1), np.maximum(batch.column("plane").to_numpy().astype(np.int64) - 1, 0))
            best, count = times * batch.column("best").to_numpy(zero_copy_only=False), times * batch.column("n_docs").to_numpy()
            for c in np.unique(container).tolist():
                if c not in open_ and len(open_) >= OPEN:
                    yield from rows()
                sums, own = open_.setdefault(c, np.zeros((2, SLOTS), np.int64)), container[row] == c
                np.add.at(sums[0], slot[own], best[row[own]])
                np.add.at(sums[1], slot[own], count[row[own]])
        yield from rows()

    read = postings.select("container", "plane", "bits", "n_docs", "best")
    return map_arrow(read, run, "number long, n_best long, count_sum long", rows=20_000).groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each row of `docs`."""
    found = materialize(scan(docs, paths), "align-scan")
    bitmaps = materialize(merged(found.where("bits IS NOT NULL").select(*_BITMAP)), "align-bitmaps")
    counts = materialize(pair_counts(bitmaps), "align-pairs")
    pairs = counts.count()
    postings = sized_join(bitmaps, counts.drop("n_links"), pairs, 32, ["a", "b"], "inner")
    if pairs * 32 > BROADCAST_BYTES:  # the join has dealt the bitmaps by pair
        postings = postings.repartition("container", "share")
    held = found.where("number IS NOT NULL").select(*_DOCUMENT)
    none = {"n_best": 0, "count_sum": 0}
    return held.join(scores(postings), "number", "left").fillna(none).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
