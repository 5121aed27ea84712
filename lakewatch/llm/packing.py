"""Harmonic packing of tokenised documents into sequences.

A document is its token ids and a final id 0. It is cut into pieces so that every piece falls into a reciprocal-capacity
class it nearly fills: whole sequences first, then, while k = capacity // rest pieces of the rest's length would leave
more than `slack` of a sequence, a piece of capacity // (k + 1) ids. Class k takes exactly k pieces a sequence, whatever
they are, so workers fill their own sequences without hearing of each other: pieces are spread over hashed ranges, the
ranges' counts give each its first rank in the class, and piece r of class k goes to the class's sequence r // k. What is
left in each class, fewer than k pieces, is a few thousand pieces at most whatever the input, and is packed first-fit.

Token ids are those of the tokenizer file for the whole text: its added tokens are told first, and a cut before a single
space between two characters that are no white space never changes the rest's, so the words of a text are looked up in a
bounded cache and only new ones are encoded.

Nulls: a null text is empty (one piece: id 0); a null doc_id packs like any other. Rows that share a doc_id are documents
of their own. A text of any length is encoded whole, in its task's memory. Ties between pieces break by a hash, then by
doc_id, start and place in the table. Empty tables give no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewatch.llm.common import kept, map_arrow, materialize, texts, utf8

CAPACITY = 1024
#: Ids of a sequence that a class may leave empty.
SLACK = 32
#: Pieces of a hashed range, about, in which a class's pieces are ranked; their number follows from the pieces.
RANGE_PIECES = 1 << 15
#: Words that a worker's cache holds before it starts anew.
CACHED = 250_000

#: White space other than the single space, and its neighbourhoods in which a split could matter.
_WHITE = "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BESIDE = ("  ", *(" " + c for c in _WHITE), *(c + " " for c in _WHITE))

_tokenizers: dict[str, Tokens] = kept(__name__)


def tokenizer_path() -> str:
    """The byte-level BPE of 50,257 ids as ranks: the same vocabulary as its tokenizers file beside it, three times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokens(dict):
    """Ids of whole texts as packed little-endian 32-bit numbers; the items are words with their leading space."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
            added = {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(f)["added_tokens"]}
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")" if added else r"(?!)").split

    def encode(self, text: str) -> bytes:
        return array("I", self.encoder.encode_ordinary(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        self[word] = ids = self.encode(" " + word)
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(self.added.get(part) or self.plain(part) for part in self.split(text) if part)

    def plain(self, text: str) -> bytes:
        if any(x in text for x in _BESIDE):
            return self.encode(text)
        first, *rest = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


def tokens(path: str) -> Tokens:
    if path not in _tokenizers:
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        take = rest if capacity - k * rest <= slack or rest <= slack else capacity // (k + 1)
        out.append(take)
        rest -= take
    return out


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, row (tells apart rows that share a doc_id), and ids if asked for."""
    path = path or tokenizer_path()

    def run(batches):
        table = tokens(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = table.of(text) + b"\0\0\0\0"
                n, at, mark = len(ids) // 4, 0, zlib.crc32(ids)
                for k in cuts(n, capacity, slack):
                    part = ids[4 * at : 4 * (at + k)]
                    rows.append((doc_id, at, k, zlib.crc32(part), n, mark, np.frombuffer(part, "<i4") if with_ids else None))
                    at += k
            columns = list(zip(*rows)) or [()] * 7
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "mark", "ids"][: 6 + with_ids]
            yield pa.record_batch([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, mark long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, schema, rows=250)


def _first_fit(capacity: int):
    def run(batches):
        columns = ("length", "doc_id", "start", "mark", "piece_id")
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        c = {n: np.concatenate([b.column(n).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False) for b in batches]) for n in columns}
        order = np.lexsort((c["piece_id"], c["mark"], c["start"], c["doc_id"], -c["length"]))
        room, bins, offsets = np.zeros(0, np.int64), [], []
        for n in c["length"][order].tolist():
            fit = np.flatnonzero(room >= n)
            at = int(fit[0]) if len(fit) else len(room)
            if not len(fit):
                room = np.append(room, capacity)
            bins.append(at)
            offsets.append(capacity - int(room[at]))
            room[at] -= n
        yield pa.record_batch([pa.array(c["piece_id"][order]), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], names=["piece_id", "sequence_id", "offset"])

    return run


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (doc_id, start, length, mark, and a unique piece_id) with sequence_id and offset. `cut` is read several times:
    give it a materialised table without the ids."""
    kind = F.expr(f"{capacity} div length")
    ranges = 1 << max(6, min(20, (cut.count() // RANGE_PIECES).bit_length()))
    spread = F.pmod(F.xxhash64("doc_id", "start", "mark"), F.lit(ranges))
    p = cut.select("*", kind.alias("class"), spread.alias("range"))
    counts = p.groupBy("class", "range").agg(F.count(F.lit(1)).alias("n"))  # `ranges` rows a class at most
    totals = counts.groupBy("class").agg(F.sum("n").alias("all")).withColumn("bins", F.expr("`all` div class"))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("first_bin", F.coalesce(F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = counts.withColumn("first_rank", F.coalesce(F.sum("n").over(upto("class", "range")), F.lit(0))).drop("n").join(totals, "class")
    in_range = Window.partitionBy("class", "range").orderBy("doc_id", "start", "mark", "piece_id")
    ranked = p.join(starts, ["class", "range"]).withColumn("rank", F.col("first_rank") + F.row_number().over(in_range) - 1)
    bin_ = F.expr("rank div class")
    ranked = ranked.withColumn("sequence_id", F.when(bin_ < F.col("bins"), F.col("first_bin") + bin_))
    ranked = materialize(ranked.select(*cut.columns, "rank", "sequence_id"), "packing-ranked")
    full = ranked.where("sequence_id IS NOT NULL")
    offset = F.coalesce(F.sum("length").over(upto("sequence_id", "rank")), F.lit(0))
    placed = full.withColumn("offset", offset).select(*cut.columns, "sequence_id", "offset")
    rest = ranked.where("sequence_id IS NULL").drop("rank", "sequence_id")
    base = full.agg(F.coalesce(F.max("sequence_id") + 1, F.lit(0)).alias("base"))
    few = rest.select("doc_id", "start", "length", "mark", "piece_id").repartition(1)  # a few thousand pieces, whatever the input
    fitted = map_arrow(few, _first_fit(capacity), "piece_id long, sequence_id long, offset long")
    fitted = fitted.crossJoin(F.broadcast(base)).select("piece_id", (F.col("sequence_id") + F.col("base")).alias("sequence_id"), "offset")
    return placed.unionByName(rest.join(F.broadcast(fitted), "piece_id").select(*placed.columns))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, slack: int = SLACK, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for."""
    cut = materialize(pieces(docs, path, capacity, slack, with_ids).withColumn("piece_id", F.monotonically_increasing_id()), "packing-pieces")
    placed = assign(cut.drop("ids"), capacity)
    if with_ids:
        placed = placed.join(cut.select("piece_id", "ids"), "piece_id")
    return placed.drop("mark", "piece_id")
