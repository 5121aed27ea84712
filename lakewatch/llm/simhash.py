"""SimHash near-duplicates: a positional inverted index over the fingerprints' bytes with count filtering.

Two fingerprints of 64 bits that differ in at most 4 bits agree in at least 4 of their 8 bytes. Lists of single
positional bytes would hold a 256th of all fingerprints each, so the index is keyed by 3 positional bytes: 20 triples of
positions suffice for every 4 positions to hold one of them, so every pair that reaches the guaranteed minimum meets.
Where a pair meets, its shared positional bytes are tallied; it is retained if the tally reaches the minimum and this
triple is its first, and is then verified by its differing bits. Equal fingerprints are one entry, however many documents
carry them.

A list longer than `dense_list` is told apart by a fourth positional byte, which retained pairs share, too. A list that
is still longer isn't paired: its fingerprints are linked through midpoints instead. Each gives every fingerprint within
2 bits of itself; two are within 4 bits exactly if they give a common one, so linking each to the smallest giver of each
midpoint joins the same groups with rows in proportion to the list.

Nulls: a null text has no words and fingerprint zero, like every text without words; they link like any others. Null
doc_ids are ignored when the smallest is taken; a group of none but null ones has a null component_id. Texts of any length
are read whole, in slices. Repeated rows get equal results, and rows that share a doc_id each have their own text's. Empty
tables give no rows. Other columns are ignored by `components` and kept, whatever their names, by `deduplicate`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import discard, map_arrow, materialize, sized_join, utf8
from lakewatch.llm.components import connected_components

#: Words of a shingle, seed of its XXH64, differing bits that still link.
WORDS, SEED, BITS = 4, 42, 4
#: Fingerprints of a list beyond which it is linked through midpoints.
DENSE_LIST = 256


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    counts, step = np.zeros(64, np.int64), 1 << 15
    for i in range(0, n, step):
        h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[i : min(n, i + step)].tolist(), last[i : i + step].tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, "doc_id long, fp long")


def _signed(values: list[int]) -> list[int]:
    return [x - (1 << 64) if x >= 1 << 63 else x for x in values]


def triples() -> list[tuple[int, int, int]]:
    """Triples of the 8 byte positions such that any 4 positions hold one: all within a group of 0-2, 3-5 and 6-7, and two of a
    group with one of the next."""
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    inside = [g for g in groups if len(g) == 3]
    return inside + [(*two, one) for g, after in zip(groups, groups[1:] + groups[:1]) for two in combinations(g, 2) for one in after]


def _listed(index: DataFrame, dense_list: int) -> DataFrame:
    """The index's rows (key, ...) whose key has others, with whether its list is longer than `dense_list`. Keys are counted with
    partial sums and joined back, so a hot key's rows can be split."""
    counts = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-keys")
    own = sized_join(index, counts, counts.count(), 64, "key", "inner")
    out = materialize(own.withColumn("dense", F.col("n") > dense_list).drop("n"), "simhash-lists")
    discard(counts)
    return out


def links(fps: DataFrame, bits: int = BITS, dense_list: int = DENSE_LIST) -> DataFrame:
    """(fp) distinct -> (a, b), a < b: links whose components are those of all pairs within `bits` bits.

    For 4 bits or fewer. No pair of different lists is lost."""
    if not 0 <= bits <= 4:
        raise ValueError("bits must be 0 to 4")
    least, keys = 8 - bits, triples()
    position = _signed([255 << 8 * i for i in range(8)])
    masks = _signed([sum(255 << 8 * i for i in k) for k in keys])
    first = [next((n for n, k in enumerate(keys) if all(shared >> i & 1 for i in k)), -1) for shared in range(256)]
    index = fps.select("fp", F.posexplode(F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseAND(m))).alias("triple", "part"))
    index = index.select(F.xxhash64("triple", "part").alias("key"), "triple", "fp")
    listed = _listed(index, dense_list)
    x = F.col("a").bitwiseXOR(F.col("b"))
    shared = sum((F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(position)), F.lit(0))

    def met(rows: DataFrame, own=F.lit(True)) -> DataFrame:
        """Pairs of a list that share the least number of positional bytes and are near."""
        left, right = rows.withColumnRenamed("fp", "a"), rows.select("key", F.col("fp").alias("b"))
        return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(shared) >= least) & own & (F.bit_count(x) <= bits)).select("a", "b")

    pairs = met(listed.where("NOT dense"), F.get(F.lit(first), shared) == F.col("triple"))  # given by its first triple only
    dense = listed.where("dense")
    if dense.isEmpty():
        return pairs
    others = [[F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("byte")) for i, m in enumerate(position) if i not in k] for k in keys]
    fourth = F.get(F.array(*[F.array(*o) for o in others]), F.col("triple"))
    finer = _listed(dense.select("key", "fp", F.inline(fourth)).select(F.xxhash64("key", "at", "byte").alias("key"), "fp"), dense_list)
    pairs = pairs.unionByName(met(finer.where("NOT dense")))
    return pairs.unionByName(midpoint_links(finer.where("dense").select("fp").distinct(), bits)).where("a <> b").distinct()


def midpoint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links among distinct fingerprints with the components of all their pairs within `bits` bits, through the
    fingerprints halfway between them: each row gives all within half of `bits` of itself."""
    near, far = bits // 2, bits - bits // 2
    flips = {0: "array(0L)", 1: "array(0L) || transform(sequence(0, 63), i -> shiftleft(1L, i))", 2: "array(0L) || flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"}
    at = lambda r: fps.select("fp", F.explode(F.transform(F.expr(flips[r]), lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    if near == far:
        given = at(near)
        least = given.groupBy("mid").agg(F.min("fp").alias("b"))
        return given.join(least, "mid").where("fp <> b").select(F.greatest("fp", "b").alias("b"), F.least("fp", "b").alias("a")).select("a", "b").distinct()
    given = at(far)  # an odd bound: one end is `near` away from the midpoint
    least = at(near).groupBy("mid").agg(F.min("fp").alias("b"))
    return given.join(least, "mid").where("fp <> b").select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()


def components(docs: DataFrame, bits: int = BITS, dense_list: int = DENSE_LIST) -> DataFrame:
    """One row for each row of `docs`: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    own = materialize(fingerprints(docs), "simhash-fingerprints")  # read by the caller's result, so it stays
    groups = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    roots = connected_components(links(groups.select("fp"), bits, dense_list)).select(F.col("node").alias("fp"), "root")
    rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return own.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, **params) -> DataFrame:
    """`docs` (all columns) without the documents that have a smaller doc_id in their group; null doc_ids stay. Rows that share a
    doc_id go together if one of them has to; if they stay, those with equal texts are one row, the one whose
    columns as JSON have the smallest SHA-256."""
    labels = materialize(components(docs, **params), "simhash-labels")
    gone = labels.where("doc_id > component_id").select("doc_id").distinct()
    kept = sized_join(docs, gone, gone.count(), 32, "doc_id", "left_anti").select(*docs.columns)
    repeated = labels.where("doc_id IS NOT NULL").groupBy("doc_id", "fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").distinct()
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select("doc_id", F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    told = F.struct(F.sha2(F.to_json("row"), 256), F.to_json("row"))
    once = again.groupBy("doc_id", "hash", F.col("row.text").alias("text")).agg(F.min_by("row", told).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
