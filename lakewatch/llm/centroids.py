"""Centroid clustering by dimension-sharded Lloyd iterations, exact in integers.

A vector is cut into column blocks; a chunk is a run of vectors, and a chunk's block is one row of a table. Tasks work on
blocks alone, beside the centroids' slices of the same columns:

1. A block gives its vectors' partial squared distances to all centroid slices; reduceByKey adds a chunk's blocks, within a
   task first, and takes the nearest centroid of each vector (ties: the smaller number).
2. The labels go back to the blocks. A block gives its columns' sums by cluster; reduceByKey adds them by column block,
   and each shard sets its own slice to floor(sum / count). A centroid without vectors stays.

The driver sees the `clusters` first centroids only. Slices and labels are joined to the blocks by column block and by chunk,
broadcast where their counted size allows it. Each round's slices and labels are tables in the shared folder, so that lineage
doesn't grow and a lost executor costs its tasks only. A chunk has CHUNK vectors at most, so no key grows with the input.

Vectors that are null, of another length, or hold a null or non-finite component take no part. Null and repeated ids
are vectors of their own; null ids come last among the first centroids, and equal hashes go by their components. Fewer vectors
than clusters make that many clusters. Sums and distances are exact at any size; one beyond a long is given as the largest
long. Empty tables give no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import pickle
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import map_arrow, materialize, sized_join
from lakewatch.llm.vectors import LARGEST, as_long, integers, largest, products

CLUSTERS, COMPONENTS, ROUNDS, SCALE = 8, 64, 10, 1024
#: Columns of a block; vectors of a chunk.
WIDTH, CHUNK = 16, 4096


def chunks(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """(chunk, block, data): a chunk's columns of a block, pickled; its vec_ids are block -1."""

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, x = integers(batch.column(1), scale, components)
            if len(rows):
                blocks = [batch.column(0).take(pa.array(rows)).to_pylist(), *(np.ascontiguousarray(x[:, at : at + width]) for at in range(0, components, width))]
                yield pa.record_batch([pa.array([chunk] * len(blocks), pa.int64()), pa.array(range(-1, len(blocks) - 1), pa.int32()), pa.array(map(pickle.dumps, blocks), pa.binary())], names=["chunk", "block", "data"])
                chunk += 1

    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(read, run, "chunk long, block int, data binary", rows=CHUNK)


def first_centroids(vectors: DataFrame, clusters: int, components: int, scale: int, seed: str) -> np.ndarray:
    """The vectors with the smallest SHA-256 of seed and id, in that order: `clusters` rows from each task, and at the driver."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.where(F.col("embedding").isNotNull() & whole).select(hashed.alias("h"), x.alias("x")).orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    return integers(pa.array([r.x for r in rows], pa.list_(pa.float64())), scale, components)[1]


def partial_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to slices, as far as these columns go."""
    if (2 * largest(x, c)) ** 2 * 4 * x.shape[1] < 1 << 53:
        return (x * x).sum(1)[:, None] - 2 * products(x, c) + (c * c).sum(1)
    x, c = x.astype(object), c.astype(object)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def _add_sums(x: tuple, y: tuple) -> tuple:
    return x[0] + y[0], x[1] + y[1], x[2]


def _nearest(distances: np.ndarray) -> tuple[bytes, bytes]:
    label = distances.argmin(1) if distances.dtype != object else np.array([min(range(len(d)), key=d.__getitem__) for d in distances.tolist()])
    return label.astype(np.int32).tobytes(), np.array([as_long(d) for d in distances[np.arange(len(label)), label].tolist()], np.int64).tobytes()


def labels_of(blocks: DataFrame, slices: DataFrame, n_slices: int, slice_bytes: int, parts: int) -> DataFrame:
    """(chunk, labels, distances): the nearest centroid of every vector, by adding its blocks' partial distances."""

    def run(batches):
        for b in batches:
            found = [pickle.dumps(partial_distances(pickle.loads(x), pickle.loads(c))) for x, c in zip(b.column("data").to_pylist(), b.column("slice").to_pylist())]
            yield pa.record_batch([b.column("chunk"), pa.array(found, pa.binary())], names=["chunk", "part"])

    part = map_arrow(sized_join(blocks, slices, n_slices, slice_bytes, "block", "inner").select("chunk", "data", "slice"), run, "chunk long, part binary", rows=8)
    summed = part.rdd.map(lambda r: (r.chunk, pickle.loads(r.part))).reduceByKey(add, parts).mapValues(_nearest)
    return part.sparkSession.createDataFrame(summed.map(lambda kv: (kv[0], *kv[1])), "chunk long, labels binary, distances binary")


def new_slices(blocks: DataFrame, slices: DataFrame, n_slices: int, slice_bytes: int, labels: DataFrame, n_chunks: int) -> DataFrame:
    """(block, slice): every shard's slice from its own columns' sums, for its vectors' labels."""

    def run(batches):
        for b in batches:
            found = []
            for x, c, own in zip(b.column("data").to_pylist(), b.column("slice").to_pylist(), b.column("labels").to_pylist()):
                x, c, own = pickle.loads(x), pickle.loads(c), np.frombuffer(own, np.int32)
                x, sums = x if largest(x) * len(x) < 1 << 62 else x.astype(object), np.zeros(c.shape, object)
                for k in np.unique(own).tolist():
                    sums[k] = x[own == k].sum(0).astype(object)
                found.append(pickle.dumps((sums, np.bincount(own, minlength=len(c)), c)))
            yield pa.record_batch([b.column("block"), pa.array(found, pa.binary())], names=["block", "part"])

    def moved(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
        rows = [(sums[k] // int(n)).tolist() if n else old[k].tolist() for k, n in enumerate(counts)]
        return np.array(rows, np.int64 if max((abs(v) for r in rows for v in r), default=0) < 1 << 62 else object)

    both = sized_join(sized_join(blocks, slices, n_slices, slice_bytes, "block", "inner"), labels.select("chunk", "labels"), n_chunks, 4 * CHUNK, "chunk", "inner")
    part = map_arrow(both.select("block", "data", "slice", "labels"), run, "block int, part binary", rows=8)
    summed = part.rdd.map(lambda r: (r.block, pickle.loads(r.part))).reduceByKey(_add_sums, n_slices)
    return part.sparkSession.createDataFrame(summed.map(lambda kv: (kv[0], pickle.dumps(moved(*kv[1])))), "block int, slice binary")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256: one row for each vector that takes part."""
    spark = vectors.sparkSession
    table = materialize(chunks(vectors, components, scale, width), "lloyd-blocks")
    blocks, ids = table.where("block >= 0"), table.where("block = -1")
    n_chunks, first = ids.count(), first_centroids(vectors, clusters, components, scale, seed)
    n_slices, slice_bytes, parts = -(-components // width), 16 * clusters * width, max(1, min(n_chunks, blocks.rdd.getNumPartitions()))
    slices = spark.createDataFrame([(k, pickle.dumps(first[:, at : at + width])) for k, at in enumerate(range(0, components, width))], "block int, slice binary")
    for _ in range(rounds):
        labels = materialize(labels_of(blocks, slices, n_slices, slice_bytes, parts), "lloyd-labels")
        slices = materialize(new_slices(blocks, slices, n_slices, slice_bytes, labels, n_chunks), "lloyd-slices")
    labels = materialize(labels_of(blocks, slices, n_slices, slice_bytes, parts), "lloyd-labels")

    def rows(batches):
        for b in batches:
            for own, label, distance in zip(b.column("data").to_pylist(), b.column("labels").to_pylist(), b.column("distances").to_pylist()):
                yield pa.record_batch([pa.array(pickle.loads(own), pa.int64()), pa.array(np.frombuffer(label, np.int32)), pa.array(np.frombuffer(distance, np.int64))], names=["vec_id", "cluster", "distance"])

    def texts(batches):
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("slice").to_pylist()):
                x = pickle.loads(data).tolist()
                yield pa.record_batch([pa.array(range(len(x)), pa.int32()), pa.array([block] * len(x), pa.int32()), pa.array([",".join(map(str, r)) for r in x])], names=["cluster", "block", "text"])

    out = materialize(map_arrow(ids.join(labels, "chunk").select("data", "labels", "distances"), rows, "vec_id long, cluster int, distance long", rows=8), "lloyd-rows")
    long = lambda c: F.least(c, F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    marks = map_arrow(slices, texts, "cluster int, block int, text string").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("t"))
    marks = marks.select("cluster", F.sha2(F.array_join(F.transform("t", lambda s: s.text), ","), 256).alias("centroid_sha256"))
    whole = sums.agg(long(F.sum("s")).alias("inertia"))
    # `clusters` rows, and one
    told = sums.select("cluster", long(F.col("s")).alias("cluster_inertia")).join(marks, "cluster").crossJoin(F.broadcast(whole))
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
