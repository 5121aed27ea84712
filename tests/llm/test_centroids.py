import hashlib
import math

import numpy as np

from lakewatch.llm import centroids
from tests.conftest import SF


def plain(rows, clusters=8, components=64, rounds=10, scale=1024):
    """Lloyd's rounds with Python's integers, row by row."""
    kept = [(i, [math.floor(scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == components and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(x) for _, x in order[:clusters]]
    distance = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    nearest = lambda x: min((distance(x, y), k) for k, y in enumerate(c))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for k in range(len(c)):
            mine = [x for (_, x), o in zip(kept, own) if o == k]
            if mine:
                c[k] = [sum(v) // len(mine) for v in zip(*mine)]
    last = [nearest(x) for _, x in kept]
    inertia = [sum(d for d, o in last if o == k) for k in range(len(c))]
    marks = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(repr((i, o, d, inertia[o], sum(inertia), marks[o])) for (i, _), (d, o) in zip(kept, last))


def got(df):
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in df.collect())


def test_equals_plain_rounds_on_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert got(centroids.cluster(df)) == plain([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows_ties_and_shuffled_joins(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k % 30 if k % 31 else None, rng.integers(-3, 4, 6).astype(float).tolist()) for k in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 7), (204, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (205, [float("nan")] * 6), (206, [float("inf")] + [0.0] * 5)]
    rows += rows[:9]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id int, embedding array<float>, block string, data int")
    want = plain(rows, 5, 6, 3, 4)
    monkeypatch.setattr(centroids, "CHUNK", 7)
    assert got(centroids.cluster(df, 5, 6, 3, 4, width=4)) == want
    monkeypatch.setattr("lakewatch.llm.common.BROADCAST_BYTES", 0)
    assert got(centroids.cluster(df, 5, 6, 3, 4, width=4)) == want


def test_few_large_and_no_vectors(spark):
    rows = [(1, [1e30, -1e30]), (2, [3.0, 5.0]), (3, [1e30, -1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = centroids.cluster(df, 8, 2, 2).collect()
    assert [(r.vec_id, r.distance) for r in sorted(out, key=lambda r: r.vec_id)] == [(1, 0), (2, 0), (3, 0)]
    assert len({r.cluster for r in out}) == 2
    df = spark.createDataFrame([(k, [(-1.0) ** k * 1e300, 7.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {r.inertia for r in centroids.cluster(df, 1, 2, 1).collect()} == {(1 << 63) - 1}
    assert centroids.cluster(df.where("vec_id < 0")).collect() == []
