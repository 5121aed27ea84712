import math

import numpy as np
import pytest

from lakewatch.llm import metric_tree
from tests.conftest import SF


def plain(rows, k=5, every=50, scale=256):
    """Every query against every other row, with Python's integers."""
    kept = [(j, i, [math.floor(scale * float(v)) for v in x]) for j, (i, x) in enumerate(rows) if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for j, i, x in kept:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), o is None, o or 0) for p, o, y in kept if p != j)[:k]
            out += [repr((i, r + 1, None if none else o, min(max(-s, -(1 << 63)), (1 << 63) - 1))) for r, (s, none, o) in enumerate(found)]
    return sorted(out)


def got(df):
    return sorted(repr((r.query_id, r.rank, r.vec_id, r.score)) for r in df.collect())


def test_equals_all_products_on_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert got(metric_tree.top_k(df, tree_rows=(60, 60), page=8, block=3)) == plain(rows)
    assert got(metric_tree.top_k(df)) == plain(rows)


def test_odd_rows_ties_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.integers(-2, 3, 5).astype(float).tolist()) for k in range(300)]
    rows += [(None, [2.0] * 5), (500, [0.5] * 5), (500, [0.5] * 5), (550, None), (600, []), (650, [1.0, 2.0]), (700, [None, 1.0]), (750, [float("nan")] * 5), (801, [float("inf")] * 5)]
    rows += [(1000 + k, [1.0, 1.0, 1.0, 0.0, 0.0]) for k in range(120)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<double>, row int, x string")
    assert got(metric_tree.top_k(df, scale=2, tree_rows=(40, 40), page=4)) == plain(rows, scale=2)
    assert got(metric_tree.top_k(df.where("vec_id in (0, 1, 550)"))) == plain([r for r in rows if r[0] in (0, 1, 550)])
    assert metric_tree.top_k(df.where("vec_id = 550")).collect() == []
    assert metric_tree.top_k(df.where("vec_id = 50")).collect() == []


def test_large_components(spark):
    rows = [(k * 10, [(-1.0) ** k * 10.0 ** (k % 25), 3.0, -(2.0**40)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = []
    for j, (i, x) in enumerate(rows):
        if i % 50 == 0:
            x = [math.floor(256 * v) for v in x]
            found = sorted((-clip(sum(a * math.floor(256 * b) for a, b in zip(x, y))), o) for p, (o, y) in enumerate(rows) if p != j)[:5]
            want += [repr((i, r + 1, o, -s)) for r, (s, o) in enumerate(found)]
    assert got(metric_tree.top_k(df, tree_rows=(20, 20), page=4)) == sorted(want)


@pytest.mark.parametrize("seed", range(5))
def test_bounds_exclude_and_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (30, 16))
    x = centres[rng.integers(0, 30, 4000)] + rng.integers(-6, 7, (4000, 16))
    most = float(metric_tree.squares(x).max())
    tree = metric_tree.Tree(x, list(range(4000)), np.arange(4000), x[7], most, page=32, fan=8)
    held = sorted(int(r) for leaf, *_, rows in tree.pages if leaf for r in rows)
    assert held == list(range(4000))
    for q in rng.integers(0, 4000, 20).tolist():
        seen = [0, 0]
        found = tree.search(x[q], q, 5, seen=seen)
        assert [(-s, i) for s, _, i, _ in found] == [(s, i) for s, i in sorted(((int(v), i) for i, v in enumerate(x @ x[q]) if i != q), key=lambda h: (-h[0], h[1]))[:5]]
        bound = -found[2][0]
        assert tree.search(x[q], q, 5, bound) == [f for f in found if -f[0] >= bound]
        assert seen[0] < 2500 and seen[1] > 0
