"""Exact top-k search by inner product: best-first search in M-trees.

Inner products become distances by one more component: a candidate x gets sqrt(M - |x|^2), M the greatest squared norm, a query gets
0; then the squared distance is |q|^2 + M - 2 q.x, and the nearest candidate has the highest score. All scores are exact integers;
distances serve for bounds only, with a margin for their rounding.

1. Routing objects are a bounded sample (at most ROUTES vectors with the smallest hashes). Every vector goes to the
   nearest one; a route with more vectors than a tree may hold is split by a hash, so a hot route is many trees.
2. A task builds each tree: pages of at most PAGE entries, leaf entries with their distance to the page's routing object,
   inner entries with a child's routing object, its covering radius and its distance to the parent's routing object.
3. A query first searches the tree that holds its own vector; its k-th score there bounds all that follows. Then it goes to the
   other trees that its distance to their route and the route's radius leave open, in blocks of queries.
4. In a tree, pages wait in order of their lower bounds; the search ends when the least exceeds the k-th distance. Stored
   parent distances exclude entries by the triangle inequality before their distance is computed.

The routes and their radii are the only thing every task holds (ROUTES rows). Pages and queries meet in an equi-join by tree, a
row for each block of QUERIES queries, which adaptive execution can split. On vectors without clusters no bound excludes much: the
work is then that of the stated queries against all rows, in blocks.

Vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as if zeros followed. Null and
repeated ids are rows of their own: a query's own row is left out, its copies are not; a null id comes last among ties, and
equal ids go by place. Fewer candidates than k give fewer rows. Scores are exact; one beyond a long counts as the nearest long. Empty tables give no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewatch.llm.common import map_arrow, materialize
from lakewatch.llm.vectors import as_long, integers, largest, products
from lakewatch.session import ship_package

SCALE, NEAREST, EVERY = 256, 5, 50
#: Routing objects at most; vectors of a tree, from the first to the second as the table grows; entries of a page; queries of a block.
ROUTES, TREE_ROWS, PAGE, FAN, QUERIES = 512, (4096, 65536), 512, 16, 2048


def squares(x: np.ndarray) -> np.ndarray:
    """Squared norms as doubles."""
    y = x.astype(np.float64)
    return np.einsum("ij,ij->i", y, y)


def distances(x: np.ndarray, o: np.ndarray, x_extra: np.ndarray, o_extra: np.ndarray) -> np.ndarray:
    """Distances between rows, the additional component included."""
    x, o = x.astype(np.float64), o.astype(np.float64)
    d = (np.einsum("ij,ij->i", x, x) + x_extra**2)[:, None] + np.einsum("ij,ij->i", o, o) + o_extra**2 - 2 * (x @ o.T + np.outer(x_extra, o_extra))
    return np.sqrt(np.maximum(d, 0))


def clipped(score: np.ndarray) -> np.ndarray:
    return score if score.dtype != object else np.array([as_long(v) for v in score], np.int64)


def extra(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - squares(x), 0))


class Tree:
    """A bulk-loaded M-tree. `pages`: (is leaf, entries' vectors, distances to the page's routing object, radii, children or rows)."""

    def __init__(self, x: np.ndarray, ids: list, rows: np.ndarray, route: np.ndarray, most: float, page: int = PAGE, fan: int = FAN):
        self.ids, self.rows, self.most, self.route, self.pages = ids, rows, most, route, []
        self.page, self.fan = page, fan
        self.radius = self._build(x, extra(x, most), np.arange(len(x)), route[None], extra(route[None], most))
        self.pages.reverse()  # the root is the last page that is closed
        del self.page, self.fan
        self.largest, self.doubles = largest(x, route), None

    def scores(self, at: int, pick: np.ndarray | None, q: np.ndarray, q_double: np.ndarray | None) -> np.ndarray:
        """Exact inner products of a page's picked entries and a query; in doubles, made once, where they hold every sum."""
        if q_double is None:
            x = self.pages[at][1]
            return clipped(products(x if pick is None else x[pick], q[None])[:, 0])
        x = self.doubles[at]
        return (x if pick is None else x[pick]) @ q_double

    def _build(self, x: np.ndarray, x_extra: np.ndarray, own: np.ndarray, o: np.ndarray, o_extra: np.ndarray) -> float:
        """Adds the pages over the rows `own` below the routing object `o`, children first; gives its covering radius."""
        to_o = distances(x[own], o, x_extra[own], o_extra)[:, 0]
        if len(own) <= self.page:
            self.pages.append((True, x[own], to_o, None, own))
            return float(to_o.max(initial=0))
        fan = min(self.fan, max(2, -(-2 * len(own) // self.page)))
        chosen = own[np.linspace(0, len(own) - 1, fan).astype(np.int64)]
        near = distances(x[own], x[chosen], x_extra[own], x_extra[chosen]).argmin(1)
        parts = [(c, own[near == k]) for k, c in enumerate(chosen) if (near == k).any()]
        if max(len(p) for _, p in parts) > 0.9 * len(own):  # copies, or nearly: cut anyhow
            parts = [(p[0], p) for p in np.array_split(own, fan)]
        objects = np.array([c for c, _ in parts])
        radii, children = [], []
        for c, p in parts:
            radii.append(self._build(x, x_extra, p, x[c][None], x_extra[c][None]))
            children.append(len(self.pages) - 1)
        to_parent = distances(x[objects], o, x_extra[objects], o_extra)[:, 0]
        self.pages.append((False, x[objects], to_parent, np.array(radii), np.array(children)))
        return float(to_o.max(initial=0))

    def search(self, q: np.ndarray, own_row: int, k: int, bound: int | None = None, seen: list | None = None) -> list[tuple]:
        """The k best (-score, id is null, id, row) of the tree, leaving out those below the score `bound`. `seen` counts the
        entries whose distance was computed, and those that a stored bound excluded."""
        square, margin = float(squares(q[None])[0]), 1e-6 * math.sqrt(self.most) + 1e-9
        away = lambda score: np.sqrt(np.maximum(square + self.most - 2 * np.asarray(score, np.float64), 0))
        best: list[tuple] = []
        least = bound
        limit = float(away(bound)) + margin if bound is not None else math.inf
        last = len(self.pages) - 1
        q_double = None
        if largest(q) * self.largest * max(1, len(q)) < 1 << 53:
            self.doubles = self.doubles or [p[1].astype(np.float64) for p in self.pages]
            q_double = q.astype(np.float64)
        first = float(away(products(q[None], self.route[None])[0, 0]))
        open_ = [(max(0.0, first - self.radius), 0, first)]
        while open_:
            low, at, to_o = heapq.heappop(open_)
            if low > limit:
                break
            leaf, _, stored, radii, below = self.pages[at]
            bounds = np.abs(to_o - stored) - (0 if leaf else radii)
            pick = np.flatnonzero(~(bounds > limit))
            if seen is not None:
                seen[0] += len(pick)
                seen[1] += len(bounds) - len(pick)
            if not len(pick):
                continue
            score = self.scores(at, pick if len(pick) < len(stored) else None, q, q_double)
            if leaf:
                good = np.flatnonzero(score >= least) if least is not None else np.arange(len(score))
                fresh = [(-int(score[i]), self.ids[r] is None, self.ids[r] or 0, int(self.rows[r])) for i, r in zip(good, below[pick[good]])]
                best = heapq.nsmallest(k, [*best, *(b for b in fresh if b[3] != own_row)])
                if len(best) == k:
                    least = -best[-1][0] if least is None else max(least, -best[-1][0])
                    limit = float(away(least)) + margin
            else:
                to_q = away(score)
                for i, d in zip(pick.tolist(), to_q.tolist()):
                    under = max(d - radii[i], bounds[i], low)
                    if not under > limit:
                        heapq.heappush(open_, (under, last - int(below[i]), d))
        return best


def table(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, x, square): the vectors that take part, their integers pickled in as few bytes as hold them."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            kept, x = integers(batch.column(1), scale)
            small = x.dtype != object and np.abs(x).max(initial=0) < 1 << 15
            yield pa.record_batch(
                [pa.array(row + kept), batch.column(0).take(pa.array(kept)), pa.array([pickle.dumps(v) for v in (x.astype(np.int16) if small else x)], pa.binary()), pa.array(squares(x)), pa.array([x.shape[1]] * len(kept), pa.int32())],
                names=["row", "vec_id", "x", "square", "size"],
            )
            row += batch.num_rows

    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(read, run, "row long, vec_id long, x binary, square double, size int")


def stacked(pickled: list[bytes], size: int) -> np.ndarray:
    """Vectors below each other, zeros after the shorter ones."""
    each = [pickle.loads(p) for p in pickled]
    kind = object if any(v.dtype == object for v in each) else np.int64
    out = np.zeros((len(each), size), kind)
    for i, v in enumerate(each):
        out[i, : len(v)] = v
    return out


def routed(rows: DataFrame, routes: np.ndarray, most: float) -> DataFrame:
    """`rows` with the nearest route and the distance to it."""
    size, routes_extra = routes.shape[1], extra(routes, most)

    def run(batches):
        for b in batches:
            x = stacked(b.column("x").to_pylist(), size)
            d = distances(x, routes, extra(x, most), routes_extra)
            near = d.argmin(1)
            yield pa.record_batch([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=[*b.schema.names, "route", "away"])

    return map_arrow(rows, run, "row long, vec_id long, x binary, square double, size int, route int, away double")


def top_k(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, scale: int = SCALE, tree_rows: tuple[int, int] = TREE_ROWS, page: int = PAGE, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k highest inner products."""
    rows = materialize(table(vectors, scale), "mtree-vectors")
    n, most, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("square"), F.lit(0.0)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    full = min(max(n // 64, tree_rows[0]), tree_rows[1])
    sample = rows.orderBy(F.xxhash64("vec_id", "x"), "row").limit(min(-(-n // full), ROUTES)).select("x").collect()
    routes = stacked([r.x for r in sample], size)
    placed = materialize(routed(rows, routes, most), "mtree-routed")
    found = placed.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # ROUTES rows at most
    splits, radius = {r.route: -(-r.n // full) for r in found}, {r.route: r.radius for r in found}
    of = F.create_map(*(F.lit(v) for kv in splits.items() for v in kv))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), of[F.col("route")]).cast("int"))
    queries = placed.where(F.col("vec_id") % every == 0).select("route", "part", "row", "vec_id", "x")

    def build(key, own):
        own = own.sort_by("row")
        tree = Tree(stacked(own.column("x").to_pylist(), size), own.column("vec_id").to_pylist(), own.column("row").to_numpy(), routes[key[0].as_py()], most, page)
        return pa.table({"route": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    ship_package(rows.sparkSession)
    built = materialize(placed.select("route", "part", "row", "vec_id", "x").groupBy("route", "part").applyInArrow(build, "route int, part int, tree binary"), "mtree-trees")

    def spread(batches):
        """A query's other trees, those that its bound leaves open."""
        for b in batches:
            x, out = stacked(b.column("x").to_pylist(), size), []
            square = squares(x)
            d = np.sqrt(np.maximum(square[:, None] + most - 2 * (x.astype(np.float64) @ routes.astype(np.float64).T), 0))
            for i, (bound, route, part) in enumerate(zip(*(b.column(c).to_pylist() for c in ("bound", "route", "part")))):
                limit = math.inf if bound is None else math.sqrt(max(square[i] + most - 2 * bound, 0)) + 1e-6 * math.sqrt(most) + 1e-9
                out += [(i, r, p) for r in splits if not d[i, r] - radius[r] > limit for p in range(splits[r]) if (r, p) != (route, part)]
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.record_batch([b.column(c).take(at) for c in ("row", "vec_id", "x", "bound")] + [pa.array([o[j] for o in out], pa.int32()) for j in (1, 2)], names=["row", "vec_id", "x", "bound", "route", "part"])

    def search(batches):
        for b in batches:
            for data, own in zip(b.column("tree").to_pylist(), b.column("queries").to_pylist()):
                tree = pickle.loads(data)
                out = [(q["row"], q["vec_id"], *hit) for q in own for hit in tree.search(stacked([q["x"]], size)[0], q["row"], k, q["bound"])]
                query, query_id, score, none, vec_id, row = list(zip(*out)) or [()] * 6
                vec_id, score = [None if no else i for no, i in zip(none, vec_id)], [-s for s in score]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (query, query_id, vec_id, row, score)], names=["query", "query_id", "vec_id", "row", "score"])

    def searched(asked: DataFrame, blocks: int) -> DataFrame:
        held = asked.groupBy("route", "part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("row", "vec_id", "x", "bound")).alias("queries"))
        return map_arrow(held.join(built, ["route", "part"]).select("tree", "queries"), search, "query long, query_id long, vec_id long, row long, score long", rows=1)

    order = [F.desc("score"), F.col("vec_id").asc_nulls_last(), F.col("row")]
    at_home = materialize(searched(queries.withColumn("bound", F.lit(None).cast("long")), 1), "mtree-home")
    bounds = at_home.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    asked = queries.join(bounds, "row", "left").select("row", "vec_id", "x", "bound", "route", "part")
    opened = map_arrow(asked, spread, "row long, vec_id long, x binary, bound long, route int, part int", rows=max(1, min(256, (1 << 16) // sum(splits.values()))))
    both = at_home.unionByName(searched(opened, max(1, -(-n // every // block))))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
