"""Duplicates and clusters of items."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewatch.functions.detect import act
from lakewatch.functions.similarity import Strings, alike
from lakewatch.functions.text import compare_form
from lakewatch.session import shared_dir, ship_package

FUZZY = 0.85
#: Titles of a piece at least; two pieces are compared as one group.
PIECE = 4096
#: Tasks that the groups are dealt to at most.
MOST_TASKS = 1024


def cluster_key(title: str = "titulo", url: str = "url", uf: str | None = None) -> Column:
    """`numato:N/YYYY` by the title's first act (with the region, if `uf` is given), else `url:...`."""
    number = act(F.col(title))
    key = F.concat(F.lit("numato:"), number) if uf is None else F.concat(F.lit("numato:"), F.col(uf), F.lit(":"), number)
    return F.coalesce(key, F.concat(F.lit("url:"), F.col(url)))


def duplicate_flags(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items with whether their content, or their key, is stored."""
    i = items.withColumn("cluster_key", cluster_key())
    h = stored.select("content_hash").distinct().withColumn("same_hash", F.lit(True))
    k = stored.select(cluster_key().alias("cluster_key")).distinct().withColumn("same_key", F.lit(True))
    no = F.lit(False)
    return i.join(h, "content_hash", "left").join(k, "cluster_key", "left").withColumn("same_hash", F.coalesce("same_hash", no)).withColumn("same_key", F.coalesce("same_key", no))


def _near(batches, least: float):
    """(a, b) of each group of rows (u, v, part, item, fresh, norm), of equal u and v and in order of part: links that join all alike
    titles of which one at least is fresh, one of part 0 and one of part 1, or two of part 0 if the group is a piece by itself (u = v).
    A group is two pieces: what is held is bounded."""

    def pairs(rows):
        u, v, part, item, fresh, norm = rows
        first = int(np.searchsorted(part, 1))
        left, right = slice(0, first), slice(0, first) if u[0] == v[0] else slice(first, len(item))
        sides = [(np.flatnonzero(fresh[left]), np.flatnonzero(fresh[right])), (np.flatnonzero(~fresh[left]), np.flatnonzero(~fresh[right]))]
        todo = [(sides[0][0], sides[0][1]), (sides[0][0], sides[1][1])] + ([(sides[1][0], sides[0][1])] if u[0] != v[0] else [])
        titles, others, found = norm[left], norm[right], [np.zeros((2, 0), np.int64)]
        for k, m in todo:  # fresh with fresh, and fresh with others
            same = u[0] == v[0] and len(m) == len(k) and m is sides[0][1]
            x = Strings([titles[n] for n in k])
            y = x if same else Strings([others[n] for n in m])
            i, j = alike(x, y, least, item[left][k], item[right][m], same=same, links=True)
            found.append(np.stack([item[left][k][i], item[right][m][j]]))
        a, b = np.concatenate(found, axis=1)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held = None
    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v", "part", "item", "fresh")] + [batch.column("norm").to_pylist()]
        held = new if held is None else [np.concatenate([h, c]) for h, c in zip(held[:5], new[:5])] + [held[5] + new[5]]
        bounds = np.flatnonzero(np.diff(held[0], prepend=-1) | np.diff(held[1], prepend=-1)).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield pairs([c[a:b] for c in held])
        if bounds:
            held = [c[bounds[-1] :] for c in held]
    if held is not None and len(held[0]):
        yield pairs(held)


def similar_pairs(items: DataFrame, least: float = FUZZY, piece: int | None = None) -> DataFrame:
    """(a, b) of items (item, titulo), a < b: pairs whose titles' ratio, of the smaller item's to the other's, reaches `least`; as many
    of them as have the components of all.

    Equal normalised titles are linked to their smallest item, which alone is compared. Titles are cut by length into
    pieces of about `piece` (PIECE, and more as the titles grow); a title goes to every group of two pieces in which a length lets
    the ratio be reached, and a group is one task's work. In it, the characters that both titles have, then their longest common
    subsequence, rule out all but a few pairs in whole arrays; SequenceMatcher's blocks, found in whole arrays too, decide on those
    that the group's links don't join yet. No index on substrings does better here: a ratio of 0.85 allows 24 edits in 80 characters,
    so only substrings of 3 are sure to survive, and most pairs of titles share one at a near place. Titles that are null or blank once
    normalised have no links. If `items` has a column `fresh`, only pairs with a fresh title are looked for: the others are known."""
    known = F.col("fresh") if "fresh" in items.columns else F.lit(True)
    t = items.select("item", known.alias("fresh"), compare_form(F.col("titulo")).alias("norm")).where("norm <> ''")
    rep = t.groupBy("norm").agg(F.min("item").alias("rep"), F.bool_and("fresh").alias("fresh")).checkpoint()
    same = t.join(rep.select("norm", "rep"), "norm").where("item <> rep").select(F.col("rep").alias("a"), F.col("item").alias("b"))
    sizes = rep.groupBy(F.length("norm").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()  # a row for each length of a title
    piece = piece or min(max(sum(r.n for r in sizes) // 32, PIECE), 8 * PIECE)
    of, last, at = {}, -1, piece
    for r in sizes:  # pieces of whole lengths; a length with many titles has several pieces, dealt by a hash
        own = max(1, -(-r.n // piece))
        if own > 1 or at + r.n > piece:
            of[r["size"]], last, at = (last + 1, own), last + own, r.n if own == 1 else piece
        else:
            of[r["size"]], at = (last, 1), at + r.n
    if not of:
        return same
    reach = {k: [m for m in of if 2 * min(k, m) >= least * (k + m) - 1e-9] for k in of}
    told = lambda kv: F.create_map(*[F.lit(x) for k, v in kv for x in (k, v)])[F.length("norm")]
    own = told([(k, first) for k, (first, _) in of.items()]) + F.pmod(F.xxhash64("norm"), told([(k, n) for k, (_, n) in of.items()])).cast("int")
    partners = F.sequence(told([(k, of[min(v)][0]) for k, v in reach.items()]), told([(k, sum(of[max(v)]) - 1) for k, v in reach.items()]))
    dealt = rep.select(F.col("rep").cast("long").alias("item"), "fresh", "norm", own.alias("own")).withColumn("other", F.explode(partners))
    group = dealt.select(F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), (F.col("own") > F.col("other")).cast("int").alias("part"), "item", "fresh", "norm")
    ship_package(items.sparkSession)
    tasks = min((last + 1) * (last + 2) // 2, MOST_TASKS)  # named, as partitions would be joined by their bytes, which don't tell the work
    streams = group.repartition(tasks, "u", "v").sortWithinPartitions("u", "v", "part")
    return streams.mapInArrow(lambda batches: _near(batches, least), "a long, b long").unionByName(same)


def components(edges: DataFrame, nodes: DataFrame, most_rounds: int = 30) -> DataFrame:
    """(node, root): smallest node reachable, by rounds of minimum labels with pointer jumping, each checkpointed."""
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # a union would compute the edges twice
    both = edges.select(F.inline(ways)).distinct().checkpoint()
    label = nodes.select("node", F.col("node").alias("root")).checkpoint()
    for _ in range(most_rounds):
        near = both.join(label, both.a == label.node).groupBy("b").agg(F.min("root").alias("m"))
        step = label.join(near, label.node == near.b, "left").select("node", F.least("root", F.coalesce("m", "root")).alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        after = step.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).checkpoint()
        moved = after.join(label.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count()
        label = after
        if not moved:
            return label
    raise RuntimeError("components did not settle")


def assign_clusters(items: DataFrame, least: float = FUZZY) -> DataFrame:
    """Items (doc_id, titulo, url, content_hash) with cluster_id: equal content, equal key or alike titles, transitively;
    the id is a digest of the earliest member's content and key."""
    shared_dir(items.sparkSession)
    i = items.select("doc_id", "titulo", "content_hash", cluster_key().alias("cluster_key")).checkpoint()  # read five times
    first = lambda c: i.groupBy(c).agg(F.min("doc_id").alias("a")).join(i.select("doc_id", c), c).where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    edges = first("content_hash").unionByName(first("cluster_key")).unionByName(similar_pairs(i.select(F.col("doc_id").alias("item"), "titulo"), least))
    roots = components(edges, i.select(F.col("doc_id").alias("node")))
    name = i.select(F.col("doc_id").alias("root"), F.substring(F.sha2(F.concat_ws("|", "content_hash", "cluster_key"), 256), 1, 16).alias("cluster_id"))
    return items.join(roots.join(name, "root").select(F.col("node").alias("doc_id"), "cluster_id"), "doc_id")


def extend_clusters(stored: DataFrame, new: DataFrame, least: float = FUZZY) -> tuple[DataFrame, DataFrame]:
    """stored(doc_id, root, titulo, url, content_hash), the map of earlier items to their clusters' first members, and new items ->
    (doc_id, root of the new items; root, new_root of the stored clusters that new items have joined to an earlier one).

    Only pairs with a new item are looked for. What is stored of a cluster is one node, so the components that are computed are
    those that new items touch; two batches give the same clusters as one."""
    shared_dir(new.sparkSession)
    columns = ("doc_id", "titulo", "url", "content_hash")
    i = stored.select(*columns, F.lit(False).alias("fresh")).unionByName(new.select(*columns, F.lit(True).alias("fresh"))).withColumn("cluster_key", cluster_key()).checkpoint()
    own = i.where("fresh")

    def first(c: str) -> DataFrame:
        least_one = i.join(own.select(c).distinct(), c, "left_semi").groupBy(c).agg(F.min("doc_id").alias("a"))
        return least_one.join(own.select(c, F.col("doc_id").alias("b")), c).where("a <> b").select("a", "b")

    edges = first("content_hash").unionByName(first("cluster_key")).unionByName(similar_pairs(i.select(F.col("doc_id").alias("item"), "titulo", "fresh"), least))
    roots = stored.select(F.col("doc_id").alias("d"), "root")
    for end in ("a", "b"):
        edges = edges.join(roots, F.col(end) == F.col("d"), "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
    edges = edges.where("a <> b").distinct().checkpoint()
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).union(new.select("doc_id")).distinct()
    found = components(edges, nodes)
    moved = found.join(stored.select(F.col("root").alias("node")).distinct(), "node", "left_semi").where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("new_root"))
    return new.select("doc_id").join(found, F.col("doc_id") == F.col("node")).select("doc_id", "root"), moved


def thematic_members(docs: DataFrame) -> DataFrame:
    """doc_id, uf and the group (topics, numero) of each document with topics: sorted topics and act number."""
    d = docs.where(F.size(F.coalesce("topics", F.array())) > 0)
    return d.select("doc_id", "uf", F.array_join(F.array_sort("topics"), "+").alias("topics"), F.coalesce(F.col("metadados")["numero_ato"], F.lit("_")).alias("numero"))


def thematic(docs: DataFrame) -> DataFrame:
    """Groups by sorted topics and act number: distinct regions and how many documents. Documents without topics are left out;
    `thematic_members` lists a group's documents, which aren't gathered in its row."""
    by = thematic_members(docs).groupBy("topics", "numero", "uf").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("topics", "numero").agg(F.array_sort(F.collect_set("uf")).alias("ufs"), F.sum("n").alias("n"))  # regions are few


def multi_region(groups: DataFrame) -> DataFrame:
    return groups.where(F.size("ufs") > 1)
