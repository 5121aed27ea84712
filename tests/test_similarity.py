import difflib
import random

import numpy as np

from lakewatch.functions.similarity import Strings, alike, common, shared


def _lcs(p, q):
    row = [0] * (len(q) + 1)
    for c in p:
        row = [0, *row]
        for j, d in enumerate(q, 1):
            row[j] = row[j] + 1 if c == d else max(row[j + 1], row[j - 1])
        row.pop()
    return row[-1]


def test_bounds_hold_and_nothing_is_lost():
    r = random.Random(2)
    words = ["".join(r.choice("abcdeé 公\U0001f600") for _ in range(r.choice([0, 1, 5, 63, 64, 65, 90, 140]))) for _ in range(60)]
    words += [w[:3] + "x" + w[4:] for w in words] + [w + w[:9] for w in words]
    x, every = Strings(words), np.arange(len(words))
    bound, most = np.stack([common(x, np.full(len(words), i), x, every) for i in every]), shared(x, every, x, every)
    for i, p in enumerate(words):
        for j, q in enumerate(words):
            assert _lcs(p, q) <= bound[i, j] <= most[i, j]
    want = sorted((i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if difflib.SequenceMatcher(None, words[i], words[j]).ratio() >= 0.85)
    assert sorted(zip(*alike(x, x, 0.85, every, every, same=True, rows=7))) == want
    y = Strings(words[:50])
    back = sorted((i, j) for i in range(len(words)) for j in range(50) if difflib.SequenceMatcher(None, *((words[i], words[j]) if i < j else (words[j], words[i]))).ratio() >= 0.7)
    assert sorted(zip(*alike(x, y, 0.7, every, every[:50]))) == back


def test_blocks_are_those_of_sequence_matcher():
    """Fails without a search of blocks for all pairs at once: every pair that passed the bounds went to difflib by itself."""
    from lakewatch.functions import similarity

    r = random.Random(7)
    words = ["".join(r.choice("aab é公\U0001f600") for _ in range(r.choice([1, 3, 20, 80, 199]))) for _ in range(40)]
    words += [w[: len(w) // 2] + "b" + w[len(w) // 2 + 2 :] for w in words]
    x, n = Strings(words), len(words)
    a, b = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(n)))
    got = similarity.matched(x.points, np.cumsum(x.size) - x.size, x.size, a, b, np.zeros(n * n, np.int64))
    assert got.tolist() == [sum(m.size for m in difflib.SequenceMatcher(None, words[i], words[j]).get_matching_blocks()) for i, j in zip(a, b)]
    cells = similarity._cells(x, x)
    bound = similarity._features(x, cells, 0.0, True) @ similarity._features(x, cells, 0.0, False).T
    assert len(cells) <= similarity.COLUMNS and (bound >= shared(x, np.arange(n), x, np.arange(n)) - 1e-2).all()


def test_two_batches_give_the_clusters_of_one(spark):
    from pyspark.sql import functions as F

    from lakewatch.operators import clusters
    from lakewatch.session import shared_dir

    shared_dir(spark)
    r, rows = random.Random(3), []
    for d in range(160):
        title = list(r.choice(rows)[1]) if rows and r.random() < 0.6 else list(" ".join(r.choice(["lei", "imposto", "de", "bens", "estado", "herança", "12/2024"]) for _ in range(r.randint(3, 9))))
        for _ in range(r.choice([0, 1, 3, 6])):
            title.insert(r.randrange(len(title) + 1), r.choice("xyz "))
        rows.append((d, "".join(title), f"u{d % 90}", f"h{r.randrange(150)}"))
    docs = spark.createDataFrame(rows, "doc_id long, titulo string, url string, content_hash string")
    one = {x.doc_id: x.root for x in clusters.extend_clusters(docs.limit(0).withColumn("root", F.col("doc_id")), docs)[0].collect()}
    by_id = {}
    for x in clusters.assign_clusters(docs).collect():
        by_id.setdefault(x.cluster_id, []).append(x.doc_id)
    assert one == {d: min(own) for own in by_id.values() for d in own} and len(by_id) < 160
    early, late = docs.where("doc_id < 100"), docs.where("doc_id >= 100")
    held = early.join(clusters.extend_clusters(early.limit(0).withColumn("root", F.col("doc_id")), early)[0], "doc_id").checkpoint()
    added, moved = clusters.extend_clusters(held, late)
    change = {x.root: x.new_root for x in moved.collect()}
    two = {x.doc_id: change.get(x.root, x.root) for x in held.collect()} | {x.doc_id: x.root for x in added.collect()}
    assert two == one and change


def _syllables(r, n):
    words = [" ".join("".join(r.choice(["th", "on", "er", "ing", "ea", "sh", "ti", "ble"]) for _ in range(r.randint(1, 4))) for _ in range(14))[: r.randint(40, 90)] for _ in range(n)]
    for k in range(2 * n):
        w = list(words[r.randrange(len(words))])
        for _ in range(r.choice([1, 4, 8])):
            w[r.randrange(len(w))] = r.choice("thone ")
        words.append("".join(w)[r.choice([0, 0, 5]) :])
    return words


def test_links_join_what_all_pairs_join():
    """Fails where every pair of a group of alike titles is looked at to the end: links are as few as join them."""
    from lakewatch.functions.similarity import Links

    words = _syllables(random.Random(11), 40)
    n, every = len(words), np.arange(len(words))
    want = Links(n)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if difflib.SequenceMatcher(None, words[i], words[j]).ratio() >= 0.85]
    want.add(*np.array(pairs).T)
    x = Strings(words)
    assert sorted(zip(*alike(x, x, 0.85, every, every, same=True))) == pairs
    links = list(zip(*alike(x, x, 0.85, every, every, same=True, links=True)))
    got = Links(n)
    got.add(*np.array(links).T)
    assert got.root.tolist() == want.root.tolist() and set(links) <= set(pairs)
    assert len(links) == n - len(set(want.root.tolist())) < len(pairs)
    left, right, own = Strings(words[:70]), Strings(words[70:]), Links(n)
    own.add(*np.array([p for p in pairs if p[0] < 70 <= p[1]]).T)
    i, j = alike(left, right, 0.85, every[:70], every[70:], links=True)
    got = Links(n)
    got.add(np.array(i), 70 + np.array(j))
    assert got.root.tolist() == own.root.tolist()


def test_links_are_computed_once(spark):
    """Fails where both directions of the links are a union: it computed all pairs of titles twice."""
    from lakewatch.operators import clusters
    from lakewatch.session import shared_dir

    shared_dir(spark)
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long").mapInArrow(seen, "a long, b long")
    found = clusters.components(edges, spark.createDataFrame([(k,) for k in range(1, 10)], "node long"))
    assert {x.node: x.root for x in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 7}
    assert rows.value == 3


def test_pieces_give_the_links_of_all_pairs(spark):
    from lakewatch.operators import clusters
    from lakewatch.session import shared_dir

    shared_dir(spark)
    words = _syllables(random.Random(12), 50)
    docs = spark.createDataFrame(list(enumerate(words)), "item long, titulo string")
    norm = {d: " ".join(w.split()) for d, w in enumerate(words)}
    want, got = [{d: d for d in norm} for _ in range(2)]

    def join(root, a, b):
        low, high = sorted((root[a], root[b]))
        for d in root:
            root[d] = low if root[d] == high else root[d]

    for i in norm:
        for j in range(i + 1, len(words)):
            if difflib.SequenceMatcher(None, norm[i], norm[j]).ratio() >= 0.85:
                join(want, i, j)
    for x in clusters.similar_pairs(docs, piece=20).collect():
        join(got, x.a, x.b)
    assert got == want and len(set(got.values())) < len(words) - 30
