import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from lakewatch.llm import components, simhash


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({i: " " for i in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxh64_intdigest(g.encode(), 42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(grams))


def groups(values, bits):
    label = list(range(len(values)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(values)):
        for j in range(i):
            if ((values[i] ^ values[j]) & (2**64 - 1)).bit_count() <= bits:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def fingerprints():
    r = random.Random(1)
    out = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(r.randrange(7)):
                x ^= 1 << r.randrange(64)
            out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


@pytest.mark.parametrize("bits,dense", [(4, 256), (4, 1), (4, 5), (3, 2), (1, 1), (0, 2)])
def test_links_have_the_components_of_all_pairs(spark, bits, dense):
    fps = fingerprints()
    want = {}
    for i, g in enumerate(groups(fps, bits)):
        want.setdefault(g, set()).add(fps[i])
    found = {}
    for row in components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), bits, dense)).collect():
        found.setdefault(row.root, set()).add(row.node)
    assert {frozenset(v) for v in found.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def test_documents_equal_brute_force(spark):
    r = random.Random(2)
    words = ["Alpha", "béta", "gamma", "δέλτα", "x\ty", "one", "two", "three", "four"]
    texts = [None, "", " \n", "one", "ONE", "one two three", "One\x0btwo  three"]
    for _ in range(15):
        t = [r.choice(words) for _ in range(r.choice([3, 4, 5, 60, 200]))]
        texts.append(" ".join(t))
        if len(t) > 50:
            t[r.randrange(len(t))] = "changed"
            texts += [" ".join(t), " ".join(t)]
    texts.append("long " * 30000)
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    fps = [slow_fingerprint(t or "") for t in texts]
    g = groups(fps, 4)
    least = {k: min(i for i, x in zip(ids, g) if x == k) for k in set(g)}
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.components(df).collect()}
    assert got == {i: (f"{f:016x}", least[k]) for i, f, k in zip(ids, fps, g)}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == set(least.values())


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.components(empty).count() == 0
    assert simhash.components(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")).count() == 3


def test_every_four_positions_hold_a_triple():
    from itertools import combinations

    keys = simhash.triples()
    assert len(set(keys)) == len(keys) == 20
    assert all(any(set(k) <= set(four) for k in keys) for four in combinations(range(8), 4))


def test_repeated_rows_and_doc_ids(spark):
    rows = [(3, "a b", "x"), (3, "a b", "x"), (4, "A B", "x"), (5, "c d e f", "x"), (5, "g h i j", "x"), (None, "a b", "x")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, row string"))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a b"), (3, "a b"), (5, "c d e f"), (5, "g h i j")]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 501), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert np.all([k >= v for k, v in roots.items()])
