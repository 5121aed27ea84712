import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lakewatch.llm import alignment
from tests.conftest import SF


def plain(docs):
    """Every row by whole-text encoding with the two libraries and plain loops."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.models import BPE  # noqa: F401

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level tokens show as themselves
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
    rows, pair_docs = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(docs):
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in t.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows.append((doc_id, 0, 0, 0, "", Counter()))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, links = [], Counter()
        for lo, hi in zip([0, *cuts], cuts):
            x, y = [i for i, e in zip(a, a_ends) if lo < e <= hi], [i for i, e in zip(b, b_ends) if lo < e <= hi]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            links.update((i, j) for i in x for j in y)
        for p in links:
            pair_docs[p].add(k)
        rows.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    most = Counter()
    for (i, _), own in pair_docs.items():
        most[i] = max(most[i], len(own))
    return sorted(
        (repr((doc_id, n_a, n_b, n_groups, links.total(), sum(n for p, n in links.items() if len(pair_docs[p]) == most[p[0]]), sum(n * len(pair_docs[p]) for p, n in links.items()), mark)))
        for doc_id, n_a, n_b, n_groups, mark, links in rows
    )


def got(df):
    return sorted(repr((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


ODD = [
    None, "", " ", "  a  b ", "a", "a a a a b b", "x\ny  z\n", "<|endoftext|> <s> <0x0A>", "▁x", "ﬁ ① né ñandú", "日本語 テキスト 日本", "tab\tx \x00 y", "  ", "😀 😀😀 x😀", "the the the of the", "a b c", "word" * 500,
]


def test_equals_plain_loops(spark):
    docs = [(k % 20 if k else None, t) for k, t in enumerate(ODD + ODD[5:9])]
    assert got(alignment.align(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)


def test_documents_with_small_limits(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF.replace('0.01', '0.001')}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in rows]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = plain(docs)
    assert got(alignment.align(df)) == want
    monkeypatch.setattr(alignment, "BROADCAST_BYTES", 0)  # pair counts joined by a shuffle
    assert got(alignment.align(df)) == want


def test_flushed_bitmaps_are_merged(spark):
    docs = spark.createDataFrame([(k, " ".join(["of the cat"] * (1 + k % 5))) for k in range(2_000)], "doc_id long, text string").coalesce(1)
    parts = alignment.scan(docs, entries=100).where("bits IS NOT NULL").select(*alignment._BITMAP)
    rows = alignment.pair_counts(alignment.merged(parts)).collect()
    assert parts.where("plane = 0").count() > len(rows) > 0
    assert {r.n_docs for r in rows} == {2_000}
    assert {r.n_links for r in rows} == {6_000}
    whole = alignment.pair_counts(alignment.merged(alignment.scan(docs).where("bits IS NOT NULL").select(*alignment._BITMAP))).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, whole))


@pytest.mark.parametrize("sizes", [[], [1], [1023, 1024, 1025, 3], [16384, 1, 5000], [0, 2]])
def test_bitmaps_round_trip(sizes):
    rng = np.random.default_rng(3)
    runs = [np.sort(rng.choice(alignment.SLOTS, n, replace=False)) for n in sizes]
    coded = alignment.encode_bitmaps(np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.int64), *runs]))
    row, slot = alignment.decode_bitmaps(coded)
    assert [slot[row == k].tolist() for k in range(len(sizes))] == [r.tolist() for r in runs]
    counts, both = alignment.merge_bitmaps(np.zeros(len(sizes), np.int64), coded, 1)
    union = sorted(set(np.concatenate([np.zeros(0, np.int64), *runs]).tolist()))
    assert counts.tolist() == [len(union)] and alignment.decode_bitmaps(both)[1].tolist() == union
    assert all(len(x) <= alignment.BYTES for x in coded.to_pylist())


def test_empty_table_and_other_columns(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b", 5, "z", 2)], "doc_id int, text string, container long, bits string, number int")
    assert got(alignment.align(df)) == plain([(1, "a b")])


def test_sliced_binary_arrays():
    coded = alignment.encode_bitmaps(np.array([2, 1, 3]), np.array([5, 9, 1, 2, 3, 4]))
    assert alignment.decode_bitmaps(coded[1:])[1].tolist() == [1, 2, 3, 4]
    assert pa.array(coded[2:].to_pylist()) == coded[2:]
