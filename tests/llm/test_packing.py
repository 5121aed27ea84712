import zlib
from array import array
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from lakewatch.llm import packing
from tests.conftest import SF


def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


ENCODE = encoder()
TOKENS = packing.Tokens(packing.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab ''sStd\n\t  é1.,!<|>　ñ \x85", "<|endoftext|>"]), max_size=40).map("".join))
def test_cached_words_give_the_ids_of_the_whole_text(text):
    assert TOKENS.of(text) == array("I", ENCODE(text)).tobytes()


def test_special_strings_and_empty():
    for text in ("", " ", "<|endoftext|> a b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "a  b", "\n", "x " * 50):
        assert TOKENS.of(text) == array("I", ENCODE(text)).tobytes()


def test_cuts_fill_their_class():
    for n in range(1, 5000):
        parts = packing.cuts(n)
        assert sum(parts) == n
        assert all(1024 - 1024 // p * p <= packing.SLACK for p in parts)


def check(rows, docs):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, text in docs.items():
        ids = ENCODE(text or "") + [0]
        parts, at = sorted(by_doc[d], key=lambda r: r.start), 0
        for r in parts:
            assert (r.start, r.doc_tokens) == (at, len(ids))
            part = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(array("I", part).tobytes()) and ("ids" not in r or r.ids == part)
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    used = sum(r.length for r in rows)
    return used / (1024 * len(by_sequence))


def test_round_trip_and_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fill = check(packing.pack(docs, with_ids=False).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert fill > 0.97


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "w " * 3000), (None, "null id"), (5, "é" * 700)]
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, class string, range string, mark long")
    check(packing.pack(df).collect(), {d: t for d, t in rows})
    twice = packing.pack(df.unionByName(df)).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) == 2 * packing.pack(df).count()
    assert packing.pack(df.limit(0)).count() == 0
