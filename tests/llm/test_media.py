import hashlib
import tarfile
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lakewatch.llm import media

ROWS = [(1, "abc"), (2, None), (3, ""), (4, "é" * 100), (5, "abc"), (None, "x" * 64), (6, "long text " * 50000), (7, "abc")]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_exact_round_trip(text):
    payload = media.padded(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text) and not payload[len(text) :].strip(b"\0")
    stored = media.encode(payload)
    assert media.decode(stored) == payload and media.header(stored[: media.HEADER_BYTES]) == (64, len(payload) // 64)


def test_columns(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, digest string, offset int").repartition(3)
    out = media.media_columns(df).collect()
    assert len(out) == len(ROWS)
    texts = dict(ROWS)
    for r in out:
        payload = media.padded((texts[r.doc_id] or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.feature == media.feature(payload)
        with open(r.shard.removeprefix("file://").removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            stored = f.read(r.length)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and len(stored) == r.media_bytes and r.width * r.height == r.payload_bytes
        with tarfile.open(r.shard.removeprefix("file://").removeprefix("file:")) as t:
            assert t.extractfile(f"{r.media_sha256}.png").read() == stored
    same = {(r.media_sha256, r.shard, r.offset, r.feature) for r in out if r.doc_id in (1, 5, 7)}
    assert len(same) == 1


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_are_dealt_by_their_bytes_and_kept_short(spark):
    df = spark.createDataFrame([(d, f"text {d} " * 400) for d in range(60)], "doc_id long, text string").repartition(2)
    rows, folder = media.store(df)
    stored = sum(r.length for r in rows.collect())
    known = media.features(media.dealt(rows, read_bytes=stored // 30), folder)
    assert known.rdd.getNumPartitions() >= 30 and {len(r.digest) for r in known.collect()} == {32}
    assert sorted((r.digest, r.width, r.height) for r in media.metadata(media.dealt(rows), folder).collect()) == sorted((r.digest, r.width, r.height) for r in known.collect())


def test_texts_are_packed_well():
    text = " ".join(f"{k * k % 1009} words of {k}" for k in range(2000)).encode()
    payload = media.padded(text)
    rows = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
    assert len(media.encode(payload)) < 0.95 * len(zlib.compress(rows, 1))
