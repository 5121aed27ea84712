"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit greyscale PNG, 64 samples wide. Tasks write tar shards to the shared folder and a
payload once each, named by its SHA-256; rows carry digest, shard, offset and length. A digest's canonical place is the
smallest of its places, so no payload crosses the network to be deduplicated. Metadata columns come from range reads of
the 33 header bytes alone; features from range reads of whole payloads, once for each digest and by the same task. Digests
are 32 bytes until they are given out.

A shard is opened under a new name for each attempt at a task, so a repeated task never disturbs what rows refer to; the
rows are written to a table before they are used. Places in shards are the only columns that differ between runs.

Nulls: a null text is empty: 64 zero samples. Equal texts get equal values, repeated rows included. A null doc_id is kept. A
text of any length is one payload, in its task's memory while it is encoded. Empty tables give no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewatch.llm.common import map_arrow, materialize, tables_dir, utf8

WIDTH = 64
#: Bytes at which a task starts its next shard; stored bytes that a task reads back, about.
SHARD_BYTES, READ_BYTES = 256 << 20, 16 << 20
#: Payloads whose places a task remembers; then it starts anew, and a copy of one may be stored again.
REMEMBERED = 1 << 17
#: How hard zlib tries: payloads are 6 % smaller than at 1 on the given texts, for twice the time.
LEVEL = 6
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a greyscale PNG of that many samples."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _part(b"IHDR", header) + _part(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _part(b"IEND", b"")


def header(head: bytes) -> tuple[int, int]:
    """(width, height) from the first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE:
        raise ValueError("not a stored payload")
    return struct.unpack(">II", head[16:24])


def decode(stored: bytes) -> bytes:
    width, height = header(stored)
    at, packed = 8, b""
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        packed += stored[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, share of changes between neighbours, and brightest and darkest row's means."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    rows = x.reshape(-1, WIDTH).sum(1, dtype=np.int64)
    entropy = 0.0 - float(np.sum(p * np.log2(p)))
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};changes={np.mean(x[1:] != x[:-1]):.4f};row_max={rows.max()};row_min={rows.min()}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def store(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, str]:
    """(rows, folder): doc_id, n_bytes and the place of each row's payload: digest (of the stored form), shard in the folder, offset,
    length."""
    folder = f"{tables_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"

    def run(batches):
        system, at = _filesystem(folder)
        system.create_dir(at, recursive=True)
        places: dict[bytes, tuple[bytes, str, int, int]] = {}
        out, shard = None, ""
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    key = hashlib.sha256(text).digest()
                    place = places.get(key)
                    if place is None:
                        if len(places) >= REMEMBERED:
                            places.clear()
                        stored = encode(padded(text))
                        name = hashlib.sha256(stored).digest()
                        if out is None or out.tell() > shard_bytes:
                            if out is not None:
                                out.write(b"\0" * 1024)
                                out.close()
                            shard = f"{uuid.uuid4().hex[:16]}.tar"
                            out = system.open_output_stream(f"{at}/{shard}")
                        info = tarfile.TarInfo(f"{name.hex()}.png")
                        info.size = len(stored)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT))
                        place = places[key] = (name, shard, out.tell(), len(stored))
                        out.write(stored + b"\0" * (-len(stored) % 512))
                    rows.append((doc_id, len(text), *place))
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()

    rows = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")), run, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long")
    return materialize(rows, "media-rows"), folder


def places(rows: DataFrame) -> DataFrame:
    """One row for each digest: its canonical shard, offset and length."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def dealt(rows: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """The canonical places for tasks of about `read_bytes`, each a run of neighbouring places in order, so that it reads few shards
    forwards."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    n = max(least, (rows.agg(F.sum("length")).first()[0] or 0) // read_bytes)
    return places(rows).repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def read_ranges(at: DataFrame, folder: str, schema: str, whole=None) -> DataFrame:
    """Digest, and of its first HEADER_BYTES bytes width and height; or, with `whole`, the place, width and height, and then what that
    makes of all its bytes, a tuple of `schema`."""
    place = ("digest", "shard", "offset", "length")[: 4 if whole else 1]
    columns = [x.split() for x in ", ".join([*(f"{c} {dict(at.dtypes)[c]}" for c in place), "width long", "height long", *([schema] if whole else [])]).split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches):
        name, file = None, None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if shard != name:
                    if file is not None:
                        file.close()
                    system, path = _filesystem(f"{folder}/{shard}")
                    name, file = shard, system.open_input_file(path)
                file.seek(offset)
                size = header(file.read(HEADER_BYTES))
                if whole:
                    file.seek(offset)
                rows.append((digest, shard, offset, length, *size, *whole(file.read(length))) if whole else (digest, *size))
            listed = list(zip(*rows)) or [()] * len(columns)
            yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(listed, columns)], names=[n for n, _ in columns])
        if file is not None:
            file.close()

    return map_arrow(at.select("digest", "shard", "offset", "length"), run, ", ".join(" ".join(c) for c in columns))


def metadata(at: DataFrame, folder: str) -> DataFrame:
    """digest, width and height, from header bytes alone."""
    return read_ranges(at, folder, "")


def features(at: DataFrame, folder: str) -> DataFrame:
    """The place, width and height from header bytes, and of the payload read back: bytes, SHA-256, CRC-32 of its last 64, and
    feature; bytes and SHA-256 of the stored form, which must be the digest."""

    def of(stored: bytes):
        payload = decode(stored)
        return len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).digest(), feature(payload)

    return read_ranges(at, folder, "payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string", of)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the features of the row's stored payload, width and height, its digest and its place."""
    rows, folder = store(docs)
    out = rows.select("doc_id", "n_bytes", "digest").join(features(dealt(rows), folder), "digest")
    told = {c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256")} | {"shard": F.concat(F.lit(f"{folder}/"), "shard")}
    columns = [c for c in out.columns if c not in ("width", "height")] + ["width", "height"]
    return out.select(*[told.get(c, F.col(c)).alias(c) for c in columns])
