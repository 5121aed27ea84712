"""What the training-data operators share: reading, materialising, shipping code and scanning text in numpy."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewatch.session import shared_dir, ship_package

#: Bytes of the smaller side up to which a join may be broadcast; beyond it the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that the vectorised scanners take at a time (a longer document is taken alone).
CHUNK_BYTES = 1 << 19
#: Bytes of a batch that the JVM hands a Python worker at once, about, where the session sets no other limit (Spark's own is 10,000
#: rows, some 20 MB of documents, which the JVM and the worker hold twice).
BATCH_BYTES, BATCH_BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: The word separators of every contract: space and 0x09 to 0x0D.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def tables_dir(spark: SparkSession) -> str:
    """The application's own folder of intermediate tables, in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/lakewatch/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the application. Results that read them must have been written before."""
    at = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a table of its own in the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialize` has written and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def map_arrow(df: DataFrame, fn, schema, rows: int = 2_000) -> DataFrame:
    """`mapInArrow` with the package at hand in the workers. `fn` takes and gives iterators of record batches; it gets at
    most `rows` rows at a time, so that what it builds for them stays small, of batches of about BATCH_BYTES. Workers drop what
    they have kept for other modules than `fn`'s."""
    spark, owner = df.sparkSession, fn.__module__
    ship_package(spark)
    if spark.conf.get(BATCH_BYTES_KEY, None) is None:
        spark.conf.set(BATCH_BYTES_KEY, str(BATCH_BYTES))

    def run(batches):
        drop_kept(owner)
        try:
            yield from fn(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


_kept: dict[str, dict] = {}


def kept(module: str) -> dict:
    """What a worker keeps for `module`'s tasks from one to the next. Workers are used again by later stages, so it goes when a
    task of another module starts."""
    return _kept.setdefault(module, {})


def drop_kept(owner: str) -> None:
    """Drops what is kept for modules other than `owner`."""
    others = [x for module, x in _kept.items() if module != owner and x]
    for x in others:
        x.clear()
    if others:
        release_memory()


def release_memory() -> None:
    """Gives what a task has freed back to the system: workers are used again, and their allocators would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def sized_join(big: DataFrame, small: DataFrame, rows: int, row_bytes: int, on, how: str) -> DataFrame:
    """Join that broadcasts `small` only if its counted rows stay under BROADCAST_BYTES; else both sides are shuffled
    and adaptive execution splits hot keys."""
    return big.join(F.broadcast(small) if rows * row_bytes <= BROADCAST_BYTES else small, on, how)


def utf8(column: str = "text") -> Column:
    """The UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def texts(array: pa.Array) -> list[str]:
    """Strings of a binary column; broken UTF-8 is replaced."""
    return [x.decode("utf-8", "replace") for x in array.to_pylist()]


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a binary or string column; nulls are empty."""
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """(first row, end row) of runs of rows of about `size` bytes; each has a row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


#: Bytes of a span that are hashed eight at a time; what is longer is hashed by sums over its bytes.
SHORT_SPAN = 64
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span of `data`, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    x = np.zeros(len(data) + 8, np.uint8)
    x[: len(data)] = data
    if lower:
        x += ((x >= 65) & (x <= 90)).view(np.uint8) << 5
    eight = np.ndarray(len(data) + 1, "<u8", x, 0, (1,))  # the eight bytes from each place on
    length = ends - starts
    cut = lambda at, n: eight[at] & _LOW_BYTES[np.minimum(n, 8)]
    out = mix64(cut(starts, length) ^ (length.astype(np.uint64) * _BASE))
    k, done = np.flatnonzero(length > 8), 8
    while len(k) and done < SHORT_SPAN:
        out[k] = mix64(out[k] * _BASE + cut(starts[k] + done, length[k] - done))
        done += 8
        k = k[length[k] > done]
    if len(k):
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[x[: len(data)]] * up[: len(data)], out=sums[1:])
        out[k] = mix64(out[k] * _BASE + (sums[ends[k]] - sums[starts[k]]) * down[starts[k]])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a run of texts; a word ends where its text ends."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = (data != 32) & (data - np.uint8(9) > 4)  # what is below 9 wraps round
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | cut[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | cut[1:])) + 1
    return starts, ends
