"""The audit log's hash chain, and sliding-window admission."""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(prev: Column | None = None) -> Column:
    """An entry as JSON with its fields in alphabetical order."""
    return F.to_json(F.struct("action", "entry_id", "owner_id", F.sha2("payload", 256).alias("payload_hash"), (prev if prev is not None else F.col("prev_hash")).alias("prev_hash"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")))


def verify(log: DataFrame, hours: int = 24) -> DataFrame:
    """Every entry with whether its prev_hash is the digest of the entry before it (zeros for an owner's first).

    An owner's log is verified in ranges of `hours`, each by itself; a range's first entry is held against the last digest of
    the range before, which is the only thing that ranges pass on. So an owner with most of the log is many tasks."""
    d = log.withColumn("digest", F.sha2(canonical(), 256)).withColumn("range", F.floor(F.unix_seconds("timestamp") / (3600 * hours)))
    d = d.withColumn("before", F.lag("digest").over(Window.partitionBy("owner_id", "range").orderBy("timestamp", "entry_id")))
    last = d.groupBy("owner_id", "range").agg(F.max_by("digest", F.struct("timestamp", "entry_id")).alias("last"))
    carried = F.lag("last", 1, GENESIS).over(Window.partitionBy("owner_id").orderBy("range"))  # a row for each range
    passed = last.select(F.col("owner_id").alias("o"), F.col("range").alias("r"), carried.alias("carried"))
    j = d.join(passed, F.col("owner_id").eqNullSafe(F.col("o")) & F.col("range").eqNullSafe(F.col("r")))
    return j.withColumn("expected", F.coalesce("before", "carried")).withColumn("valid", F.col("prev_hash") == F.col("expected")).select(*log.columns, "expected", "valid")


def append(entries: DataFrame, last: DataFrame) -> DataFrame:
    """entries(owner_id, entry_id, timestamp, action, payload) chained after each owner's `last` (owner_id, last_hash).
    A chain is sequential by nature: an owner's new entries are linked in one task, owners in parallel. The
    task reads its owners' sorted entries as a stream and holds the last hash and a batch, not an owner's whole log."""
    rows = entries.join(last, "owner_id", "left").select("owner_id", "entry_id", "timestamp", "action", "payload", F.coalesce("last_hash", F.lit(GENESIS)).alias("last_hash"), canonical(F.lit("@")).alias("form"))

    names = ["owner_id", "entry_id", "timestamp", "action", "payload"]

    def chain(batches):
        owner, prev = object(), GENESIS
        for batch in batches:
            out = []
            for own, last_hash, form in zip(*(batch.column(c).to_pylist() for c in ("owner_id", "last_hash", "form"))):
                if own != owner:
                    owner, prev = own, last_hash
                out.append(prev)
                prev = hashlib.sha256(form.replace('"prev_hash":"@"', f'"prev_hash":"{prev}"').encode()).hexdigest()
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "prev_hash"])

    streams = rows.repartition("owner_id").sortWithinPartitions("owner_id", "timestamp", "entry_id")
    return streams.mapInArrow(chain, "owner_id string, entry_id long, timestamp timestamp, action string, payload string, prev_hash string")


def admission_bound(requests: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    """Requests with how many their key made in the window, and whether the limit certainly admits them: rejected ones
    count here, so this admits no more than the exact state machine does."""
    by = Window.partitionBy("key").orderBy(F.unix_seconds("ts")).rangeBetween(1 - seconds, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(by)).withColumn("admitted", F.col("in_window") <= limit)


def _segments(requests: DataFrame, limit: int, seconds: int, bucket: int) -> DataFrame:
    """`requests` with `us` (ts in microseconds), `open_` (whether what was refused before may matter for the row) and `segment`
    (where such a stretch of its key begins).

    A row with fewer than `limit` earlier ones in its window is admitted whatever happened. Only the stretches around other rows have
    to be folded, each from an empty state: every row in the window of a doubtful one belongs to its stretch. All windows are
    over buckets of time, with the rows near a bucket's ends seen from both sides, so a busy key is many tasks."""
    span, wide = 1_000_000 * seconds, 1_000_000 * max(bucket, 2 * seconds)
    r = requests.withColumn("us", F.unix_micros("ts"))
    at = F.floor(F.col("us") / wide)
    near = F.array_compact(F.array(at, F.when(F.col("us") - at * wide < span, at - 1), F.when((at + 1) * wide - F.col("us") <= 2 * span, at + 1)))
    r = r.withColumn("own", at).withColumn("bucket", F.explode(near))
    by = Window.partitionBy("key", "bucket")
    up, down = by.orderBy("us", "event_id"), by.orderBy(F.desc("us"), F.desc("event_id"))
    held = up.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("doubt", F.coalesce(F.col("us") - F.lag("us", limit).over(up) <= span, F.lit(False)))
    r = r.withColumn("after", F.coalesce(F.col("us") - F.last(F.when(F.col("doubt"), F.col("us")), ignorenulls=True).over(held) <= span, F.lit(False)))
    r = r.withColumn("before", F.last(F.when(F.col("after"), F.col("us")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("open_", F.coalesce(F.col("before") - F.col("us") <= span, F.lit(False)))
    apart = F.coalesce(~F.lag("open_").over(up) | (F.col("us") - F.lag("us").over(up) > span), F.lit(True))
    r = r.withColumn("begins", F.when(F.col("open_") & apart, F.struct("us", "event_id"))).where("bucket = own")
    r = r.withColumn("in_bucket", F.last("begins", ignorenulls=True).over(held))
    last = r.groupBy("key", "bucket").agg(F.max("begins").alias("last_one"))  # a row for each bucket of a key's life
    carried = F.last("last_one", ignorenulls=True).over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    passed = last.select(F.col("key").alias("k"), F.col("bucket").alias("b"), carried.alias("carried"))
    return r.join(passed, F.col("key").eqNullSafe(F.col("k")) & (F.col("bucket") == F.col("b"))).withColumn("segment", F.coalesce("in_bucket", "carried"))


def admit(requests: DataFrame, limit: int = 10, seconds: int = 60, bucket: int = 3600) -> DataFrame:
    """requests(key, event_id, ts) with whether each is admitted: at most `limit` admitted ones in any `seconds` (both ends
    counted), in order of ts and event_id; refused ones don't count. Exact: the same as the state machine in a stream.

    Stretches of a key in which a refusal may matter are folded one after the other, each as a sorted stream of which the last
    admitted times are held; all other rows are admitted by window functions. Null keys are one key; rows without a ts are left out."""
    s = _segments(requests.select("key", "event_id", "ts"), limit, seconds, bucket).checkpoint()
    span, names = 1_000_000 * seconds, ["key", "event_id", "ts"]

    def fold(batches):
        own, held = None, deque()
        for batch in batches:
            out = []
            for key, us, segment in zip(*(batch.column(c).to_pylist() for c in ("key", "us", "segment"))):
                if own != (key, segment):
                    own, held = (key, segment), deque()
                while held and held[0] < us - span:
                    held.popleft()
                out.append(len(held) < limit)
                if out[-1]:
                    held.append(us)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.bool_())], names=[*names, "admitted"])

    streams = s.where("open_").select(*names, "us", F.to_json("segment").alias("segment")).repartition("key", "segment").sortWithinPartitions("key", "segment", "us", "event_id")
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    folded = streams.mapInArrow(fold, ", ".join(f"{n} {kinds[n]}" for n in names) + ", admitted boolean")
    return s.where("NOT open_").select(*names, F.lit(True).alias("admitted")).unionByName(folded)
