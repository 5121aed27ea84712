"""Streaming forms: ingest with dedup, windows, and the keyed state machines."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakewatch.operators.filters import scanner_fields, unseen, without_scanners
from lakewatch.schema import RAW_ITEM, struct
from lakewatch.session import ship_package


def use_state_store(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def item_stream(spark: SparkSession, path: str, delay: str = "7 days") -> DataFrame:
    """Landed items, each content once within the watermark."""
    items = spark.readStream.schema(struct(RAW_ITEM)).json(path)
    return items.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["content_hash"])


#: Folders of a store of items, by their content's hash.
STORE_BUCKETS = 1024


def stored_like(batch: DataFrame, table: str, buckets: int = STORE_BUCKETS) -> DataFrame:
    """The hashes of the store at `table` from the folders that the batch's contents belong to; the others aren't read."""
    own = sorted(r[0] for r in batch.select(_store_bucket(buckets).alias("b")).distinct().collect())  # `buckets` numbers at most
    return batch.sparkSession.read.schema("content_hash STRING, bucket INT").parquet(table).where(F.col("bucket").isin(own)).select("content_hash")


def _store_bucket(buckets: int):
    return F.pmod(F.xxhash64("content_hash"), F.lit(buckets)).cast("int")


def ingest(stream: DataFrame, table: str, checkpoint: str, buckets: int = STORE_BUCKETS):
    """Each micro-batch's unseen items are added to the store at `table`, which has a folder for each bucket of contents: a batch
    reads and writes its own folders only. A batch that is run again finds its items there and adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(table)
        first = not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)  # any other error of reading the table is one
        batch.persist()
        try:
            if not batch.isEmpty():
                new = batch if first else unseen(batch, stored_like(batch, table, buckets))
                new = new.dropDuplicates(["content_hash"]).withColumn("bucket", _store_bucket(buckets))
                new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(table)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ordered(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """The rows in order; those that share the columns `by` (as far as there are such) stay as they came."""
    frames = list(rows)
    return pd.concat(frames).sort_values([c for c in by if c in frames[0]], kind="stable") if frames else pd.DataFrame()


class ZeroRuns(StatefulProcessor):
    """Rows (source_id, run_day, items) -> consecutive zero runs, the last day with items, alert exactly at `alert_at`."""

    def __init__(self, alert_at: int = 7, most: int = 10_000):
        self.alert_at, self.most = alert_at, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("zeros", "zeros int, last date")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (zeros, last), out = (self.state.get() if self.state.exists() else (0, None)), []
        for r in _ordered(rows, "run_day").itertuples():
            zeros, last = (0, r.run_day) if r.items > 0 else (zeros + 1, last)
            out.append((key[0], r.run_day, int(r.items), min(zeros, self.most), last, zeros == self.alert_at))
        self.state.update((min(zeros, self.most), last))
        yield pd.DataFrame(out, columns=["source_id", "run_day", "items", "consecutive_zero_runs", "last_nonzero_at", "alert"])

    def close(self) -> None:
        pass


def zero_run_stream(history: DataFrame, alert_at: int = 7) -> DataFrame:
    ship_package(history.sparkSession)
    out = "source_id string, run_day date, items long, consecutive_zero_runs int, last_nonzero_at date, alert boolean"
    return history.groupBy("source_id").transformWithStateInPandas(ZeroRuns(alert_at), out, "Update", "None")


class Breaker(StatefulProcessor):
    """Rows (source_id, ts, ok) -> the circuit's state after each: open after `most` failures, half open after `hours`,
    closed again by a success; failures aren't forgotten while half open, so the next failure opens it again."""

    def __init__(self, most: int = 5, hours: float = 1.0):
        self.most, self.hours = most, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("circuit", "state string, failures int, opened timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, failures, opened = self.state.get() if self.state.exists() else ("closed", 0, datetime(1970, 1, 1))
        out = []
        for r in _ordered(rows, "ts", "event_id").itertuples():
            ts = pd.Timestamp(r.ts).to_pydatetime()
            if state == "open" and ts - opened.replace(tzinfo=ts.tzinfo) >= timedelta(hours=self.hours):
                state = "half_open"
            admitted = state != "open"
            if admitted and r.ok:
                state, failures = "closed", 0
            elif admitted:
                failures += 1
                if state == "half_open" or failures >= self.most:
                    state, opened = "open", ts
            out.append((key[0], r.ts, bool(r.ok), admitted, state, failures))
        self.state.update((state, failures, opened.replace(tzinfo=None)))
        yield pd.DataFrame(out, columns=["source_id", "ts", "ok", "admitted", "state", "failures"])

    def close(self) -> None:
        pass


def breaker_stream(events: DataFrame, most: int = 5, hours: float = 1.0) -> DataFrame:
    ship_package(events.sparkSession)
    out = "source_id string, ts timestamp, ok boolean, admitted boolean, state string, failures int"
    return events.groupBy("source_id").transformWithStateInPandas(Breaker(most, hours), out, "Update", "None")


class Admission(StatefulProcessor):
    """Rows (key, ts) -> admitted: at most `limit` admitted ones in any `seconds`, both ends counted; refused ones don't count."""

    def __init__(self, limit: int = 10, seconds: int = 60):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames, span = list(rows), self.seconds * 1_000_000
        if not frames:
            return
        # whole arrays and plain integers (microseconds): a key has few rows, so what is done once a key or a row decides the time
        ids, ts = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("event_id", "ts"))
        order = np.lexsort((ids, ts))
        ids, ts = ids[order], ts[order]
        window = [int(np.datetime64(x[0], "us").astype(np.int64)) for x in self.accepted.get()] if self.accepted.exists() else []
        admitted = []
        for now in ts.astype("datetime64[us]").astype(np.int64).tolist():
            window = [x for x in window if now - x <= span]
            admitted.append(len(window) < self.limit)
            if admitted[-1]:
                window.append(now)
        if window:
            self.accepted.put([(x,) for x in np.array(window, "datetime64[us]").tolist()])
        yield pd.DataFrame({"key": key[0], "event_id": ids, "ts": ts, "admitted": admitted})

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, limit: int = 10, seconds: int = 60) -> DataFrame:
    ship_package(requests.sparkSession)
    return requests.groupBy("key").transformWithStateInPandas(Admission(limit, seconds), "key long, event_id long, ts timestamp, admitted boolean", "Update", "None")


class Cooldown(StatefulProcessor):
    """Rows (watch_id, doc_id, ts, cooldown_hours) -> those that fire: none within the cooldown of the last that did."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out = (pd.Timestamp(self.last.get()[0]) if self.last.exists() else None), []
        for r in _ordered(rows, "ts", "doc_id").itertuples():
            ts = pd.Timestamp(r.ts)
            if last is None or not r.cooldown_hours or (ts - last).total_seconds() >= r.cooldown_hours * 3600:
                last = ts
                out.append((key[0], r.doc_id, r.ts))
        if last is not None:
            self.last.update((last.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["watch_id", "doc_id", "ts"])

    def close(self) -> None:
        pass


def trigger_stream(hits: DataFrame) -> DataFrame:
    ship_package(hits.sparkSession)
    return hits.groupBy("watch_id").transformWithStateInPandas(Cooldown(), "watch_id string, doc_id long, ts timestamp", "Update", "None")


class Heartbeat(StatefulProcessor):
    """Rows (source_id, ts, ok) -> last success and failure, failures since the last success, and whether the source is chronic
    (`most` failures in a row). A timer in event time tells a source stale that has had no success for `days`."""

    def __init__(self, days: float = 7.0, most: int = 5):
        self.days, self.most = days, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("beat", "ok timestamp, failure timestamp, failures int")

    def _told(self, key, stale: bool) -> pd.DataFrame:
        ok, failure, failures = self.state.get()
        row = (key[0], ok, failure, failures, stale, failures >= self.most)
        return pd.DataFrame([row], columns=["source_id", "last_ok", "last_failure", "failures", "stale", "chronic"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ok, failure, failures = self.state.get() if self.state.exists() else (None, None, 0)
        for r in _ordered(rows, "ts").itertuples():
            ts = pd.Timestamp(r.ts).to_pydatetime()
            ok, failure, failures = (ts, failure, 0) if r.ok else (ok, ts, failures + 1)
        self.state.update((ok, failure, failures))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if ok is not None:
            self.handle.registerTimer(int(pd.Timestamp(ok).timestamp() * 1000 + self.days * 86_400_000))
        yield self._told(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._told(key, True)

    def close(self) -> None:
        pass


def staleness_stream(events: DataFrame, days: float = 7.0, most: int = 5, delay: str = "1 hour") -> DataFrame:
    ship_package(events.sparkSession)
    out = "source_id string, last_ok timestamp, last_failure timestamp, failures int, stale boolean, chronic boolean"
    return events.withWatermark("ts", delay).groupBy("source_id").transformWithStateInPandas(Heartbeat(days, most), out, "Update", "EventTime")


def heartbeat_stream(events: DataFrame) -> DataFrame:
    return events.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_failure"))


def periodic_digest(docs: DataFrame, width: str = "1 day", delay: str | None = None) -> DataFrame:
    """Documents by tumbling window of fetched_at and tier; also over a batch."""
    d = docs.withWatermark("fetched_at", delay) if delay else docs
    return d.groupBy(F.window("fetched_at", width).alias("w"), F.coalesce("severity_tier", F.lit("n/a")).alias("tier")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "tier", "n")


def rolling_trend(docs: DataFrame, width: str = "7 days", step: str = "1 day", delay: str | None = None) -> DataFrame:
    """Topics by sliding window of eff_date; also over a batch."""
    d = docs.withWatermark("eff_date", delay) if delay else docs
    return d.select("eff_date", F.explode("topics").alias("topic")).groupBy(F.window("eff_date", width, step).alias("w"), "topic").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "topic", "n")


def trigger_filter(triggers: DataFrame, agents: str, networks: DataFrame) -> DataFrame:
    """Webhook events without scanners; a stream joins the static table of networks."""
    return without_scanners(scanner_fields(triggers), agents, networks)
