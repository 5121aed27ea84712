import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from lakewatch.operators import health
from lakewatch.schema import RAW_ITEM
from lakewatch.sources import corpus
from lakewatch.streaming import jobs
from tests.conftest import SF

SMALL = SF.replace("0.01", "0.001")


def streamed(spark, df, tmp_path, transform, mode="update", files=3):
    """The rows that a stream over `df`, landed in a few files in order, gives."""
    jobs.use_state_store(spark)
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    out = []
    q = transform(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)).writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return out


def test_zero_runs_equal_the_batch_form(spark, tmp_path):
    history = corpus.run_history(spark, SMALL).orderBy("run_day")
    told = lambda rows: {(r.source_id, r.run_day, r.consecutive_zero_runs, r.last_nonzero_at, r.alert) for r in rows}
    assert told(streamed(spark, history, tmp_path, jobs.zero_run_stream)) == told(health.zero_runs(history).collect())


def test_admission_equals_a_loop(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i % 2, i, t0 + dt.timedelta(seconds=i * 7 % 400)) for i in range(120)]
    df = spark.createDataFrame(rows, "key long, event_id long, ts timestamp")
    got = {r.event_id: r.admitted for r in streamed(spark, df, tmp_path, lambda s: jobs.admission_stream(s, 3, 60))}
    kept, want = defaultdict(list), {}
    for key, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        kept[key] = [x for x in kept[key] if (ts - x).total_seconds() <= 60]
        want[i] = len(kept[key]) < 3
        if want[i]:
            kept[key].append(ts)
    assert got == want


def test_breaker_opens_and_recovers(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    seq = [(m, ok) for m, ok in [*((i, False) for i in range(5)), (6, True), (70, False), (71, True), (140, True), (141, True)]]
    df = spark.createDataFrame([("s", t0 + dt.timedelta(minutes=m), ok) for m, ok in seq], "source_id string, ts timestamp, ok boolean")
    rows = sorted(streamed(spark, df, tmp_path, jobs.breaker_stream), key=lambda r: r.ts)
    assert [(r.admitted, r.state) for r in rows] == [(True, "closed")] * 4 + [(True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_staleness_timer_and_failure_streak(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    (tmp_path / "in").mkdir()
    jobs.use_state_store(spark)
    out = []
    for k, rows in enumerate([[("s", 0, True), ("f", 0, True), *(("f", h, False) for h in range(1, 6))], [("f", 24, True), ("x", 24 * 9, True)], [("x", 24 * 10, True)]]):
        df = spark.createDataFrame([(s, t0 + dt.timedelta(hours=h), ok) for s, h, ok in rows], "source_id string, ts timestamp, ok boolean")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = jobs.staleness_stream(src).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert [(r.source_id, r.failures) for r in out if r.chronic and not r.stale] == [("f", 5)]
    assert {r.source_id for r in out if r.stale} == {"s", "f"}


def test_watch_cooldown(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("w", i, t0 + dt.timedelta(hours=i), 3) for i in range(8)] + [("x", i, t0 + dt.timedelta(hours=i), 0) for i in range(3)], "watch_id string, doc_id long, ts timestamp, cooldown_hours int")
    got = streamed(spark, df, tmp_path, jobs.trigger_stream)
    assert sorted((r.watch_id, r.doc_id) for r in got) == [("w", 0), ("w", 3), ("w", 6), ("x", 0), ("x", 1), ("x", 2)]


def test_ingest_stores_each_content_once(spark, tmp_path):
    row = lambda h, d: {"source_id": "s", "titulo": "t", "url": "u", "texto": "x", "fetched_at": f"2024-01-0{d}T00:00:00Z", "content_hash": h}
    import json

    (tmp_path / "in").mkdir()
    for k, hs in enumerate((["a", "b", "a"], ["b", "c"])):
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(row(h, k + 1)) for h in hs))
        jobs.ingest(jobs.item_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b", "c"]
    assert RAW_ITEM.count(",") == 6


def test_windows_and_heartbeat_stream(spark, tmp_path):
    c = corpus.corpus(spark, SMALL).select("doc_id", "fetched_at", "eff_date", "severity_tier", "topics")
    day = streamed(spark, c, tmp_path / "a", lambda s: jobs.periodic_digest(s, "7 days", "1 day"), "complete") if (tmp_path / "a").mkdir() is None else []
    assert sum(r.n for r in day) == c.count()
    e = corpus.source_events(spark, SMALL)
    (tmp_path / "b").mkdir()
    beat = {r.source_id: r.last_ok for r in streamed(spark, e, tmp_path / "b", jobs.heartbeat_stream, "complete")}
    assert beat == {r.source_id: r.m for r in e.where("ok").groupBy("source_id").agg(F.max("ts").alias("m")).collect()}


def test_a_batch_reads_its_own_folders_of_the_store(spark, tmp_path):
    items = spark.range(4000).select(F.lit("s").alias("source_id"), F.lit("t").alias("titulo"), F.lit("u").alias("url"), F.lit("x").alias("texto"), F.lit(None).cast("timestamp").alias("data_publicacao"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
    table, told = str(tmp_path / "t"), lambda: spark.read.parquet(str(tmp_path / "t")).select("content_hash").collect()
    items.where("titulo = 't'").write.json(str(tmp_path / "in"))
    run = lambda ck: jobs.ingest(jobs.item_stream(spark, str(tmp_path / "in")), table, str(tmp_path / ck), 64).awaitTermination(120)
    run("c1")
    assert len(told()) == 4000
    run("c2")  # the same items as another stream: nothing is added
    assert len(told()) == 4000
    few = items.limit(3)
    read = jobs.stored_like(few, table, 64)
    plan = read._jdf.queryExecution().executedPlan()
    read.count()
    assert few.join(read, "content_hash", "left_anti").count() == 0
    assert read.select(F.input_file_name()).distinct().count() <= 3 < spark.read.parquet(table).select(F.input_file_name()).distinct().count()
    assert "PartitionFilters" in plan.toString()


def test_zero_runs_and_chains_in_ranges(spark):
    import random

    from lakewatch.operators import audit

    r, day = random.Random(8), dt.date(2023, 1, 1)
    rows = [(s, day + dt.timedelta(days=d), r.choice([0, 0, 0, 2])) for s in ("a", "b", None) for d in range(300) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "source_id string, run_day date, items long")
    want, state = set(), {}
    for s, d, n in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        zeros, last = state.get(s, (0, None))
        state[s] = zeros, last = (0, d) if n else (zeros + 1, last)
        want.add((s, d, n, zeros, last, zeros == 5))
    for days in (1, 7, 92, 10_000):
        assert {tuple(x) for x in health.zero_runs(df, 5, days).collect()} == want
    t0 = dt.datetime(2024, 1, 1)
    entries = spark.createDataFrame([("o" if k % 3 else "p", k, t0 + dt.timedelta(minutes=90 * k), "a", "x") for k in range(200)], "owner_id string, entry_id long, timestamp timestamp, action string, payload string")
    log = audit.append(entries, spark.createDataFrame([], "owner_id string, last_hash string"))
    bad = log.withColumn("payload", F.when(F.col("entry_id") == 50, "y").otherwise(F.col("payload"))).cache()
    for hours in (1, 24, 10**6):
        assert audit.verify(log, hours).where("NOT valid").count() == 0
        assert [x.entry_id for x in audit.verify(bad, hours).where("NOT valid").collect()] == [52]


def test_a_replay_computes_its_table_once(spark):
    from lakewatch.streaming.replay import replay

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(6).selectExpr("id % 2 AS key", "id AS event_id", "TIMESTAMP '2024-01-01' + id * INTERVAL '1' HOUR AS ts").mapInPandas(counted, "key long, event_id long, ts timestamp")
    assert replay(rows, "ts", lambda r: jobs.admission_stream(r, 2, 7200)).count() == 6 and seen.value == 6
