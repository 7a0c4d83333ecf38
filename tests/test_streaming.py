"""Throttles: the batch twin against a plain loop, and the windows on a stream."""

import random
import time

from pyspark.sql import functions as F

from pactum.operators import portfolio
from pactum.storage import set_conf
from pactum.streaming import runs, throttle


def plain(rows, limit, window, login):
    kept, out = {}, []
    for key, at, ok in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        live = [t for t in kept.get(key, []) if at - t < window]
        allowed = len(live) < limit
        if login:
            live = [] if allowed and ok else [*live, at] if allowed else live
        elif allowed:
            live = [*live, at]
        kept[key] = live
        out.append((key, at, ok, allowed))
    return sorted(out)


def test_replay(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(400), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "key string, at long, ok boolean")
    for login in (False, True):
        got = throttle.replay(df, 3, 60, login).select("key", "at", "ok", "allowed").collect()
        assert sorted(map(tuple, got)) == plain(rows, 3, 60, login)


def test_replay_empty_and_unlimited(spark):
    empty = spark.createDataFrame([], "key string, at long, ok boolean")
    assert throttle.replay(empty, 3, 60).count() == 0
    rows = spark.createDataFrame([("a", 1, True), ("a", 1, True)], "key string, at long, ok boolean")
    assert [r["allowed"] for r in throttle.replay(rows, 0, 60).collect()] == [True, True]


def test_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = throttle.windowed_usage(stream, "1 day").writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert rows(spark.table("usage")) == rows(throttle.windowed_usage(batch, "1 day"))


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(spark, tmp_path, schema, parts, make, name):
    """Rows of a streaming query over files that come one batch at a time, and its last progress."""
    source = tmp_path / "in"
    source.mkdir()
    with set_conf(spark, *STORE):
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(source)))
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start(str(tmp_path / "out"))
            assert run.awaitTermination(100) and run.exception() is None
    return spark.read.parquet(str(tmp_path / "out")), run.lastProgress


def test_throttle_stream_agrees_with_its_batch_twin(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted((("ab")[rng.randrange(2)], rng.randrange(600), rng.random() < 0.5) for _ in range(120))
    rows.sort(key=lambda r: (r[1], r[2]))
    parts = [rows[:50], rows[50:90], rows[90:], [("z", 100_000, True)], [("z", 100_001, True)]]
    cut = [max(r[1] for r in part) for part in parts[:2]]
    parts[1:3] = [[r for r in rows if cut[0] < r[1] <= cut[1]], [r for r in rows if r[1] > cut[1]]]
    parts[0] = [r for r in rows if r[1] <= cut[0]]
    schema = "key string, at long, ok boolean"
    out, progress = _run(spark, tmp_path, schema, parts, lambda s: throttle.stream(s, 3, 60, late="5 minutes"), "throttle")
    every = [r for part in parts for r in part]
    want = throttle.replay(spark.createDataFrame(every, schema), 3, 60)
    rows_of = lambda df: sorted(tuple(r) for r in df.select("key", "at", "ok", "allowed", "left_over").collect())
    assert rows_of(out) == rows_of(want)
    assert progress.stateOperators[0].customMetrics is not None


def test_silent_keys_leave_no_state(spark, tmp_path):
    schema = "key string, at long, ok boolean"
    parts = [[(f"k{i}", i, True) for i in range(30)], [("late", 50_000, True)], [("late", 50_001, True)]]
    _, progress = _run(spark, tmp_path, schema, parts, lambda s: throttle.stream(s, 3, 60, late="1 minute"), "silent")
    # The list of the one live key is left, beside timers and row counts of that key.
    assert progress.stateOperators[0].numRowsTotal <= 6


def test_budget_stream(spark, tmp_path):
    schema = "key string, seq long, at long, ok boolean, cost double"
    calls = [("r", i, i, i not in (4, 5), 0.2) for i in range(8)] + [("s", i, i, True, 0.6) for i in range(4)]
    out, _ = _run(spark, tmp_path, schema, [calls[:3], calls[3:]], lambda s: throttle.budget_stream(s, 6, 1.0, 2), "budget")
    got = {(r["key"], r["seq"]): (r["allowed"], r["reason"]) for r in out.collect()}
    assert [got["r", i] for i in range(8)] == [(True, "")] * 6 + [(False, "calls")] * 2
    assert [got["s", i] for i in range(4)] == [(True, "")] * 2 + [(False, "cost")] * 2


def test_denied_once(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 5), ("b", 1)], "key string, at long").withColumn("ts", F.timestamp_seconds("at"))
    assert throttle.denied_once(rows, "1 minute").isStreaming is False


def test_orphans_on_a_stream(spark, tmp_path):
    """The timer finds what the batch twin finds: runs unfinished and silent for too long."""
    schema = "run_id string, at long, status string, cancelled boolean"
    first = [("dead", 100, "RUNNING", False), ("ends", 100, "RUNNING", None), ("lives", 100, "PENDING", False), ("stopped", 110, "RUNNING", False)]
    second = [("ends", 130, "DONE", False), ("lives", 160, "RUNNING", False), ("stopped", 140, "RUNNING", True), ("lives", 290, "RUNNING", False), ("dead", 120, "RUNNING", False)]
    parts = [first, second, [("lives", 400, "RUNNING", False)], [("lives", 401, "RUNNING", False)]]
    out, progress = _run(spark, tmp_path, schema, parts, lambda s: runs.orphan_stream(s, 200, "10 seconds"), "orphans")
    got = {r["run_id"]: r["heartbeat_at"] for r in out.collect()}
    last = {}
    for run, at, status, cancelled in sorted((r for p in parts for r in p), key=lambda r: r[1]):
        last[run] = (run, status, bool(cancelled), "me", at)
    table = spark.createDataFrame(list(last.values()), "run_id string, status string, cancelled boolean, owner_id string, at long").withColumn("heartbeat_at", F.timestamp_seconds("at"))
    assert got == {r["run_id"]: r["at"] for r in portfolio.orphans(table, "me", F.timestamp_seconds(F.lit(401)), 200).collect()} == {"dead": 120}
    assert progress.stateOperators[0].numRowsTotal <= 4


def test_progress_of_a_stream_as_a_table(spark, tmp_path):
    listener = runs.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        schema = "user_id long, ts timestamp, event_type string, value double"
        parts = [spark.range(5), spark.range(7)]
        for df in parts:
            df.select("id", F.timestamp_seconds("id").alias("ts"), F.lit("a").alias("event_type"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema.replace("user_id", "id")).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
        run = throttle.windowed_usage(stream, "1 day").writeStream.format("memory").queryName("watched").outputMode("complete").trigger(availableNow=True).start()
        assert run.awaitTermination(100)
        rows = []
        for _ in range(60):
            time.sleep(0.5)
            if (tmp_path / "progress").exists():
                rows = spark.read.schema(runs.PROGRESS).parquet(str(tmp_path / "progress")).filter("rows > 0").orderBy("batch").collect()
            if len(rows) == 2:
                break
    finally:
        spark.streams.removeListener(listener)
    assert [(r["query"], r["batch"]) for r in rows] == [("watched", 0), ("watched", 1)] and sorted(r["rows"] for r in rows) == [5, 7] and rows[1]["state_rows"] == 1
