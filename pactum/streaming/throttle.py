"""Keyed throttles and budgets with state, over streams or by replay of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

DECISION = "key string, at long, ok boolean, allowed boolean, left_over long"


def decide(at: int, ok: bool, kept: list[int], limit: int, window: int, login: bool = False) -> tuple[bool, list[int]]:
    """One request against the counted ones: a rejected request uses no quota. ``login``: only
    failures count, and a success clears them. A limit of 0 is none; nothing is counted."""
    if limit <= 0:
        return True, []
    kept = [t for t in kept if at - t < window]
    if len(kept) >= limit:
        return False, kept
    return True, [] if login and ok else [*kept, at]


def replay(requests: DataFrame, limit: int, window: int, login: bool = False) -> DataFrame:
    """Decisions over a finished table (key, at seconds, ok): the batch twin of ``stream``.

    Spark sorts each partition by key and time; a task then holds the counted times of
    one key, at most ``limit``, however many requests the key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept, first = None, [], True
        for pdf in batches:
            out = []
            for key, at, ok in zip(pdf["key"], pdf["at"], pdf["ok"], strict=True):
                if first or key != last:
                    last, kept, first = key, [], False
                allowed, kept = decide(at, ok, kept, limit, window, login)
                out.append((allowed, max(0, limit - len(kept)) if limit > 0 else -1))
            yield pdf.assign(allowed=[a for a, _ in out], left_over=[n for _, n in out])

    ordered = requests.select("key", "at", "ok").repartition("key").sortWithinPartitions("key", "at", "ok")
    return ordered.mapInPandas(run, DECISION)


class Throttle(StatefulProcessor):
    """Counted times of a key as a list state. A timer in event time sweeps what the window has
    passed, so a key that falls silent leaves nothing behind."""

    def __init__(self, limit: int, window: int, login: bool = False):
        self.limit, self.window, self.login = limit, window, login

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", StructType([StructField("at", LongType())]))

    def _keep(self, kept: list[int]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.kept.put([(int(t),) for t in kept])
            self.handle.registerTimer(1000 * (min(kept) + self.window))
        else:
            self.kept.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "ok"])
        kept, out = [r[0] for r in self.kept.get()], []
        for at, ok in zip(pdf["at"], pdf["ok"], strict=True):
            allowed, kept = decide(at, ok, kept, self.limit, self.window, self.login)
            out.append((key[0], at, ok, allowed, max(0, self.limit - len(kept)) if self.limit > 0 else -1))
        self._keep(kept)
        yield pd.DataFrame(out, columns=["key", "at", "ok", "allowed", "left_over"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self._keep([r[0] for r in self.kept.get() if 1000 * (r[0] + self.window) > now])
        yield pd.DataFrame({"key": [], "at": [], "ok": [], "allowed": [], "left_over": []}).astype({"key": str, "at": "int64", "ok": bool, "allowed": bool, "left_over": "int64"})

    def close(self) -> None:
        pass


def stream(requests: DataFrame, limit: int, window: int, login: bool = False, late: str = "1 hour") -> DataFrame:
    """Decisions over a stream (key, at seconds, ok). Time is ``at``: requests that come over
    ``late`` behind the latest one are dropped by the watermark, and state ends when the
    watermark has passed the window. Needs the RocksDB state store."""
    timed = requests.select("key", "at", "ok", F.timestamp_seconds("at").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("key").transformWithStateInPandas(Throttle(limit, window, login), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")


def denied_once(denials: DataFrame, window: str) -> DataFrame:
    """At most one audit entry a key and window of denied requests; ``ts`` is event time."""
    return denials.withWatermark("ts", window).dropDuplicatesWithinWatermark(["key"])


def windowed_usage(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Event counts and value sums in tumbling or sliding windows (an extension). ``ts`` must be
    a TIMESTAMP; ``late`` sets the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def session_usage(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a user by inactivity gap (an extension)."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class Budget(StatefulProcessor):
    """Running totals of a run's model calls; once a cap is reached every later call is refused
    and the first reason stays. A run without calls for ``idle`` milliseconds is forgotten."""

    def __init__(self, max_calls: int, max_cost: float, max_failures: int, idle: int):
        self.caps, self.idle = (max_calls, max_cost, max_failures), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", "calls long, cost double, failures long, reason string", self.idle)

    def handleInputRows(self, key, rows, timerValues):
        calls, cost, failures, reason = self.state.get() if self.state.exists() else (0, 0.0, 0, "")
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            if not reason:
                reason = "calls" if calls >= self.caps[0] else "cost" if cost >= self.caps[1] else "failures" if failures >= self.caps[2] else ""
            out.append((key[0], int(r.seq), not reason, reason))
            if not reason:
                calls, cost, failures = calls + 1, cost + (r.cost if r.ok else 0.0), 0 if r.ok else failures + 1
        self.state.update((calls, cost, failures, reason))
        yield pd.DataFrame(out, columns=["key", "seq", "allowed", "reason"])

    def close(self) -> None:
        pass


def budget_stream(calls: DataFrame, max_calls: int, max_cost: float, max_failures: int, idle_hours: int = 24) -> DataFrame:
    """(key, seq, allowed, reason) of a stream (key, seq, at, ok, cost). Totals of a run live until
    it has been idle for ``idle_hours`` of processing time. Such state keeps a query awake:
    run it by a processing-time trigger, not until the input ends."""
    budget = Budget(max_calls, max_cost, max_failures, idle_hours * 3_600_000)
    return calls.groupBy("key").transformWithStateInPandas(budget, outputStructType="key string, seq long, allowed boolean, reason string", outputMode="Append", timeMode="ProcessingTime")
