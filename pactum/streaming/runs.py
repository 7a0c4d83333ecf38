"""Runs as streams: orphans found by a timer, and the progress of a query as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

ORPHAN = "run_id string, heartbeat_at long, found_at long"
OPEN = ("PENDING", "RUNNING")


class Heartbeats(StatefulProcessor):
    """The latest heartbeat of an unfinished run. Each one puts off a timer; when the timer
    expires, nothing has been heard for ``stale`` seconds and the run is an orphan. A run that
    ends or is cancelled leaves no state."""

    def __init__(self, stale: int):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def _clear(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["at", "open"], ascending=[True, False])
        before = self.last.get()[0] if self.last.exists() else None
        latest = pdf.iloc[-1]
        self._clear()
        # A heartbeat that comes late does not wake a run; an end always ends it.
        if not pdf["open"].all():
            ended = pdf.loc[~pdf["open"], "at"].max()
            if latest["open"] and latest["at"] > ended:
                before = None
            else:
                self.last.clear()
                return
        at = max(int(latest["at"]), before if before is not None else int(latest["at"]))
        self.last.update((at,))
        self.handle.registerTimer(1000 * (at + self.stale) + 1)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({"run_id": [key[0]], "heartbeat_at": [at], "found_at": [expiredTimerInfo.getExpiryTimeInMs() // 1000]})

    def close(self) -> None:
        pass


def orphan_stream(beats: DataFrame, stale: int, late: str = "1 minute") -> DataFrame:
    """(run_id, heartbeat_at, found_at) for each run of a stream (run_id, at seconds, status, cancelled)
    that stays unfinished without a heartbeat for more than ``stale`` seconds of event time;
    a run that is heard of again may be found again. The batch twin is
    ``portfolio.orphans``. Needs the RocksDB state store."""
    going = F.col("status").isin(*OPEN) & ~F.coalesce("cancelled", F.lit(False))
    timed = beats.select("run_id", "at", going.alias("open"), F.timestamp_seconds("at").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("run_id").transformWithStateInPandas(Heartbeats(stale), outputStructType=ORPHAN, outputMode="Append", timeMode="EventTime")


PROGRESS = "query string, run_id string, batch long, at string, rows long, rows_per_second double, state_rows long, watermark string, duration_ms long"


class ProgressTable(StreamingQueryListener):
    """Appends a row for each micro-batch of the session's queries to a table at ``path``, and one
    with ``batch`` -1 where a query fails, so that progress is read as any other table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self._append(p.name or str(p.id), str(p.runId), p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond), state, p.eventTime.get("watermark"), p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._append(str(event.id), str(event.runId), -1, None, 0, 0.0, 0, event.exception[:500], 0)
