"""Telemetry from Spark itself: what each micro-batch of a stream and each observed stage of a job took, as a table for the reports.

Rows are those that the latency reports read: request, stage, ms, start_ms, end_ms, ok, detail. They wait in memory up to a
stated number and are appended to a folder; a report reads the folder.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENTS = "request string, stage string, ms double, start_ms double, end_ms double, ok boolean, detail string"


class EventTable:
    """A folder of events; ``add`` from any thread, ``flush`` writes what waits."""

    def __init__(self, spark: SparkSession, path: str, waiting: int = 1000):
        self.spark, self.path, self.most = spark, path, waiting
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    def add(self, request: str, stage: str, ms: float, start_ms: float, ok: bool, detail: str = "") -> None:
        with self.lock:
            self.rows.append((request, stage, float(ms), float(start_ms), float(start_ms + ms), ok, detail))
            full = len(self.rows) >= self.most
        if full:
            self.flush()

    def flush(self) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(self.path)  # at most ``waiting`` rows and what came meanwhile

    def read(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(EVENTS).parquet(self.path)


class StreamEvents(StreamingQueryListener):
    """Every micro-batch as a request, with the phases that Spark times as its stages; a query that failed as a row that isn't ok."""

    def __init__(self, events: EventTable):
        self.events = events

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.events.add(str(event.runId), "start", 0.0, 0.0, True, event.name or "")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        request, at = f"{p.runId}:{p.batchId}", 0.0
        for stage, ms in sorted(p.durationMs.items()):
            if stage == "triggerExecution":
                self.events.add(request, "total", ms, 0.0, True, f"{p.numInputRows} rows")
            else:
                self.events.add(request, stage, ms, at, True)
                at += ms

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.events.add(str(event.runId), "terminated", 0.0, 0.0, event.exception is None, (event.exception or "")[:200])


class Observed:
    """Stages of one job: each runs an action, and what was observed of its rows goes with its time; a stage that raises is a row that isn't ok."""

    def __init__(self, events: EventTable, request: str | None = None):
        self.events, self.request, self.began = events, request or uuid.uuid4().hex, time.perf_counter()

    def run(self, stage: str, df: DataFrame, action: Callable[[DataFrame], object], *measures: Column) -> object:
        """What the action gives for the stage's rows; ``measures`` are aggregates of them, by default their number."""
        seen = Observation()
        watched = df.observe(seen, *(measures or (F.count(F.lit(1)).alias("rows"),)))
        start = time.perf_counter()
        try:
            out = action(watched)
        except Exception as e:
            self.events.add(self.request, stage, 1000 * (time.perf_counter() - start), 1000 * (start - self.began), False, type(e).__name__)
            raise
        detail = ", ".join(f"{k} {v}" for k, v in sorted(seen.get.items()))
        self.events.add(self.request, stage, 1000 * (time.perf_counter() - start), 1000 * (start - self.began), True, detail)
        return out
