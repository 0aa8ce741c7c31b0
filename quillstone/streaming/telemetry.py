"""Telemetry as streams: event-time windows with watermark, deduplication, the last-n buffer; and their batch twins."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators.answers import Breaker

#: Event time must be TIMESTAMP for a watermark; the tables hold it without a zone.
EVENT_TIME = "ts"


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(EVENT_TIME, F.col(EVENT_TIME).cast("timestamp"))


def watermarked(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(EVENT_TIME, late)


def tumbling(events: DataFrame, size: str, group: str = "event_type", value: str = "value") -> DataFrame:
    return events.groupBy(group, F.window(EVENT_TIME, size).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(group, F.col("w.start").alias("window_start"), "n", "total")


def sliding(events: DataFrame, size: str, step: str, group: str = "event_type", value: str = "value") -> DataFrame:
    return events.groupBy(group, F.window(EVENT_TIME, size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(group, F.col("w.start").alias("window_start"), "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id") -> DataFrame:
    """For watermarked events: a repeated key is dropped within the watermark."""
    return events.dropDuplicatesWithinWatermark([key])


#: Typed state lives in this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def typed_state(spark: SparkSession) -> None:
    """Sets the session's state store to one that holds lists, maps and timers."""
    if spark.conf.get(STORE, "") != ROCKSDB:
        spark.conf.set(STORE, ROCKSDB)


class Ring(StatefulProcessor):
    """A key's last n values: a value lies in slot (how many came before it) % n, so a batch writes the slots that its own values take and no others.

    With ``idle_s``, a key that has had no rows for so long is forgotten.
    """

    def __init__(self, n: int, idle_s: float | None = None):
        self.n, self.idle_s = n, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot int", "value double")
        self.came = handle.getValueState("came", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        came = self.came.get()[0] if self.came.exists() else 0
        arrived = pd.concat([b[["at", "id", "value"]] for b in rows]).sort_values(["at", "id"])["value"].tolist()
        for k, value in enumerate(arrived):
            if len(arrived) - k <= self.n:
                self.slots.updateValue(((came + k) % self.n,), (value,))
        came += len(arrived)
        self.came.update((came,))
        if self.idle_s is not None:
            for timer in [*self.handle.listTimers()]:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle_s))
        values = [v[0] for v in self.slots.values()]
        yield pd.DataFrame({"key": [str(key[0])], "size": [len(values)], "mean": [sum(values) / len(values)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.slots.clear()
        self.came.clear()
        yield pd.DataFrame({"key": [str(key[0])], "size": [0], "mean": [0.0]})

    def close(self) -> None:
        pass


def last_n(events: DataFrame, key: str, n: int, at: str = EVENT_TIME, ident: str = "event_id", value: str = "value", idle_s: float | None = None) -> DataFrame:
    """A key's last n values as typed state: emits key, size and mean after each batch with rows of the key."""
    typed_state(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(ident).alias("id"), F.col(value).cast("double").alias("value"))
    mode = "None" if idle_s is None else "ProcessingTime"
    return rows.groupBy("key").transformWithStateInPandas(Ring(n, idle_s), "key string, size long, mean double", "Update", mode)


class AnchoredCap(StatefulProcessor):
    """The window's start and how many of its requests were allowed."""

    def __init__(self, cap: int, window_s: float, began: float | None):
        self.cap, self.window_s, self.began = cap, window_s, began

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        start, n = self.window.get() if self.window.exists() else (self.began, 0)
        # a batch's parts are rows of one key in no order; their ids and times are all that is held
        batch = pd.concat([b[["id", "at", "counts"]] for b in rows]).sort_values(["at", "id"])
        out = []
        for i, at, counts in zip(batch["id"].tolist(), batch["at"].tolist(), batch["counts"].tolist(), strict=True):
            if not counts:
                out.append((i, True))
                continue
            if start is None or at - start >= self.window_s:
                start, n = at, 0
            out.append((i, n < self.cap))
            n += n < self.cap
        if start is not None:
            self.window.update((start, n))
        yield pd.DataFrame(out, columns=["id", "allowed"])

    def close(self) -> None:
        pass


def anchored_cap(requests: DataFrame, cap: int, window_s: float = 86_400.0, key: str | None = None, began: float | None = None, counts: str | None = None) -> DataFrame:
    """Whether each request (id, at in seconds) is allowed: up to ``cap`` requests of a window are.

    The first window begins when the service did (``began``; without it, with the first request), any other with the first
    request after the last one's end. Requests for which the condition ``counts`` doesn't hold are allowed and not counted.
    State is kept for each key; without one there is a single window.
    """
    typed_state(requests.sparkSession)
    keyed = requests.select((F.col(key).cast("string") if key else F.lit("all")).alias("scope"), "id", "at", (F.coalesce(F.expr(counts), F.lit(False)) if counts else F.lit(True)).alias("counts"))
    return keyed.groupBy("scope").transformWithStateInPandas(AnchoredCap(cap, window_s, began), "id long, allowed boolean", "Append", "None")


def breaker(attempts: DataFrame, threshold: int, cooldown: float, profile: str) -> DataFrame:
    """The circuit of each provider after each attempt (id, provider, at in seconds, ok), its state carried from batch to batch."""
    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, opened = state.get if state.exists else (0, None)
        circuit = Breaker(threshold, cooldown, profile, failures, opened)
        rows = pd.concat([b[["id", "at", "ok"]] for b in batches]).sort_values(["at", "id"])
        out = []
        for i, at, ok in zip(rows["id"].tolist(), rows["at"].tolist(), rows["ok"].tolist(), strict=True):
            if circuit.state(at) == "open":
                out.append((i, k[0], "skipped", circuit.failures))
                continue
            circuit.record(bool(ok), at)
            out.append((i, k[0], circuit.state(at), circuit.failures))
        state.update((circuit.failures, circuit.opened))
        yield pd.DataFrame(out, columns=["id", "provider", "state", "failures"])

    return attempts.groupBy("provider").applyInPandasWithState(update, "id long, provider string, state string, failures long", "failures long, opened double", "append", "NoTimeout")


class Stages:
    """Stages of a request on the driver: start, end and whether each went well, also where one raises."""

    def __init__(self, request: str, clock=time.perf_counter):
        self.request, self.clock, self.began = request, clock, clock()
        self.rows: list[tuple[str, str, float, float, float, bool]] = []

    @contextmanager
    def stage(self, name: str):
        start, ok = self.clock(), False
        try:
            yield
            ok = True
        finally:
            end = self.clock()
            self.rows.append((self.request, name, round(1000 * (end - start), 3), 1000 * (start - self.began), 1000 * (end - self.began), ok))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "request string, stage string, ms double, start double, end double, ok boolean")
