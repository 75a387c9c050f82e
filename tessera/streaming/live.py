"""Streams with keyed state: requests in flight, back-offs after failures, and the latest sign of each key with a time to live.

Each has a batch form with the same result, whatever the micro-batches; state is bounded for each key and survives restarts
through the checkpoint. Rows of a key must arrive in order from batch to batch; within a batch they are put in order here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from .microbatch import spaced

#: Outcomes of a window, share of failures at which a back-off begins, batches that it lasts.
WINDOW, SHARE, HOLD = 20, 0.25, 10
#: Keys are dealt into so many buckets, each with one state: a state of its own for each key costs several calls a key and batch.
#: A checkpoint serves as long as this number stays as it is.
BUCKETS = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams start with the state store that keyed state needs: state beyond memory lies on disk."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _InFlight(StatefulProcessor):
    """State of a bucket: when each of its requests in flight began, in microseconds, and a timer at which all are over."""

    def __init__(self, time: str, lasts: int) -> None:
        self.time, self.lasts = time, lasts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("begun", "flights STRING, due BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        text, before = self.state.get() if self.state.exists() else ("{}", None)
        flights, takes = json.loads(text), []
        frame = pd.concat(list(rows)).sort_values("own_micros")
        for own, at in zip(frame["own_key"].tolist(), frame["own_micros"].tolist(), strict=True):
            begun = flights.get(own)
            takes.append(begun is None or at >= begun + self.lasts)
            if takes[-1]:
                flights[own] = at
        due = (max(flights.values()) + self.lasts) // 1000 + 1
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        over = timerValues.getCurrentWatermarkInMs() * 1000 - self.lasts
        self.state.update((json.dumps({own: begun for own, begun in flights.items() if begun > over}), due))
        if any(takes):
            yield frame.loc[takes].drop(columns=["own_micros", "own_key", "own_bucket"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def in_flight(requests: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Of a stream of requests, those that begin a flight: a row of a key less than ``seconds`` after the row that began the
    key's flight is a repeat and dropped, in later batches and after restarts too.

    The watermark follows the latest row by ``seconds``: a flight is forgotten once it passes its end, so state holds the
    keys in flight only, and Spark may drop rows behind it. Start the stream within ``keyed_state``. (Dropping duplicates
    within the watermark would also drop the next flight's first row wherever the watermark hasn't moved on yet.)
    """
    own = requests.where(F.col(time).isNotNull()).withWatermark(time, f"{seconds} seconds").withColumns({"own_micros": F.unix_micros(time), "own_key": _key(keys), "own_bucket": _bucket(keys)})
    return own.groupBy("own_bucket").transformWithStateInPandas(_InFlight(time, seconds * 1_000_000), _kinds(requests, requests.columns), "Append", "EventTime")


def flights(requests: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """The batch form of ``in_flight``."""
    return spaced(requests.withColumn("_micros", F.unix_micros(time)), keys, "_micros", seconds * 1_000_000).drop("_micros")


class _BackOffs(StatefulProcessor):
    """State of a bucket: of each key its last outcomes as text (1 is a failure), and the batch in which its last back-off began."""

    def __init__(self, names: list[str], order: list[str], batch: str, failed: str, size: int, share: float, hold: int) -> None:
        self.names, self.order, self.batch, self.failed, self.size, self.share, self.hold = names, order, batch, failed, size, share, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", "windows STRING")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        windows = json.loads(self.state.get()[0]) if self.state.exists() else {}
        places, found = [], []
        frame = pd.concat(list(rows)).sort_values(self.order)
        for i, (own, batch, failed) in enumerate(zip(*(frame[c].tolist() for c in ("own_key", self.batch, self.failed)), strict=True)):
            outcomes, begun = windows.get(own, ("", None))
            outcomes = (outcomes + ("1" if failed else "0"))[-self.size :]
            if failed and outcomes.count("1") >= self.share * len(outcomes) and (begun is None or batch >= begun + self.hold):
                begun = int(batch)
                places.append(i)
                found.append(begun)
            windows[own] = (outcomes, begun)
        self.state.update((json.dumps(windows),))
        if found:
            yield frame[self.names].iloc[places].assign(**{self.batch: found})

    def close(self) -> None:
        pass


def run_to_end(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now; each batch's rows are a folder below ``path`` that a batch that runs again
    replaces. Returns what all batches so far gave out."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with keyed_state(result.sparkSession):
        stream = result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return result.sparkSession.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(path)


def _key(keys: list[str]) -> Column:
    """One text for the keys of a row: a state's key can't hold nulls."""
    return F.to_json(F.struct(*keys))


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(_key(keys)), F.lit(BUCKETS)).cast("int")


def _kinds(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def live_back_offs(outcomes: DataFrame, keys: list[str], order: list[str], batch: str, failed: str, size: int = WINDOW, share: float = SHARE, hold: int = HOLD) -> DataFrame:
    """(keys, batch) in which a back-off begins, of a stream of outcomes: a failing row ends a window of the key's last
    ``size`` outcomes of which at least ``share`` failed, and no back-off has begun in the last ``hold`` batches.

    Start the stream within ``keyed_state``. The batch form is ``failure_windows`` and ``back_offs``.
    """
    used = outcomes.select(*dict.fromkeys([*keys, *order, batch, failed]))
    processor = _BackOffs(keys, order, batch, failed, size, share, hold)
    return used.withColumns({"own_key": _key(keys), "own_bucket": _bucket(keys)}).groupBy("own_bucket").transformWithStateInPandas(processor, f"{_kinds(outcomes, keys)}, `{batch}` BIGINT", "Append", "None")


class _Latest(StatefulProcessor):
    """State of a key: its latest stamp in microseconds, until a timer says that it is past its time to live."""

    def __init__(self, names: list[str], time: str, ttl_seconds: int) -> None:
        self.names, self.time, self.ttl = names, time, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("latest", "at BIGINT")

    def _due(self, at: int) -> int:
        return at // 1000 + self.ttl * 1000

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        best, before = int(frame[self.time].max()), self.state.get()[0] if self.state.exists() else None
        if before is None or best > before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(best))
            self.state.update((best,))
            yield frame[self.names].head(1).assign(**{self.time: best})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def live_latest(signs: DataFrame, keys: list[str], time: str, ttl_seconds: int, now: Column | None = None) -> DataFrame:
    """(keys, time in microseconds) of a stream, whenever a key's latest stamp that is neither in the future nor older than
    the time to live grows.

    ``now`` is the batch's own time unless it is given. Start the stream within ``keyed_state``; a reader takes each key's
    greatest stamp and leaves out those past the time to live. The watermark follows the latest stamp by the time to live:
    rows behind it can't be alive, and a key is forgotten when it is a time to live past the key's stamp. The batch form
    is ``latest_alive``.
    """
    own = F.col(time).cast("timestamp")
    clock = F.unix_micros((F.current_timestamp() if now is None else now).cast("timestamp"))
    at = F.unix_micros(own)
    alive = signs.where((at <= clock) & (at > clock - ttl_seconds * 1_000_000)).select(*keys, own.alias("_at"), _key(keys).alias("_key")).withWatermark("_at", f"{ttl_seconds} seconds")
    rows = alive.withColumn(time, F.unix_micros("_at")).groupBy("_key")
    return rows.transformWithStateInPandas(_Latest(keys, time, ttl_seconds), f"{_kinds(signs, keys)}, `{time}` BIGINT", "Update", "EventTime")
