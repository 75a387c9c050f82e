"""Incremental forms: latest value with a time to live, failure windows, and keyed state kept by micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest_alive(rows: DataFrame, keys: list[str], time: str, now: Column, ttl: Column) -> DataFrame:
    """(keys, time) of the latest row of each key that isn't in the future and not older than the time to live."""
    return rows.where(F.col(time) <= now).groupBy(*keys).agg(F.max(time).alias(time)).where(F.col(time) > now - ttl)


def failure_windows(rows: DataFrame, keys: list[str], order: list[Column], failed: Column, size: int = 20, share: float = 0.25) -> DataFrame:
    """Rows with ``over``: a failing row that ends a window of up to ``size`` rows of which at least ``share`` failed."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(size - 1), 0)
    return rows.withColumn("over", failed & (F.sum(failed.cast("int")).over(w) >= share * F.count("*").over(w)))


def spaced(rows: DataFrame, keys: list[str], at: str, apart: int) -> DataFrame:
    """Of each key the row with the least number ``at``, then the next row at least ``apart`` behind the last one taken.

    Rows of a key are gone through in order; a task holds the last one taken only, however many rows a key has.
    """
    own = [rows.columns.index(k) for k in keys]
    place = rows.columns.index(at)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun = None, 0
        for f in frames:
            takes = []
            for row in zip(*(f.iloc[:, i] for i in own), f.iloc[:, place], strict=True):
                key, n = [None if v != v else v for v in row[:-1]], row[-1]  # null keys are one key
                takes.append(key != last or n >= begun + apart)
                if takes[-1]:
                    last, begun = key, n
            yield f[takes]

    ordered = rows.where(F.col(at).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, at)
    return ordered.mapInPandas(run, ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes))


def back_offs(rows: DataFrame, keys: list[str], batch: str, hold: int = 10) -> DataFrame:
    """(keys, batch) in which a back-off begins: the first batch with a row that is ``over``, then the first such batch
    after ``hold`` batches have passed."""
    return spaced(rows.where("over").select(*keys, F.col(batch).cast("bigint").alias(batch)).distinct(), keys, batch, hold)


def safe_progress(rows: DataFrame, position: str, failed: Column) -> DataFrame:
    """(safe): the position before the first failure; the last position if none failed."""
    a = rows.agg(F.min(F.when(failed, F.col(position))).alias("f"), F.max(position).alias("l"))
    return a.select(F.coalesce(F.col("f") - 1, F.col("l")).alias("safe"))


def maintain(
    stream: DataFrame, path: str, checkpoint: str, empty: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], keep: int = 2
) -> StreamingQuery:
    """Keep ``merge(state, batch)`` as a table of numbered versions under ``path``.

    A version is named for its batch and written whole before the next one reads it, so a batch that runs again after a
    failure overwrites its own version from the one before: results are exact. Versions older than the last ``keep``
    are removed. ``merge`` is the batch form of the operator.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(empty.schema).parquet(f"{path}/version={number - 1}") if number else empty
        merge(before, batch).write.mode("overwrite").parquet(f"{path}/version={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={number - keep}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
