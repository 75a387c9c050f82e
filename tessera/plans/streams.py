"""Registered queries that run as streams: the events in several micro-batches, with the SQL of the batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import shared
from tessera.streaming import live

from .catalogue import oracle_sql, query, table

SLICES = 3


def _streamed(rows: DataFrame, time: str, make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What ``make(stream)`` gives out over ``rows`` in SLICES micro-batches in order of ``time``.

    A slice is written by all tasks, then the stream goes on from its checkpoint and takes the slice's files as one batch.
    """
    spark = rows.sparkSession
    source, result, progress = (shared.new_folder(spark, name) for name in ("source", "result", "progress"))
    ends = [float("-inf"), *rows.select(F.unix_micros(F.col(time).cast("timestamp")).cast("double").alias("t")).approxQuantile("t", [i / SLICES for i in range(1, SLICES)], 0.01), float("inf")]
    at = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    for low, high in zip(ends, ends[1:], strict=False):
        rows.where((at > low) & (at <= high)).write.mode("append").parquet(source)
        out = live.run_to_end(make(spark.readStream.schema(rows.schema).parquet(source)), result, progress, mode)
    return out


@query("live_back_offs", oracle_sql()["back_offs"])
def live_back_offs(spark: SparkSession, d: str) -> DataFrame:
    order = ["ts", "event_id"]
    batch = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1) / 4)
    rows = table(spark, d, "events").select("user_id", *order, batch.alias("batch"), (F.col("event_type") == "error").alias("failed"))
    return _streamed(shared.staged(rows, "outcomes"), "ts", lambda s: live.live_back_offs(s, ["user_id"], order, "batch", "failed"))


@query("live_latest", oracle_sql()["latest_ttl"])
def live_latest(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "ts")
    now = F.lit(events.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0])
    found = _streamed(events, "ts", lambda s: live.live_latest(s, ["user_id"], "ts", 7 * 24 * 3600, now), "update")
    return found.groupBy("user_id").agg(F.max("ts").alias("at_us"))


@query("in_flight", "SELECT event_id, user_id FROM events")
def in_flight(spark: SparkSession, d: str) -> DataFrame:
    """Every third request comes again after half a minute, every fifth after a minute as well."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    again = [e.where(F.col("event_id") % n == 0).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {s} SECONDS")) for n, s in ((3, 30), (5, 60))]
    requests = e.unionByName(again[0]).unionByName(again[1])
    return _streamed(requests, "ts", lambda s: live.in_flight(s, ["event_id"], "ts", 120).select("event_id", "user_id"))
