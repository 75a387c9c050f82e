"""Text sources and sinks: id lists, timed caches, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest line of an event log that counts, and most lines of a tail.
MAX_LINE, MAX_TAIL = 16_384, 500


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """Distinct positive ids, one a line; other lines are skipped."""
    n = F.when(F.trim("value").rlike("^[0-9]+$"), F.trim("value").try_cast("long"))
    return spark.read.text(path).select(n.alias("id")).where("id > 0").distinct()


def append_new_ids(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Append the ids that the list does not have yet."""
    new = ids.join(id_lines(spark, path), "id", "left_anti").distinct()
    new.select(F.col("id").cast("string").alias("value")).write.mode("append").text(path)


def timed_cache(spark: SparkSession, path: str) -> DataFrame:
    """(id, at) of a tab-separated cache; at is a timestamp from epoch milliseconds. Bad lines are skipped."""
    raw = spark.read.schema("id STRING, ms STRING").csv(path, sep="\t")
    return raw.select(F.col("id").try_cast("long").alias("id"), F.timestamp_millis(F.col("ms").try_cast("long")).alias("at")).where("id IS NOT NULL AND at IS NOT NULL")


def log_tail(spark: SparkSession, path: str, schema: str, time: str, limit: int = 100) -> DataFrame:
    """The latest events of a JSON-lines log (1 to 500); lines that are too long or malformed are skipped."""
    lines = spark.read.text(path).where(F.octet_length("value") <= MAX_LINE)
    events = lines.select(F.from_json("value", schema).alias("e")).where("e IS NOT NULL").select("e.*").where(F.col(time).isNotNull())
    return events.orderBy(F.col(time).desc()).limit(max(1, min(MAX_TAIL, limit)))


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
