"""Shape checks: what a catalogue has against what it should have, and what it should have no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE, LEGACY, COLUMN, INDEX = "table", "legacy-table", "column", "index"


def exists(spark: SparkSession, name: str) -> bool:
    """Is there a table or view of this name?"""
    return spark.catalog.tableExists(name)


def catalogue(spark: SparkSession, prefix: str = "", database: str | None = None) -> DataFrame:
    """(kind, table, name) of the tables, views, columns and partition or bucket columns of a session's catalogue.

    Partition and bucket columns stand for indexes: they are what a lookup can be narrowed by. Names come without
    ``prefix``; those that don't begin with it are left out.
    """
    rows = []
    for t in spark.catalog.listTables(database):
        if not t.name.startswith(prefix):
            continue
        own = t.name.removeprefix(prefix)
        rows.append((TABLE, own, own))
        for c in spark.catalog.listColumns(t.name, database):
            rows.append((COLUMN, own, c.name))
            if c.isPartition or c.isBucket:
                rows.append((INDEX, own, c.name))
    return spark.createDataFrame(rows, "kind STRING, table STRING, name STRING")


def wanted_shape(spark: SparkSession, tables: dict[str, list[str]], legacy: list[str] = (), indexes: dict[str, list[str]] | None = None) -> DataFrame:
    """The same columns for what should be there: tables with their columns, indexes, and legacy tables that shouldn't."""
    rows = [(TABLE, t, t) for t in tables] + [(COLUMN, t, c) for t, columns in tables.items() for c in columns]
    rows += [(LEGACY, t, t) for t in legacy] + [(INDEX, t, c) for t, columns in (indexes or {}).items() for c in columns]
    return spark.createDataFrame(rows, "kind STRING, table STRING, name STRING")


def shape_report(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, table, name, state, ok): present or missing for what is wanted, absent or still-present for legacy tables, and
    extra for columns and tables that nobody asked for, which are no fault. Names count in lower case."""
    low = lambda df: df.select("kind", F.lower("table").alias("table"), F.lower("name").alias("name")).distinct()
    there, asked = low(have), low(wanted)
    # A legacy table is looked for among tables.
    keyed = asked.withColumn("_kind", F.when(F.col("kind") == LEGACY, TABLE).otherwise(F.col("kind")))
    found = there.select(F.col("kind").alias("_kind"), F.col("table"), F.col("name"), F.lit(True).alias("_there"))
    joined = keyed.join(found, ["_kind", "table", "name"], "full")
    legacy, here = F.col("kind") == LEGACY, F.col("_there").isNotNull()
    state = F.when(F.col("kind").isNull(), "extra").when(legacy & here, "still-present").when(legacy, "absent").when(here, "present").otherwise("missing")
    return joined.select(F.coalesce("kind", "_kind").alias("kind"), "table", "name", state.alias("state"), (~state.isin("missing", "still-present")).alias("ok"))


def verdict(report: DataFrame) -> DataFrame:
    """(ok, present, missing, legacy, extra) of a report; an empty one is in order."""
    n = lambda s: F.count_if(F.col("state") == s)
    return report.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"), n("present").alias("present"), n("missing").alias("missing"), n("still-present").alias("legacy"), n("extra").alias("extra"))
