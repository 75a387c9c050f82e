"""Row-level reads, and aggregates over them: lists, lookups, optional filters, histograms, null counts, folds of repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a list if no number is asked for, and at most.
DEFAULT_ROWS, MOST_ROWS = 50, 100


def row_limit(text: str | None) -> int:
    """The number of rows that a request's text asks for."""
    value = (text or "").strip()
    return min(int(value), MOST_ROWS) if value.isascii() and value.isdigit() and int(value) > 0 else DEFAULT_ROWS


def listed(df: DataFrame, order: list[str], limit: str | None = None) -> DataFrame:
    """The first rows in a total order."""
    return df.orderBy(*order).limit(row_limit(limit))


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def filtered(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that meet all given filters; a filter of None isn't given, a list asks for any of its values."""
    given = [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(Column.__and__, given)) if given else df


def fan_out(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """``parents`` with an ordered array of structs for each child table: name -> (rows, its key column, order). Each child is grouped
    by itself, so that none multiplies another."""
    out = parents
    for name, (rows, own, order) in children.items():
        columns = [*order, *[c for c in rows.columns if c not in order and c != own]]
        grouped = rows.groupBy(F.col(own).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(grouped, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def histogram(df: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    """(value, groups, rows): how many rows have each value, and their weights' sum."""
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("groups"), F.sum(F.lit(1) if weight is None else weight).cast("long").alias("rows"))


def null_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, given, missing); an empty text is missing."""
    counters = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias("given"), F.count("*").alias("n")) for c in columns]
    return df.agg(F.array(*counters).alias("a")).select(F.inline("a")).select("column", "given", (F.col("n") - F.col("given")).alias("missing"))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """(severity, codes, rows, failing): of findings (code, severity, n)."""
    return findings.groupBy("severity").agg(F.countDistinct("code").alias("codes"), F.sum("n").cast("long").alias("rows"), F.count_if(F.col("n") > 0).alias("failing"))


def fold_repeats(rows: DataFrame, keys: list[str], name: str, position: str, first: list[str], any_: list[str], least: list[str]) -> DataFrame:
    """One row for each name within ``keys``, whatever its case: the first spelling, the first non-null of ``first``, whether any is true of ``any_`` and the least of ``least``."""
    clean = rows.withColumn(name, F.trim(name)).where(F.col(name) != "")
    return clean.groupBy(*keys, F.lower(name).alias("_name")).agg(
        F.min_by(name, position).alias(name), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in first],
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in any_], *[F.min(c).alias(c) for c in least],
    ).drop("_name")


def unambiguous(rows: DataFrame, keys: list[str], number: str, identity: str) -> DataFrame:
    """One row for each number that rows of a single identity claim; numbers below 1 and claimed by several are left out."""
    same = rows.where(F.col(number) > 0).groupBy(*keys, number).agg(F.min(identity).alias(identity), F.max(identity).alias("_other"))
    return same.where(F.col(identity).eqNullSafe(F.col("_other"))).drop("_other")


def ordered_children(bridge: DataFrame, dimension: DataFrame, parent: str, key: str, rank: str, name: str) -> DataFrame:
    """(parent, children): of each parent the dimension's names by ascending rank, those without a rank last, then by name.

    ``bridge``: parent, key, rank; ``dimension`` (key, name) is broadcast by Spark while it is small.
    """
    own = bridge.join(dimension.select(key, name), key)
    order = F.struct(F.col(rank).isNull().alias("last"), F.col(rank).alias("rank"), F.col(name).alias("name"))
    return own.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"]).alias("children"))


def progress(done: Column, total: Column, seconds: Column) -> list[Column]:
    """remaining, percent, per_minute, eta_seconds of a run: 0 percent of nothing and 100 at most, 0 a minute before any
    time has passed, and no estimate without a rate."""
    left = F.greatest(total - done, F.lit(0))
    percent = F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(100.0 * done / total + 0.5)))).otherwise(0)
    rate = F.when(seconds > 0, done / (seconds * 1000) * 60_000).otherwise(0.0)
    return [left.alias("remaining"), percent.cast("int").alias("percent"), rate.cast("double").alias("per_minute"), F.when(rate > 0, F.ceil(left / rate * 60)).cast("long").alias("eta_seconds")]
