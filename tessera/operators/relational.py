"""Joins, ranking and grouping shapes. Each takes DataFrames and column names and only declares a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides out by their key. Spark guesses a side's size from compressed files and takes an
    exploded array for one row, so that sides with a row a group or an episode would go through the driver to all executors."""
    return df.hint("merge")


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as the session has partitions for a shuffle. Left to itself Spark puts partitions
    together by their compressed bytes; rows of a few numbers shrink so far that a task would sort and count millions of them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _matched(left: DataFrame, right: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    keys = right.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())])
    return left.join(keys, reduce(Column.__and__, [F.col(x) == F.col(f"_k{i}") for i, x in enumerate(on)]), how)


def without(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` that no row of ``right`` matches (orphans); a null key matches nothing."""
    return _matched(left, right, on, "left_anti")


def having(left: DataFrame, right: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``left`` that some row of ``right`` matches."""
    return _matched(left, right, on, "left_semi")


def child_counts(parents: DataFrame, children: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """``parents`` with the number of their children, which are counted before the join."""
    counted = children.groupBy(*on.values()).agg(F.count("*").alias(name)).select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(on.values())], name)
    same = reduce(Column.__and__, [F.col(x) == F.col(f"_k{i}") for i, x in enumerate(on)])
    return parents.join(counted, same, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).select(*parents.columns, name)


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order. The row's rank is cut off at one before the exchange where Spark can."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def clear_winner(df: DataFrame, keys: list[str], score: str, tie: list[Column], margin: float, threshold: float | None = None) -> DataFrame:
    """The best row of each group, if it beats the next by ``margin`` or is alone; with a threshold, only a best row
    that reaches it counts, and a next row below it does no harm."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    ranked = df.withColumns({"_rank": F.row_number().over(w), "_next": F.lead(score).over(w)}).where("_rank = 1")
    wins = F.col("_next").isNull() | (F.col(score) - F.col("_next") >= margin)
    if threshold is not None:
        wins = (F.col(score) >= threshold) & (wins | (F.col("_next") < threshold))
    return ranked.where(wins).drop("_rank", "_next")


def search_any(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """Rows with the text, in either case, in one of the columns; ``%`` and ``_`` in it are wildcards."""
    return df.where(reduce(Column.__or__, [F.col(c).ilike(f"%{pattern}%") for c in columns]))


def ordered_text(key: Column, value: Column) -> Column:
    """Aggregate: the values in order of their keys, joined by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.cast("string").alias("v")))), lambda s: s["v"]), ",")


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """An undirected edge set: each edge in both directions, once."""
    return edges.select(a, b).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b))).distinct()


def missing_numbers(numbers: Column, last: Column) -> Column:
    """Of 1..last those that the array lacks; none if ``last`` is below 1."""
    return F.when(last >= 1, F.array_except(F.sequence(F.lit(1), last), numbers)).otherwise(F.array().cast("array<int>"))


def extra_numbers(numbers: Column, last: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n < 1) | (n > last))))
