"""Upserts as functions of (target, source), both with one row a key. They return new DataFrames and change nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    t = target.select(F.struct(*target.columns).alias("t"), *[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)])
    s = source.select(F.struct(*target.columns).alias("s"), *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)])
    return t.join(s, reduce(Column.__and__, [F.col(f"_t{i}") == F.col(f"_s{i}") for i in range(len(keys))]), "full")


def _take(joined: DataFrame, columns: list[str], rules: dict[str, Column], default: str) -> DataFrame:
    """Rows on one side only are kept; of matched rows each column follows its rule, or the default side."""
    one = F.col("s").isNull() | F.col("t").isNull()
    return joined.select(*[F.when(one, F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}"))).otherwise(rules.get(c, F.col(f"{default}.{c}"))).alias(c) for c in columns])


def overwrite(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return _take(_both(target, source, keys), target.columns, {}, "s")


def fill_nulls(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target's values stay; its nulls are filled."""
    rules = {c: F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")) for c in target.columns}
    return _take(_both(target, source, keys), target.columns, rules, "t")


def keep_provenance(target: DataFrame, source: DataFrame, keys: list[str], origin: str, confidence: str, protected: tuple[str, ...]) -> DataFrame:
    """Rows of a protected origin keep all but the confidence; the confidence is the greater one."""
    strong = F.col(f"t.{origin}").isin(*protected)
    rules = {c: F.when(strong, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")) for c in target.columns}
    rules[confidence] = F.greatest(F.col(f"t.{confidence}"), F.col(f"s.{confidence}"))
    return _take(_both(target, source, keys), target.columns, rules, "s")


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti").select(*target.columns))


def guarded(target: DataFrame, source: DataFrame, keys: list[str], owner: str) -> tuple[DataFrame, DataFrame]:
    """(merged, rejects): a row of the source that another owner's row holds already is rejected."""
    held = target.select(*keys, F.col(owner).alias("_held"))
    foreign = source.join(held, keys).where(F.col(owner) != F.col("_held")).select(*source.columns)
    accepted = source.join(foreign.select(*keys), keys, "left_anti")
    return overwrite(target, accepted, keys), foreign


def promote(rows: DataFrame, group: list[str], primary: str, chosen: DataFrame, key: str) -> DataFrame:
    """In each group that ``chosen`` (group, key) names, its row becomes the only primary one."""
    picks = chosen.select(*group, F.col(key).alias("_pick"))
    return rows.join(picks, group, "left").withColumn(primary, F.when(F.col("_pick").isNull(), F.col(primary)).otherwise(F.col(key) == F.col("_pick"))).select(*rows.columns)


def replace_groups(target: DataFrame, source: DataFrame, group: list[str]) -> DataFrame:
    """Snapshot replacement: groups that the source has are taken whole from it, others stay."""
    return target.join(source.select(*group).distinct(), group, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def stamped(target: DataFrame, source: DataFrame, keys: list[str], stamp: str, now: Column) -> DataFrame:
    """Overwrite, with the time of the write in the ``stamp`` column of every row that the source has."""
    return overwrite(target, source.withColumn(stamp, now), keys)


def unless_overridden(target: DataFrame, source: DataFrame, keys: list[str], override: str) -> DataFrame:
    """The source's rows go over the target's, but for those that are marked as set by hand."""
    by_hand = F.coalesce(F.col(f"t.{override}"), F.lit(False))
    return _take(_both(target, source, keys), target.columns, {c: F.when(by_hand, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")) for c in target.columns}, "s")


def fill_from(target: DataFrame, sources: list[DataFrame], keys: list[str], column: str) -> DataFrame:
    """Nulls and blanks of ``column`` are filled from the first source (keys, column) that has a text for the row; rows are neither added nor lost."""
    out = target
    for i, source in enumerate(sources):
        given = source.where(F.trim(column) != "").groupBy(*keys).agg(F.min(column).alias(f"_f{i}"))
        out = out.join(given, keys, "left")
    own = F.when(F.trim(column) != "", F.col(column))
    return out.withColumn(column, F.coalesce(own, *[F.col(f"_f{i}") for i in range(len(sources))], F.col(column))).select(*target.columns)


def resolved(children: DataFrame, dimension: DataFrame, external: str, name: str) -> DataFrame:
    """``children`` with ``id``: the dimension's row (id, external, name) with the same external id, else with the same name in any case; null for neither."""
    by_external = dimension.where(F.col(external).isNotNull()).groupBy(F.col(external).alias("_e")).agg(F.min("id").alias("_by_e"))
    by_name = dimension.groupBy(F.lower(F.trim(name)).alias("_n")).agg(F.min("id").alias("_by_n"))
    joined = children.join(by_external, F.col(external) == F.col("_e"), "left").join(by_name, F.lower(F.trim(name)) == F.col("_n"), "left")
    return joined.select(*[children[c] for c in children.columns], F.coalesce("_by_e", "_by_n").alias("id"))


def linked(edges: DataFrame, new: DataFrame, nodes: DataFrame, ends: tuple[str, str], node: str) -> DataFrame:
    """``edges`` and those of ``new`` whose ends are both nodes and that aren't there yet."""
    known = new
    for end in ends:
        known = known.join(nodes.select(F.col(node).alias(end)).distinct(), end, "left_semi")
    return insert_absent(edges, known.select(*edges.columns).dropDuplicates(list(ends)), list(ends))
