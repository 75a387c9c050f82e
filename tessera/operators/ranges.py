"""Integer ranges: validation, mapping, overlap, islands, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import range_label

from .classify import first_reason


#: Why a pair of ranges isn't a mapping, in the order in which it is looked for.
SEGMENT_FAULTS = ("non-integer", "non-positive-start", "reversed-provider-range", "reversed-local-range", "unequal-span")


def segment_fault(ps: Column, pe: Column, ls: Column, le: Column) -> Column:
    """Why a pair of ranges isn't a mapping, or null."""
    whole = reduce(Column.__and__, [F.coalesce(x.cast("double") == F.floor(x.cast("double")), F.lit(False)) for x in (ps, pe, ls, le)])
    return first_reason(*zip(SEGMENT_FAULTS, (~whole, (ps <= 0) | (ls <= 0), pe < ps, le < ls, (pe - ps) != (le - ls)), strict=True))


def to_local(n: Column, ps: Column, pe: Column, ls: Column, le: Column) -> Column:
    """A provider's number as a local one; null outside the segment or if that is faulty."""
    return F.when(segment_fault(ps, pe, ls, le).isNull() & n.between(ps, pe), ls + (n - ps))


def to_provider(n: Column, ps: Column, pe: Column, ls: Column, le: Column) -> Column:
    """A local number as the provider's; null outside the segment or if that is faulty."""
    return F.when(segment_fault(ps, pe, ls, le).isNull() & n.between(ls, le), ps + (n - ls))


def ranges_meet(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


#: Segments up to which they are broadcast (some 40 bytes each).
BROADCAST_SEGMENTS = 500_000
#: Numbers of a range bucket: above BROADCAST_SEGMENTS, points and segments meet by key and bucket.
BUCKET = 64


def _by_range(points: DataFrame, segments: DataFrame, keys: list[str], number: str, fits: Column, how: str) -> DataFrame:
    """Join points and segments by keys and a range condition. Few segments are broadcast; many are dealt by key and range of
    numbers, so that a frequent key doesn't end in one task."""
    same = reduce(Column.__and__, [points[k] == segments[k] for k in keys])
    if segments.limit(BROADCAST_SEGMENTS + 1).count() <= BROADCAST_SEGMENTS:
        return points.join(F.broadcast(segments), same & fits, how)
    dealt = points.withColumn("_bucket", F.floor(F.col(number) / BUCKET))
    cut = segments.withColumn("_part", F.explode(F.sequence(F.floor(F.col("ps") / BUCKET), F.floor(F.col("pe") / BUCKET))))
    return dealt.join(cut, same & fits & (F.col("_bucket") == F.col("_part")), how).drop("_bucket", "_part")


def map_points(points: DataFrame, segments: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Points with ``local`` by the segments (keys, ps, pe, ls, le) of the same keys; points outside all are left out."""
    inside = points[number].between(segments["ps"], segments["pe"])
    return _by_range(points, segments, keys, number, inside, "inner").select(*[points[c] for c in points.columns], (segments["ls"] + (points[number] - segments["ps"])).alias("local"))


def outside_segments(points: DataFrame, segments: DataFrame, keys: list[str], number: str, local: str) -> DataFrame:
    """Points that no segment of the same keys maps exactly: number and local number inside, and the offset equal."""
    fits = points[number].between(segments["ps"], segments["pe"]) & points[local].between(segments["ls"], segments["le"]) & (points[local] == segments["ls"] + (points[number] - segments["ps"]))
    return _by_range(points, segments, keys, number, fits, "left_anti")


def without_overlap(rows: DataFrame, identity: list[str], owner: str, start: str, end: str) -> DataFrame:
    """Rows whose range meets no range of the same identity and another owner. No pair is ever made.

    A range meets as many ranges as begin by its end, less those that end before its start; it meets another owner's if
    that count over its identity is larger than over its own owner's ranges. Both counts come from one sort of all
    bounds. Rows with a null identity, owner or bound, or that end before they begin, meet nothing. Columns must be of types
    that can be grouped by: rows that are equal in all of them share their fate.
    """
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in [*identity, owner]])
    valid = known & F.coalesce(F.col(start) <= F.col(end), F.lit(False))
    # Of equal bounds starts come first: a range that ends where another begins meets it.
    bounds = rows.where(valid).select("*", F.inline(F.array(*[F.struct(F.col(x).alias("_at"), F.lit(i).alias("_kind")) for i, x in enumerate((start, end))])))
    met = F.lit(0)
    for sign, keys in ((1, identity), (-1, [*identity, owner])):
        so_far = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        starts, ends = (F.sum((F.col("_kind") == k).cast("long")).over(so_far) for k in (0, 1))
        met = met + sign * F.when(F.col("_kind") == 1, starts).otherwise(-ends)
    alone = bounds.withColumn("_met", met).groupBy(*rows.columns).agg(F.sum("_met").alias("_met"), F.count_if(F.col("_kind") == 0).alias("_n")).where("_met = 0")
    again = alone.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return again.select(*rows.columns).unionByName(rows.where(~valid))


def islands(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers of each group: keys, first, last, label."""
    w = Window.partitionBy(*keys).orderBy(number)
    run = rows.select(*keys, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    found = run.groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")
    return found.withColumn("label", range_label(F.col("first"), F.col("last")))


#: What makes a group's numbers unusable, in the order in which it is looked for.
COVERAGE_FAULTS = ("invalid-expected-count", "invalid-local-number", "invalid-provider-number", "duplicate-local-number", "duplicate-provider-number")


def coverage(rows: DataFrame, keys: list[str], local: str, provider: str, expected: Column) -> DataFrame:
    """One row a group: fault (first of five, or null), n_missing, linear, gap, offset (null if not linear).

    Linear: both sides without gaps, and one offset throughout. gap is complete, trailing, leading or both-ends for
    linear groups and internal-or-nonlinear for others. A null number is an invalid one. The sets of numbers that are
    collected are as large as a season.
    """
    p, x = F.col(provider), F.col(local)
    a = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.collect_set(local).alias("xs"), F.size(F.collect_set(provider)).alias("np"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.min(p).alias("plo"), F.max(p).alias("phi"), F.min(p - x).alias("o1"), F.max(p - x).alias("o2"), F.count(local).alias("given"), F.count(provider).alias("pgiven"),
    ).withColumns({"nl": F.size("xs"), "inside": F.size(F.filter("xs", lambda i: i.between(1, expected)))})
    c = F.col
    fault = first_reason(*zip(COVERAGE_FAULTS, (
        F.coalesce(expected < 1, F.lit(True)), (c("lo") < 1) | (c("given") < c("n")), (c("plo") < 1) | (c("pgiven") < c("n")), c("nl") < c("n"), c("np") < c("n"),
    ), strict=True))
    linear = (c("hi") - c("lo") + 1 == c("nl")) & (c("phi") - c("plo") + 1 == c("np")) & (c("o1") == c("o2"))
    missing = expected - c("inside")
    gap = (
        F.when(missing == 0, "complete").when(~linear, "internal-or-nonlinear").when((c("lo") > 1) & (c("hi") < expected), "both-ends")
        .when(c("lo") > 1, "leading").otherwise("trailing")
    )
    valid = fault.isNull()
    return a.select(*keys, fault.alias("fault"), F.when(valid, missing).cast("long").alias("n_missing"), F.when(valid, linear).alias("linear"), F.when(valid, gap).alias("gap"), F.when(valid & linear, c("o1")).cast("long").alias("offset"))
