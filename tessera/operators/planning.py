"""Gates of planner jobs: ordered reasons, nested counters, transforms, leases and due times."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import staged

from .classify import first_reason
from .relational import dealt

STALE = "INTERVAL 5 MINUTES"
RETRY = "INTERVAL 15 MINUTES"


def gated(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with ``reason``: the first gate that fails, or null for a candidate. A null condition fails no gate."""
    return rows.withColumn("reason", first_reason(*gates))


def in_order(*steps: tuple[str, Column] | Column) -> Column:
    """The first reason of a job's gates: pairs of a name and a condition, and columns that hold a reason themselves."""
    return F.coalesce(*[F.when(x[1], F.lit(x[0])) if isinstance(x, tuple) else x for x in steps])


def gated_in_turn(rows: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``reason`` of every row, null for a candidate, where the gates of a step ask for more than the row's own columns.

    A step gives the rows back with ``reason``, and is asked only for those that no step before has rejected. What it
    gives is written before the next begins, so that only one step's exchanges lie on the disks at a time.
    """
    rejected = []
    for step in steps:
        judged = staged(step(rows), "judged", as_they_lie=True)
        rejected.append(judged.where("reason IS NOT NULL").select("reason"))
        rows = judged.where("reason IS NULL").drop("reason")
    return reduce(DataFrame.unionByName, rejected, rows.select(F.lit(None).cast("string").alias("reason")))


def reject_single_use(rows: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Candidates that share their keys with another candidate are all rejected; rows with a reason already keep it."""
    n = rows.where("reason IS NULL").groupBy(*keys).agg(F.count("*").alias("_n"))
    joined = rows.join(n, keys, "left")
    return joined.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_n") > 1), reason).otherwise(F.col("reason"))).select(*rows.columns)


def reason_counts(rows: DataFrame) -> DataFrame:
    """(reason, n); candidates count under 'candidate'."""
    return rows.groupBy(F.coalesce("reason", F.lit("candidate")).alias("reason")).agg(F.count("*").alias("n"))


def passed_counts(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """(gate, n) for nested gates: how many rows reach a gate's end with no failure so far. One pass over the rows."""
    ok, counters = F.lit(True), []
    for name, fails in gates:
        ok = ok & ~F.coalesce(fails, F.lit(False))
        counters.append(F.struct(F.lit(name).alias("gate"), F.count_if(ok).alias("n")))
    return rows.agg(F.array(*counters).alias("a")).select(F.inline("a"))


#: Why no transform is inferred, in the order in which it is looked for; what was observed of its ends; how two ranges lie.
TRANSFORM_FAULTS = (
    "invalid-metadata-count", "duplicate-provider-episode-number", "missing-authoritative-provider-episode", "invalid-local-episode-number", "duplicate-local-episode-number",
    "duplicate-provider-episode-number", "non-linear-observed-transform", "inferred-segment-outside-provider-season",
)
BOUNDARIES = ("both-boundaries-observed", "local-start-observed", "local-end-observed", "internal-only")
RELATIONS = ("same-inferred-segment", "overlapping-inferred-segments", "disjoint-with-gap", "exact-provider-partition", "adjacent-provider-subset")


def observed_transform(mapped: DataFrame, episodes: DataFrame, keys: list[str], count: str) -> DataFrame:
    """One row a group of ``mapped`` (keys, episode_id, local_number, count): reason, offset, first, last, boundary.

    ``episodes`` (keys, episode_id, number): the authoritative season. The offset is what all rows agree on; it
    stretches to 1+offset..count+offset, each number of which the season must have. boundary tells which ends of that range
    were observed. A row's own faults, an unknown episode or a number outside 1..count, come in order of local_number, unknown episodes first.
    """
    season = episodes.groupBy(*keys).agg(F.count("*").alias("ne"), F.countDistinct("episode_id").alias("ni"), F.collect_set("number").alias("numbers"))
    known = episodes.groupBy(*keys, "episode_id").agg(F.max("number").alias("number"))
    c = F.col
    off = c("number") - c("local_number")
    foreign, outside = c("number").isNull(), F.coalesce((c("local_number") < 1) | (c("local_number") > c(count)), F.lit(True))
    first = F.min(F.when(foreign | outside, F.struct("local_number", (~foreign).alias("own"), foreign.alias("foreign"))))
    a = mapped.join(dealt(known), [*keys, "episode_id"], "left").groupBy(*keys).agg(
        F.max(count).alias("c"), F.min(off).alias("o"), F.max(off).alias("o2"), F.min("local_number").alias("lo_l"), F.max("local_number").alias("hi_l"), first.alias("bad"),
        F.count("*").alias("n"), F.size(F.collect_set("number")).alias("np"), F.size(F.collect_set("local_number")).alias("nl"),
    ).join(dealt(season), keys, "left")
    wanted = F.sequence(c("o") + 1, c("o") + c("c"))
    reason = first_reason(*zip(TRANSFORM_FAULTS, (
        F.coalesce(c("c") < 1, F.lit(True)), (c("ni") < c("ne")) | (F.size("numbers") < c("ne")), F.coalesce(c("bad.foreign"), F.lit(False)), c("bad").isNotNull(), c("nl") < c("n"),
        c("np") < c("n"), c("o") != c("o2"), (c("o") + 1 < 1) | (F.size(F.array_except(wanted, "numbers")) > 0),
    ), strict=True))
    start, end = c("lo_l") == 1, c("hi_l") == c("c")
    boundary = first_reason(*zip(BOUNDARIES, (start & end, start, end, F.lit(True)), strict=True))
    good = reason.isNull()
    return a.select(*keys, reason.alias("reason"), *[F.when(good, x).alias(n) for n, x in (("offset", c("o")), ("first", c("o") + 1), ("last", c("o") + c("c")), ("boundary", boundary))])


def transform_report(transforms: DataFrame) -> DataFrame:
    """(measure, value, n) of ``observed_transform`` rows: groups by boundary and by offset of those with a transform, the
    others by reason."""
    kinds = (("boundary", F.col("boundary")), ("offset", F.col("offset").cast("string")), ("reason", F.col("reason")))
    each = transforms.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in kinds])))
    return each.where("value IS NOT NULL").groupBy("measure", "value").agg(F.count("*").alias("n"))


def dual_relation(s1: Column, e1: Column, s2: Column, e2: Column, numbers: Column) -> Column:
    """How two ranges of one season lie, whose authoritative numbers are the array ``numbers``."""
    union = F.array_union(F.sequence(s1, e1), F.sequence(s2, e2))
    own = F.array_distinct(numbers)
    whole = (F.size(F.array_except(union, own)) == 0) & (F.size(F.array_except(own, union)) == 0)
    gap = F.greatest(s1, s2) - F.least(e1, e2) > 1
    return first_reason(*zip(RELATIONS, ((s1 == s2) & (e1 == e2), (s1 <= e2) & (s2 <= e1), gap, whole, F.lit(True)), strict=True))


def stale_leases(runs: DataFrame, now: Column, heartbeat: str = "heartbeat_at", started: str = "started_at") -> DataFrame:
    """Running rows whose last sign of life is older than five minutes."""
    return runs.where((F.col("status") == "running") & (F.coalesce(heartbeat, started) < now - F.expr(STALE)))


def due_at(completed: Column, failed: Column, interval_minutes: Column, now: Column) -> Column:
    """When a job runs next: an interval after it last completed; after a later failure, 15 minutes or the interval if that is less."""
    whole, retry = F.make_dt_interval(mins=interval_minutes), F.make_dt_interval(mins=F.least(interval_minutes, F.lit(15)))
    done = completed.isNotNull() & (failed.isNull() | (completed >= failed))
    return F.when(done, completed + whole).when(failed.isNotNull(), failed + retry).otherwise(now)
