"""Set-based moves that are verified before anyone sees them.

A move takes the row with a key from one place to another. Moves are carried out together or not at all: what counts is
where rows stand after all of them, so that a row may move to a place that another one leaves.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import store

from .classify import first_reason

#: Why a move can't be carried out, in the order in which it is looked for.
FAULTS = ("moved-twice", "unknown-row", "ambiguous-row", "not-at-origin", "blocked", "shared-target", "occupied-target")


@dataclass(frozen=True)
class Moves:
    """``rows`` (key, from_id, to_id, and the columns of ``scope`` as they were when the move was planned).

    In each scope a place holds one row. ``changes`` are new values of a moved row's other columns; a row whose key is in
    ``blocked`` (key) may not move.
    """

    rows: DataFrame
    key: str
    place: str
    scope: tuple[str, ...] = ()
    changes: dict[str, Column] = field(default_factory=dict)
    blocked: DataFrame | None = None


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def move_faults(rows: DataFrame, moves: Moves) -> DataFrame:
    """The columns of ``moves.rows`` and ``fault``, of moves that can't be carried out."""
    key, scope = moves.key, moves.scope
    asked = moves.rows.select(key, "from_id", "to_id", *scope)
    times = asked.groupBy(key).agg(F.count("*").alias("_times"))
    at = rows.join(times.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("_n"), F.max(F.struct(F.col(moves.place).alias("_at"), *[F.col(c).alias(f"_{c}") for c in scope])).alias("_row"))
    own = [f"_s_{c}" for c in scope]
    there = [("_to", moves.place), *zip(own, scope, strict=True)]
    targets = asked.select(F.col("to_id").alias("_to"), *[F.col(c).alias(x) for c, x in zip(scope, own, strict=True)])
    stay = rows.join(times.select(key), key, "left_anti").join(targets.distinct(), _same(there), "left_semi").select(moves.place, *scope)
    arrive = targets.select("*", F.lit(1).alias("_movers"), F.lit(False).alias("_held"))
    crowd = arrive.unionByName(stay.toDF("_to", *own).select("*", F.lit(0).alias("_movers"), F.lit(True).alias("_held"))).groupBy("_to", *own).agg(F.sum("_movers").alias("_movers"), F.max("_held").alias("_held"))
    blocked = asked.select(F.lit(None).cast(asked.schema[key].dataType).alias(key)).limit(0) if moves.blocked is None else moves.blocked.select(key).distinct()
    joined = asked.join(times, key, "left").join(at, key, "left").join(blocked.withColumn("_blocked", F.lit(True)), key, "left")
    joined = joined.join(crowd, _same([("to_id", "_to"), *zip(scope, own, strict=True)]), "left")
    origin = reduce(Column.__and__, [F.col("_row._at").eqNullSafe(F.col("from_id")), *[F.col(f"_row._{c}").eqNullSafe(F.col(c)) for c in scope]])
    c = F.col
    fault = first_reason(*zip(FAULTS, (
        F.coalesce(c("_times") > 1, F.lit(False)), c("_n").isNull(), c("_n") > 1, ~origin, F.coalesce("_blocked", F.lit(False)), c("_movers") > 1, F.coalesce("_held", F.lit(False)),
    ), strict=True))
    return joined.select(key, "from_id", "to_id", *scope, fault.alias("fault")).where("fault IS NOT NULL")


def moved(rows: DataFrame, moves: Moves) -> DataFrame:
    """``rows`` with all moves carried out; they must be without faults."""
    to = moves.rows.select(F.col(moves.key).alias("_key"), F.col("to_id").alias("_to"), F.lit(True).alias("_moves"))
    joined = rows.join(to, F.col(moves.key) == F.col("_key"), "left")
    changes = {moves.place: F.col("_to"), **moves.changes}
    return joined.select(*[F.when(F.col("_moves"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns])


def bag_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and ``n``: how often a row is more often in ``right`` than in ``left`` (below 0: less often). One exchange,
    added up before it; nulls are values like any other."""
    both = left.select(*columns, F.lit(-1).alias("_n")).unionByName(right.select(*columns, F.lit(1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("n")).where("n <> 0")


def move_audit(before: DataFrame, after: DataFrame, moves: Moves) -> DataFrame:
    """(check, n) of the written table: all n are 0 if it is what the moves promised.

    rows: how many were gained or lost; wrong-place: moves whose row isn't where it should be; touched: other rows that
    aren't as they were; shared-key and shared-place: keys that more rows have than before, and targets with several rows.
    """
    key, scope = moves.key, list(moves.scope)
    asked = moves.rows.select(key, "to_id", *scope)
    lost = before.agg(F.count("*").alias("x")).unionByName(after.agg((-F.count("*")).alias("x"))).agg(F.abs(F.sum("x")).alias("n"))
    there = after.select(F.col(key).alias("_key"), F.col(moves.place).alias("_at"), *[F.col(c).alias(f"_{c}") for c in scope])
    wrong = asked.join(there, _same([(key, "_key"), ("to_id", "_at"), *((c, f"_{c}") for c in scope)]), "left_anti").agg(F.count("*").alias("n"))
    others = [df.join(asked.select(key), key, "left_anti") for df in (before, after)]
    touched = bag_difference(*others, before.columns).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("n"))
    keys = bag_difference(before, after, [key]).agg(F.coalesce(F.sum(F.abs("n")), F.lit(0)).alias("n"))
    places = after.join(asked.select(F.col("to_id").alias("_to"), *[F.col(c).alias(f"_s_{c}") for c in scope]).distinct(), _same([(moves.place, "_to"), *((c, f"_s_{c}") for c in scope)]), "left_semi")
    shared = places.groupBy(moves.place, *scope).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    checks = {"rows": lost, "wrong-place": wrong, "touched": touched, "shared-key": keys, "shared-place": shared}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n")) for name, df in checks.items()])


def carry_out(spark: SparkSession, root: str, plan: dict[str, Moves]) -> store.Commit:
    """Carry out moves in several tables of a store as one commit: all of them, or none and ``Refused`` with the counts of faults.

    Faults are looked for first. The new tables are written, read again and audited, and published together; a failure
    at any time before leaves the store as it was. ``Conflict`` if someone else published meanwhile.
    """
    commit = store.latest(spark, root)
    faults: dict[str, int] = {}
    for name, moves in plan.items():
        found = move_faults(store.read(spark, root, name, commit), moves).groupBy("fault").count().collect()  # a row a kind
        faults |= {f"{name}: {r['fault']}": r["count"] for r in found}
    if faults:
        raise store.Refused(faults)
    staged = {}
    for name, moves in plan.items():
        before = store.read(spark, root, name, commit)
        staged[name] = store.stage(moved(before, moves), root, name)
        audit = move_audit(before, store.at(spark, root, staged[name]), moves).where("n <> 0").collect()  # a row a check
        faults |= {f"{name}: {r['check']}": r["n"] for r in audit}
    if faults:
        raise store.Refused(faults)
    return store.publish(spark, root, commit, staged)
