"""Rules that turn a group's rows into a status, a class or the first reason against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clamp_confidence, status_of

#: What evidence says when something is not there.
NEGATIVE = (
    "not_available", "unavailable", "missing", "no_dub", "no_subtitle", "no_subtitles", "no_audio", "no_language_track",
    "explicitly_not_available",
)


def first_reason(*reasons: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, or null. The order is part of the result."""
    return F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in reasons])


def resolve_evidence(rows: DataFrame, keys: list[str], source: str, value: str, confidence: str) -> DataFrame:
    """(keys, status, score): strong negative evidence, then strong partial evidence, then the best of all other."""
    c, v = clamp_confidence(F.col(confidence)), F.lower(F.trim(F.col(value)))
    negative = F.coalesce(~F.col(source).isin("community", "other") & (c >= 75) & v.isin(*NEGATIVE), F.lit(False))
    partial = F.coalesce(~negative & (v == "partial") & (c >= 75), F.lit(False))
    top = [F.coalesce(F.max(F.when(holds, c)), F.lit(-1)).alias(name) for name, holds in (("n", negative), ("p", partial), ("q", ~negative & ~partial))]
    n, p, q = F.col("n"), F.col("p"), F.col("q")
    says_no, says_part = (n >= 75) & (n >= p) & (n >= q), (p >= 75) & (p >= q)
    status = F.when(says_no, "not_available").when(says_part, "partial").when(q < 0, "unknown").otherwise(status_of(q))
    score = F.when(says_no, n).when(says_part, p).when(q < 0, 0).otherwise(q)
    return rows.groupBy(*keys).agg(*top).select(*keys, status.alias("status"), score.cast("int").alias("score"))


def fold_status(value: str) -> Column:
    """Aggregate of available, partial, missing rows to one status; null if there is none of them."""
    a, p, m = (F.coalesce(F.bool_or(F.col(value) == x), F.lit(False)) for x in ("available", "partial", "missing"))
    return F.when(a & ~p & ~m, "available").when((a | p) & m, "partial").when(p, "partial").when(m, "not_available")


#: Classes of an ownership and of a count mismatch, in the order in which they are looked for.
OWNERSHIP = (
    "other-anime-involved", "unmapped-only", "orphan-only", "owner-only", "owner-then-orphan-adjacent", "orphan-then-owner-adjacent",
    "owner-orphan-with-gap", "fragmented-between-owner-and-orphan",
)
MISMATCH = ("local-mismatch-metadata-missing", "local-mismatch-metadata-differs", "local-short-metadata-exact", "local-long-metadata-exact")


def ownership(rows: DataFrame, season: list[str], number: str, owner: str, orphan: Column, holder: Column) -> DataFrame:
    """How two owners share a season's numbers: one class a season, from each owner's runs of consecutive distinct numbers above 0.

    ``number`` is whole. Rows that come by ``relational.spread`` or a join of such rows on the season's keys stay in their tasks."""
    who = F.when(F.col(owner).isNull(), "u").when(F.col(owner) == orphan, "o").when(F.col(owner) == holder, "w").otherwise("x")
    kinds = rows.where(F.col(number) > 0).select(*season, F.col(number).alias("_n"), who.alias("_who")).distinct()
    of = lambda k, x: F.when(F.col("_who") == k, x)
    a = kinds.groupBy(*season).agg(
        *[F.count_if(F.col("_who") == k).alias(f"n_{k}") for k in "owx"],
        *[f(of(k, F.col("_n"))).alias(f"{n}_{k}") for k in "ow" for n, f in (("lo", F.min), ("hi", F.max))],
    )
    c = F.col
    single = reduce(Column.__and__, [c(f"hi_{k}") - c(f"lo_{k}") + 1 == c(f"n_{k}") for k in "ow"])  # distinct whole numbers without a gap are one run
    kind = first_reason(*zip(OWNERSHIP, (
        c("n_x") > 0, (c("n_o") == 0) & (c("n_w") == 0), c("n_w") == 0, c("n_o") == 0, single & (c("hi_w") + 1 == c("lo_o")), single & (c("hi_o") + 1 == c("lo_w")), single, F.lit(True),
    ), strict=True))
    return a.select(*season, kind.alias("ownership"))


def ownership_summary(rows: DataFrame, season: list[str], number: str, owner: str, orphan: Column, holder: Column) -> DataFrame:
    """(ownership, groups, authoritative, orphan_owned, owner_owned, other_owned, unmapped): of each class the seasons and the
    sums of their episodes by who holds them. Rows as ``ownership`` takes them, one an episode."""
    of = F.col(owner)
    counts = rows.groupBy(*season).agg(
        F.count("*").alias("authoritative"), F.count_if(of == orphan).alias("orphan_owned"), F.count_if(of == holder).alias("owner_owned"), F.count_if(of.isNotNull() & (of != orphan) & (of != holder)).alias("other_owned"), F.count_if(of.isNull()).alias("unmapped")
    )
    joined = ownership(rows, season, number, owner, orphan, holder).join(counts, season)
    return joined.groupBy("ownership").agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in ("authoritative", "orphan_owned", "owner_owned", "other_owned", "unmapped")])


def count_mismatch(authoritative: Column, local: Column, metadata: Column) -> Column:
    """Null for equal counts; else what the metadata's count says about the difference."""
    return F.when(authoritative != local, first_reason(*zip(MISMATCH, (metadata.isNull(), metadata != authoritative, local < authoritative, F.lit(True)), strict=True)))


def aligned(n_expected: Column, n_provider: Column, n_matching: Column, valid: Column) -> Column:
    """Do enough of a batch's numbers match the expected ones? At least three quarters of the smaller set, one at least."""
    need = F.greatest(F.lit(1), F.ceil(F.least(n_expected, n_provider) * 3 / 4))
    return valid & ((n_expected == 0) | (n_matching >= need))


def dub_action(has_dub: Column, finished: Column) -> Column:
    """What an episode's dub says: missing without one, available with one when the title has finished, else null (evidence is cleared)."""
    return F.when(~has_dub, "missing").when(finished, "available")
