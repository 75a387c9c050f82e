"""Scores of provider batches, candidates and seasons against what is known of a title. A null score is a rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import explicit_number

from .classify import aligned

LEAST_SIMILARITY = 0.5
AUTHORITATIVE, CONFLICTING = 1000, -1


def count_conflict(n: Column, expected: Column) -> Column:
    """Is ``n`` too far from the expected count? Unknown or non-positive counts never are."""
    ratio = n / F.when(expected > 0, expected)
    tight, loose = (expected >= 8) & ~ratio.between(0.75, 1.35), (expected >= 3) & ~ratio.between(0.5, 1.75)
    return F.coalesce((n > 0) & (tight | loose), F.lit(False))


def year_conflict(year: Column, expected: Column) -> Column:
    return F.coalesce((year > 0) & (expected > 0) & (F.abs(year - expected) > 1), F.lit(False))


def year_points(year: Column, expected: Column, same: int, next_to: int) -> Column:
    apart = F.abs(year - F.when(expected > 0, expected))
    return F.when(apart == 0, same).when(apart == 1, next_to).otherwise(0)


def candidate_score(mapped: Column, truncated: Column, wanted: Column, similarity: Column, year: Column, season_year: Column, season: Column, wanted_season: Column, n: Column, expected: Column) -> Column:
    """A cross-reference (``mapped``: ids that the candidate claims) decides at once; else similarity, year, season and count."""
    hit = F.coalesce(F.array_contains(mapped, wanted), F.lit(False))
    elsewhere = wanted.isNotNull() & ((F.coalesce(F.size(mapped), F.lit(0)) > 0) | F.coalesce(truncated, F.lit(False)))
    far = F.coalesce(similarity < LEAST_SIMILARITY, F.lit(True)) | year_conflict(year, season_year) | count_conflict(n, expected)
    close = F.abs(n - F.when(expected > 0, expected))
    points = (
        year_points(year, season_year, 30, 8) + F.when(F.upper(season) == F.upper(wanted_season), 20).otherwise(0)
        + F.when((n > 0) & (close == 0), 15).when((n > 0) & (close <= 2), 5).otherwise(0) + F.floor(similarity * 35 + 0.5)
    )
    return F.when(hit, AUTHORITATIVE).when(elsewhere | far, CONFLICTING).otherwise(points).cast("int")


def season_score(year: Column, season_year: Column, n: Column, expected: Column) -> Column:
    """Points for a season's summary: near in year (or a penalty for each year apart) and near in count."""
    apart = F.abs(year - F.when(season_year > 0, season_year))
    by_year = F.when(apart == 0, 60).when(apart == 1, 30).otherwise(-20 * apart)
    by_count = F.greatest(F.lit(0), 40 - 5 * F.abs(F.when(n > 0, n) - F.when(expected > 0, expected)))
    return (F.coalesce(by_year, F.lit(0)) + F.coalesce(by_count, F.lit(0))).cast("int")


def batch_scores(batches: DataFrame, known: DataFrame, contexts: DataFrame, target: str, batch: str) -> DataFrame:
    """(target, batch, score) for every batch of rows (target, batch, number, title, air_date).

    ``contexts`` has one row a target: season_year, episode_count; ``known`` the target's own rows: number, air_date.
    The score is null where a number is null, not positive or repeated, too few numbers are known, titles contradict their numbers,
    or count or year conflict. Rows are matched by (target, number) before the grouping, so a batch is never collected.
    """
    own = known.groupBy(target, "number").agg(F.max("air_date").alias("_date"))
    size = known.groupBy(target).agg(F.count("*").alias("_known"), F.countDistinct(F.when(F.col("number") > 0, F.col("number"))).alias("_numbers"))
    rows = batches.join(own.withColumn("_here", F.lit(True)), [target, "number"], "left").join(contexts.select(target, "season_year", "episode_count"), target, "left")
    number, expected = F.col("number"), F.when(F.col("episode_count") > 0, F.col("episode_count"))
    said = F.when(number > 0, explicit_number(F.col("title")))
    fits = F.when(expected.isNotNull(), number.between(1, expected)).otherwise(F.col("_here") & (number > 0))
    agg = rows.groupBy(target, batch).agg(
        F.count("*").alias("n"), F.count_if(number.isNull() | (number < 1)).alias("bad"), F.countDistinct("number").alias("different"), F.count_if(fits).alias("fits"),
        F.count_if(said == number).alias("agree"), F.count_if(said != number).alias("differ"), F.count_if(F.col("air_date") == F.col("_date")).alias("dates"),
        F.count_if(F.length(F.trim("title")) > 0).alias("named"), F.min(F.when(F.col("air_date") != "", F.col("air_date"))).alias("first"),
        F.max(expected).alias("expected"), F.max("season_year").alias("year"),
    ).join(size, target, "left")
    n, c = F.col("n"), F.col("expected")
    n_known, first_year = F.coalesce("_known", F.lit(0)), F.substring("first", 1, 4).try_cast("int")
    n_expected = F.coalesce(c, "_numbers", F.lit(0))
    reject = (
        ~aligned(n_expected, n, F.col("fits"), (F.col("bad") == 0) & (F.col("different") == n))
        | ((F.col("agree") + F.col("differ") >= 3) & (F.col("differ") > F.col("agree"))) | count_conflict(n, c)
        | (c.isNull() & (n_known >= 8) & (n < F.ceil(n_known * 3 / 4))) | year_conflict(first_year, F.col("year"))
    )
    count = F.coalesce(c, n_known)
    points = F.when(count > 0, F.greatest(F.lit(0), 30 - 4 * F.abs(n - count))).otherwise(0) + year_points(first_year, F.col("year"), 20, 8) + 8 * F.col("dates") + F.col("named")
    return agg.select(target, batch, F.when(~reject, points).cast("long").alias("score"))
