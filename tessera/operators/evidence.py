"""Evidence for or against a mapping: identity, dates, prefixes of seasons, relations, and faults of what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import days_apart, strict_date

from .classify import first_reason
from .relational import dealt

#: Thresholds, and the reasons of each check in their order.
LEAST_TITLE, MOST_DAYS = 0.72, 180
IDENTITY_REASONS = ("target-metadata-count-mismatch", "provider-title-unavailable", "provider-title-mismatch")
AIRDATE_REASONS = ("target-start-date-unavailable", "provider-airdate-unavailable", "provider-start-date-mismatch")
PREFIX_REASONS = (
    "metadata-count-unavailable", "authoritative-season-not-contiguous", "provider-season-not-larger-than-target", "target-local-coverage-mismatch", "target-transform-not-zero-prefix",
    "target-not-strict-majority", "missing-prefix-provider-episode-unmapped", "missing-prefix-owned-by-other-anime", "target-start-date-unavailable", "target-end-date-unavailable",
    "provider-prefix-boundary-airdate-unavailable", "provider-prefix-start-date-mismatch", "provider-prefix-end-date-mismatch",
)
RELATIONS = ("missing-anime-metadata", "direct-prequel-sequel", "direct-related-other", "not-directly-related")


def identity_reason(count: Column, authoritative: Column, n_titles: Column, similarity: Column) -> Column:
    """Why a season isn't the target's, by its count and the best similarity of their titles; null if it is."""
    return first_reason(*zip(IDENTITY_REASONS, (~count.eqNullSafe(authoritative), F.coalesce(n_titles, F.lit(0)) == 0, F.coalesce(similarity, F.lit(0.0)) < LEAST_TITLE), strict=True))


def airdate_reason(start: Column, aired: Column) -> Column:
    """Why a season's first date (a text) doesn't fit the target's; null if it does."""
    a, b = strict_date(start), strict_date(aired)
    return first_reason(*zip(AIRDATE_REASONS, (a.isNull(), b.isNull(), days_apart(a, b) > MOST_DAYS), strict=True))


def relation_evidence(known: Column, kinds: Column) -> Column:
    """How two titles are related: ``known``, is there metadata of both; ``kinds``, an array of the relations between them."""
    upper = F.transform(kinds, lambda k: F.upper(F.trim(k)))
    return first_reason(*zip(RELATIONS, (~known, F.arrays_overlap(upper, F.array(F.lit("PREQUEL"), F.lit("SEQUEL"))), F.size(kinds) > 0, F.lit(True)), strict=True))


def prefix_evidence(targets: DataFrame, episodes: DataFrame, owned: DataFrame, season: list[str]) -> DataFrame:
    """One row for each of ``targets`` (season, target, owner, n, offset, pairs, local_ok, start_date, end_date): reason and missing numbers.

    Is the target the first ``n`` numbers of a longer season of ``episodes`` (season, number, air_date)? ``owned`` (season, number, anime_id)
    says who holds which; the target must hold the strict majority, the owner alone each of the others. ``offset`` and ``pairs``
    are those of the observed transform, local_ok says that the target's own numbers are 1 to n.
    """
    c = F.col
    a = episodes.groupBy(*season).agg(F.count("*").alias("m"), F.size(F.collect_set("number")).alias("dm"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    holders = owned.groupBy(*season, "number").agg(F.count("*").alias("holders"), F.array_sort(F.collect_list("anime_id")).alias("who"))
    seen = owned.select(*season, "number", F.col("anime_id").alias("target")).distinct().groupBy(*season, "target").agg(F.array_sort(F.collect_set("number")).alias("observed"))
    ends = targets.join(episodes, season).groupBy(*season, "target").agg(*[F.max(F.when(c("number") == at, F.trim("air_date"))).alias(x) for x, at in (("first", F.lit(1)), ("last", c("n")))])
    joined = targets.join(a, season, "left").join(seen, [*season, "target"], "left").join(ends, [*season, "target"], "left").withColumn("observed", F.coalesce("observed", F.array().cast("array<int>")))
    gaps = joined.where(c("n") > 0).select(*season, "target", "owner", F.explode(F.array_except(F.sequence(F.lit(1), c("n")), "observed")).alias("number")).join(holders, [*season, "number"], "left")
    fault = F.when(c("holders").isNull(), PREFIX_REASONS[6]).when((c("holders") != 1) | (c("who")[0] != c("owner")), PREFIX_REASONS[7])
    per = gaps.groupBy(*season, "target").agg(F.min(F.when(fault.isNotNull(), F.struct("number", fault.alias("fault")))).alias("bad"), F.array_sort(F.collect_list("number")).alias("missing"))
    start, end, first, last = (strict_date(c(x)) for x in ("start_date", "end_date", "first", "last"))
    outside = F.exists("observed", lambda x: (x < 1) | (x > c("n"))) | (F.size("observed") != c("pairs"))
    reason = F.coalesce(*[F.when(holds, name) for name, holds in zip(PREFIX_REASONS[:6], (
        F.coalesce(c("n") <= 0, F.lit(True)), c("m").isNull() | (c("lo") != 1) | (c("dm") != c("m")) | (c("hi") != c("m")), c("m") <= c("n"), ~c("local_ok"), F.coalesce(c("offset") != 0, F.lit(True)) | outside, F.size("observed") * 2 <= c("n"),
    ), strict=True)], c("bad.fault"), *[F.when(holds, name) for name, holds in zip(PREFIX_REASONS[8:], (
        start.isNull(), end.isNull(), first.isNull() | last.isNull(), days_apart(start, first) > MOST_DAYS, days_apart(end, last) > MOST_DAYS,
    ), strict=True)])
    out = joined.join(per, [*season, "target"], "left")
    return out.select(*season, "target", reason.alias("reason"), F.when(reason.isNull(), F.coalesce("missing", F.array().cast("array<int>"))).alias("missing"))


def mapping_faults(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, provider, fault): what keeps mappings (keys, provider, provider_id, is_primary) from being written: blank, duplicate, or
    several of one provider without exactly one primary; null for none. One row for each provider of a group."""
    per_id = rows.groupBy(*keys, "provider", F.trim("provider_id").alias("_id")).agg(F.count("*").alias("n"), F.count_if("is_primary").alias("p"))
    a = per_id.groupBy(*keys, "provider").agg(F.bool_or(F.coalesce(F.col("_id"), F.lit("")) == "").alias("blank"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    fault = first_reason(("blank", F.col("blank")), ("duplicate", F.col("most") > 1), ("not-one-primary", (F.col("n") > 1) & (F.col("p") != 1)))
    return a.select(*keys, "provider", fault.alias("fault"))


def authoritative(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The one identity of each provider (keys, provider, provider_id, url, position), of repeats the last; ``fault`` if it is blank or there are several."""
    clean = rows.withColumns({"provider_id": F.trim("provider_id"), "url": F.nullif(F.trim("url"), F.lit(""))})
    a = clean.groupBy(*keys, "provider").agg(F.max(F.coalesce("provider_id", F.lit("")) == "").alias("blank"), F.min("provider_id").alias("lo"), F.max("provider_id").alias("hi"), F.max_by(F.struct("provider_id", "url"), position).alias("last"))
    fault = first_reason(("blank-provider-id", F.col("blank")), ("multiple-identities", F.col("lo") != F.col("hi")))
    return a.select(*keys, "provider", F.when(fault.isNull(), F.col("last.provider_id")).alias("provider_id"), F.when(fault.isNull(), F.col("last.url")).alias("url"), fault.alias("fault"))


def suffix_evidence(seasons: DataFrame, episodes: DataFrame, mapped: DataFrame, candidates: DataFrame, season: list[str]) -> DataFrame:
    """One row for each of ``seasons`` (season, prefix_end, owner): what is known of the numbers behind the prefix.

    ``episodes`` (season, number, air_date); ``mapped`` (season, number, anime_id, local_number, kind); ``candidates`` (season, anime_id,
    episode_count, locals (array of its normal numbers), start_date, end_date, related). A candidate fits if count, own numbers 1 to n and both dates do.
    Result: suffix_start, suffix_end (null unless the season is 1 to m and longer than the prefix), n_mapped, exact (the one title that holds the
    whole suffix in step and fits), related (the only related one that fits), owner_fits.
    """
    c = F.col
    a = episodes.groupBy(*season).agg(F.count("*").alias("m"), F.size(F.collect_set("number")).alias("dm"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    whole = (c("lo") == 1) & (c("dm") == c("m")) & (c("hi") == c("m")) & (c("prefix_end") > 0) & (c("prefix_end") < c("m"))
    cut = seasons.join(dealt(a), season, "left").withColumns({"suffix_start": F.when(whole, c("prefix_end") + 1), "suffix_end": F.when(whole, c("m"))}).withColumn("k", c("suffix_end") - c("suffix_start") + 1)
    dates = cut.join(dealt(episodes), season).groupBy(*season).agg(*[F.max(F.when(c("number") == c(at), F.trim("air_date"))).alias(x) for x, at in (("first", "suffix_start"), ("last", "suffix_end"))])
    behind = cut.join(dealt(mapped), season).where(c("number").between(c("suffix_start"), c("suffix_end")))
    in_step = (c("kind") == "normal") & (c("local_number") == c("number") - c("suffix_start") + 1)
    held = behind.groupBy(*season).agg(F.count("*").alias("n_mapped"), F.size(F.collect_set("number")).alias("dn"), F.min("anime_id").alias("one"), F.max("anime_id").alias("other"), F.coalesce(F.bool_and(in_step), F.lit(False)).alias("in_step"))
    near = lambda own, aired: F.coalesce(days_apart(strict_date(c(own)), strict_date(c(aired))) <= MOST_DAYS, F.lit(False))
    # ``locals`` is as long as a season
    covers = F.array_sort("locals") == F.transform(F.sequence(F.lit(1), c("k")), lambda i: i.cast("int"))
    judged = cut.join(dealt(dates), season, "left").join(dealt(candidates), season).withColumn("fits", F.coalesce(c("episode_count").eqNullSafe(c("k")) & covers & near("start_date", "first") & near("end_date", "last"), F.lit(False)))
    fitting = judged.where("fits").groupBy(*season).agg(
        F.collect_set("anime_id").alias("all"), F.count_if("related").alias("n_related"), F.min(F.when(c("related"), c("anime_id"))).alias("kin"), F.bool_or(c("anime_id") == c("owner")).alias("owner_fits"),
    )
    out = cut.join(dealt(held), season, "left").join(dealt(fitting), season, "left")
    exact = (c("n_mapped") == c("k")) & (c("dn") == c("k")) & (c("one") == c("other")) & c("in_step") & F.array_contains("all", c("one"))
    return out.select(
        *season, "suffix_start", "suffix_end", F.coalesce("n_mapped", F.lit(0)).alias("n_mapped"), F.when(exact, c("one")).alias("exact"), F.when(c("n_related") == 1, c("kin")).alias("related"),
        F.coalesce("owner_fits", F.lit(False)).alias("owner_fits"),
    )
