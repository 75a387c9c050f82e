"""Identities of orphan groups whose episode addresses name a show by its slug: one answer of slugs, seasons and ids, checked
against the show's own episodes, and left out where two groups claim it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import decoded, encoded, positive_id
from tessera.sources.shared import staged

from .repair import WEAK, weak_automatic

#: The provider, the reasons against a group in their order, the address of a season.
PROVIDER = "thetvdb"
REASONS = ("conflicting-provider-identity", "tvdb-slug-not-found", "tvdb-episode-verification-failed")
COLLISION = "providerIdentityCollision"
SEASON_URL = "https://thetvdb.com/series/"
#: An episode's address: host, show (slug or id), episode; empty segments don't count.
ADDRESS = r"^(?i:[a-z][a-z0-9+.-]*)://+(?:[^/?#@]*@)?(?i:(?:www\.)?thetvdb\.com)(?::[0-9]*)?/+series/+([^/?#]+)/+episodes/+([^/?#]+)/*(?:[?#].*)?$"


def normal_slug(c: Column) -> Column:
    return F.lower(F.trim(c))


def slug_evidence(rows: DataFrame) -> DataFrame:
    """``rows`` (url, provider_id, season, number ...) with show, show_id, s, e, n: the show's segment, its id if it is one,
    and season, episode id and number; all null unless the address and the row agree on the episode."""
    c = F.col
    parts = rows.withColumn("_parts", F.array(*[F.nullif(F.regexp_extract("url", ADDRESS, i), F.lit("")) for i in (1, 2)]))
    show = F.nullif(F.trim(decoded(F.get("_parts", F.lit(0)))), F.lit(""))
    season, episode, number = (positive_id(c(x)) for x in ("season", "provider_id", "number"))
    good = F.coalesce(season.isNotNull() & number.isNotNull() & (positive_id(F.get("_parts", F.lit(1))) == episode) & show.isNotNull(), F.lit(False))
    found = (("show", show), ("show_id", positive_id(show)), ("s", season), ("e", episode), ("n", number))
    return parts.select(*rows.columns, *[F.when(good, x).alias(n) for n, x in found])


def slug_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, evidence): a row for each anime_id with orphan mappings of PROVIDER, and the evidence of its mappings.

    ``rows``: mapping_id, anime_id, provider, url, provider_id, season, number, source, confidence. A group without a
    reason has weak mappings only, evidence for each, one slug in any spelling (the latest mapping's is kept), one season
    and at most one numeric id, which a show must then have.
    """
    c = F.col
    seen = slug_evidence(rows.where(c("provider") == PROVIDER)).withColumn("weak", weak_automatic(c("source"), c("confidence")))
    seen = staged(seen.select("anime_id", "mapping_id", "show", "show_id", "s", "e", "n", "weak", "confidence"), "slugs")  # addresses are taken apart once
    slug = F.when(c("show_id").isNull(), c("show"))
    spelled = F.when(slug.isNotNull(), F.struct("mapping_id", slug.alias("slug")))
    groups = seen.groupBy("anime_id").agg(
        F.count("*").alias("n"), F.bool_and("weak").alias("weak"), F.count("show").alias("known"), F.min(normal_slug(slug)).alias("slug"), F.max(normal_slug(slug)).alias("slug2"), F.min("s").alias("season"), F.max("s").alias("season2"),
        F.min("show_id").alias("id"), F.max("show_id").alias("id2"), F.max(spelled).alias("spelled"), F.least(F.lit(WEAK), F.min("confidence")).cast("int").alias("confidence"),
    )
    one = c("weak") & (c("known") == c("n")) & c("slug").isNotNull() & (c("slug") == c("slug2")) & (c("season") == c("season2")) & c("id").eqNullSafe(c("id2"))
    bad = ~F.coalesce(one, F.lit(False))
    out = groups.select("anime_id", F.when(bad, REASONS[0]).alias("reason"), *[F.when(~bad, x).alias(n) for n, x in (("slug", c("slug")), ("spelling", c("spelled.slug")), ("season", c("season")), ("expected_id", c("id")))], "confidence", "n")
    return staged(out, "slug-groups"), seen.where("show IS NOT NULL").select("anime_id", "s", "e", c("n").alias("number"))


def resolved_slugs(groups: DataFrame, evidence: DataFrame, series: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row a group: anime_id, reason, provider_id (show:season), slug, url, confidence, n.

    ``series``: slug, series_id; ``episodes`` (series_id, season, episode_id, number): every episode that the group's
    mappings name must be there with its number.
    """
    c = F.col
    shows = series.where("series_id > 0").groupBy(normal_slug(c("slug")).alias("slug")).agg(F.min("series_id").alias("series_id"))
    # Only groups with a slug are looked up: the others would all meet under a null key.
    asking = groups.where("reason IS NULL").join(shows, "slug", "left")
    found = asking.unionByName(groups.where("reason IS NOT NULL").withColumn("series_id", F.lit(None).cast(shows.schema["series_id"].dataType)))
    asked = evidence.join(asking.where("series_id IS NOT NULL").select("anime_id", "series_id"), "anime_id")
    real = episodes.where("episode_id > 0 AND number > 0").groupBy("series_id", c("season").alias("s"), c("episode_id").alias("e")).agg(F.max("number").alias("_number"))
    checked = asked.join(real, ["series_id", "s", "e"], "left").groupBy("anime_id").agg(F.bool_and(F.coalesce(c("_number") == c("number"), F.lit(False))).alias("_there"))
    joined = found.join(checked, "anime_id", "left")
    verified = F.coalesce(c("_there"), F.lit(False)) & (c("expected_id").isNull() | (c("expected_id") == c("series_id")))
    reason = F.coalesce("reason", F.when(c("series_id").isNull(), REASONS[1]).when(~verified, REASONS[2]))
    identity = F.concat_ws(":", c("series_id").cast("string"), c("season").cast("string"))
    url = F.concat(F.lit(SEASON_URL), encoded(c("spelling")), F.lit("/seasons/official/"), c("season").cast("string"))
    good = reason.isNull()
    # A group that failed only at its episodes keeps the identity that it was looked up under.
    shown = F.when(good | (reason == REASONS[2]), identity)
    return joined.select("anime_id", reason.alias("reason"), shown.alias("provider_id"), *[F.when(good, x).alias(n) for n, x in (("slug", c("spelling")), ("url", url), ("confidence", c("confidence")))], "n")


def without_collisions(plans: DataFrame, existing: DataFrame) -> DataFrame:
    """``plans`` of which those without a reason get COLLISION where ``existing`` (provider, provider_id) has the identity or
    another group asks for it too."""
    held = existing.where(F.col("provider") == PROVIDER).select(F.col("provider_id").alias("_id")).distinct().withColumn("_held", F.lit(True))
    asked = plans.where("reason IS NULL").groupBy(F.col("provider_id").alias("_id")).agg(F.countDistinct("anime_id").alias("_askers"))
    claims = asked.join(held, "_id", "left").where("_held OR _askers > 1").select("_id", F.lit(COLLISION).alias("_why"))
    joined = plans.where("reason IS NULL").join(claims, F.col("provider_id") == F.col("_id"), "left")
    return joined.withColumn("reason", F.col("_why")).select(*plans.columns).unionByName(plans.where("reason IS NOT NULL"))
