"""What planner jobs ask of a collision: an orphan group and the provider identity that its episodes name. Every lookup is
joined once for all jobs; a job's gates are conditions over the columns of the one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import staged

from .planning import in_order
from .relational import dealt, spread

IDENTITY = ["provider", "provider_id"]
#: Tables are dealt by the id alone: rows lie right for joins by identity also where Spark knows the provider to be a constant.
_BY_IDENTITY = ["provider_id"]


def collision_facts(
    groups: DataFrame, associations: DataFrame, segments: DataFrame, parents: DataFrame, mapped: DataFrame, seasons: DataFrame, metadata: DataFrame, scope: Column | bool = True
) -> DataFrame:
    """``groups`` (anime_id, provider, provider_id ...) with facts about their identity, written once and read by all jobs.

    ``associations``: association_id, anime_id, provider, provider_id; ``segments``: association_id; ``parents`` (legacy):
    anime_id, provider, provider_id, of which the one of the least anime_id counts; ``mapped``: anime_id, provider, episode_id; ``seasons``:
    provider, provider_id, episode_id (authoritative); ``metadata``: anime_id. Facts:

    n_owners, n_others: associations of the identity, and those of other titles; owner: the other title, where there is
    one; associated, provider_associated: has the title an association of the identity, of the provider; owner_segments;
    parent: title of the legacy parent; described: has the title metadata; target_outside, owner_outside: episodes that a title
    has mapped of the provider but not of the season. These two are looked up where ``scope``, a condition over the other
    facts, holds, and are 0 elsewhere; False leaves them out.

    Rows move once by identity and once by title. ``seasons`` needn't move if it lies by provider_id already.
    """
    c = F.col
    cut = segments.groupBy("association_id").agg(F.count("*").alias("_cut"))
    owned = spread(associations.join(dealt(cut), "association_id", "left"), _BY_IDENTITY).groupBy(*IDENTITY, c("anime_id").alias("_a")).agg(F.count("*").alias("_k"), F.sum(F.coalesce("_cut", F.lit(0))).alias("_cut"))
    per = owned.groupBy(*IDENTITY).agg(F.sum("_k").alias("n_owners"), F.sum("_cut").alias("_segments"), F.min("_a").alias("_low"), F.max("_a").alias("_high"))
    legacy = spread(parents, _BY_IDENTITY).groupBy(*IDENTITY).agg(F.min("anime_id").alias("parent"))
    known = spread(groups, _BY_IDENTITY).join(dealt(per), IDENTITY, "left").join(dealt(legacy), IDENTITY, "left")
    mine = spread(associations.select("anime_id", *IDENTITY), ["anime_id"]).groupBy("anime_id", *IDENTITY).agg(F.count("*").alias("_mine"))
    any_ = spread(associations.select("anime_id", "provider"), ["anime_id"]).distinct().withColumn("_any", F.lit(True))
    described = metadata.select("anime_id").distinct().withColumn("described", F.lit(True))
    known = spread(known, ["anime_id"]).join(dealt(mine), ["anime_id", *IDENTITY], "left").join(dealt(any_), ["anime_id", "provider"], "left").join(dealt(described), "anime_id", "left")
    others = F.coalesce(c("n_owners"), F.lit(0)) - F.coalesce(c("_mine"), F.lit(0))
    owner = F.when(others == 1, F.when(c("_low") == c("anime_id"), c("_high")).otherwise(c("_low")))
    facts = known.withColumns({
        "n_owners": F.coalesce("n_owners", F.lit(0)), "n_others": others, "owner": owner, "associated": c("_mine").isNotNull(), "provider_associated": c("_any").isNotNull(), "owner_segments": F.coalesce("_segments", F.lit(0)),
        "described": F.coalesce("described", F.lit(False)),
    }).drop("_segments", "_low", "_high", "_mine", "_any")
    facts = staged(facts, "facts", as_they_lie=True)
    if scope is False:
        return facts
    holds = F.lit(True) if scope is True else F.coalesce(scope, F.lit(False))
    near, far = facts.where(holds), facts.where(~holds)
    titles = near.select(F.inline(F.array(*[F.struct(c(who).alias("_who"), *IDENTITY) for who in ("anime_id", "owner")])))
    asked = spread(titles.where("_who IS NOT NULL"), ["_who"]).distinct()
    rows = asked.join(dealt(spread(mapped.select(c("anime_id").alias("_who"), "provider", "episode_id"), ["_who"])), ["_who", "provider"])
    wrong = spread(rows, _BY_IDENTITY).join(dealt(seasons.select(*IDENTITY, "episode_id")), [*IDENTITY, "episode_id"], "left_anti")
    outside = staged(wrong.groupBy("_who", *IDENTITY).agg(F.count("*").alias("_n")), "outside", as_they_lie=True)  # joined twice
    near = spread(near, _BY_IDENTITY)
    for who, name in (("anime_id", "target_outside"), ("owner", "owner_outside")):
        counted = spread(outside, _BY_IDENTITY).select(c("_who").alias(who), *IDENTITY, c("_n").alias(name))
        near = near.join(dealt(counted), [who, *IDENTITY], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return near.unionByName(far.withColumns({name: F.lit(0).cast("long") for name in ("target_outside", "owner_outside")}))


def _c(name: str) -> Column:
    return F.col(name)


def claimed() -> Column:
    """The first gate of an ownership repair that fails before the titles' other episodes are looked up."""
    return in_order(
        ("missing-provider-entity", _c("n_owners") == 0), ("target-provider-association-already-exists", _c("provider_associated")), ("owner-count-not-one", _c("n_owners") != 1), ("existing-provider-segments", _c("owner_segments") != 0),
        ("missing-legacy-parent", _c("parent").isNull()), ("legacy-parent-owner-mismatch", _c("parent") != _c("owner")),
    )


def out_of_scope() -> Column:
    """The first gate of an ownership repair that fails before plans and checks are asked for."""
    return in_order(claimed(), ("target-provider-scope-mismatch", _c("target_outside") > 0), ("owner-provider-scope-mismatch", _c("owner_outside") > 0))


def unsupported(plan: Column, identity: Column, airdate: Column) -> Column:
    """The first gate that a repair in scope fails before its transfer; the columns hold the reasons of the checks that are made elsewhere."""
    return in_order(plan, ("missing-target-metadata", ~_c("described")), identity, airdate)


def season_airdates(plan: Column, identity: Column, airdate: Column) -> Column:
    """The first gate that a season air date check fails."""
    return in_order(("missing-provider-entity", _c("n_owners") == 0), ("target-association-already-exists", _c("associated")), ("owner-count-not-one", _c("n_others") != 1), unsupported(plan, identity, airdate))


def in_scope() -> Column:
    """The gates that a count mismatch is looked at behind: rows that fail are left out, not counted."""
    alone = (_c("n_owners") == 1) & ~_c("associated") & ~_c("provider_associated") & (_c("owner_segments") == 0)
    return F.coalesce(alone & (_c("parent") == _c("owner")) & (_c("target_outside") == 0) & (_c("owner_outside") == 0), F.lit(False))


def dual_segments(ownership: Column, plan: Column) -> Column:
    """The first gate that a dual segment plan fails; ``ownership`` is the season's class, ``plan`` the reason of the plan."""
    adjacent = F.coalesce(ownership.isin("owner-then-orphan-adjacent", "orphan-then-owner-adjacent"), F.lit(False))
    return in_order(
        ("missing-provider-entity", _c("n_owners") == 0), ("orphan-association-already-exists", _c("associated")), ("owner-count-not-one", _c("n_others") != 1), ("existing-segments-present", _c("owner_segments") != 0), ("not-adjacent-ownership", ~adjacent), plan
    )


def collision_segments(identity: Column, plan: Column) -> Column:
    """The first gate that a collision segment fails before candidates are compared with each other."""
    return in_order(identity, plan, ("missing-provider-entity", _c("n_owners") == 0), ("provider-entity-has-no-other-owner", _c("n_others") == 0))
