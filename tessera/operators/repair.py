"""Repair plans: orphan parents, linear and aligned segments, whole-season repairs and transfers.

Each plan is one row a group with ``reason``, the first of a fixed order of reasons against it, or null and the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import positive_id
from tessera.sources.shared import staged

from .classify import first_reason
from .ranges import without_overlap
from .relational import dealt, spread

#: The greatest confidence of a mapping that a job may replace, and the reasons of each plan in their order.
WEAK = 85
ORPHAN_REASONS = ("unsupportedProvider", "strongerOrManualEvidence", "incompleteParentEvidence", "conflictingParentEvidence", "providerIdentityCollision")
LINEAR_REASONS = ("stronger-or-manual-evidence", "invalid-local-coverage", "invalid-provider-numbering", "non-linear-numbering")
OVERLAP = "overlapping-candidate-segment"
ALIGNED_REASONS = (
    "empty-episode-range", "non-normal-local-episode", "invalid-episode-number", "duplicate-provider-episode-number", "duplicate-local-episode-number", "non-contiguous-provider-range",
    "non-contiguous-local-range", "non-linear-local-alignment",
)
SEASON_REASONS = (
    "invalid-authoritative-numbering", "target-local-count-mismatch", "target-local-numbering-invalid", "owner-also-full-season-sized", "unmapped-provider-episodes", "third-anime-involved",
    "target-mapping-number-mismatch", "nothing-to-move", "owner-does-not-fill-target-gaps", "target-not-majority-owner",
)
TRANSFER_REASONS = (
    "duplicate-provider-episode-number", "missing-authoritative-move-episode", "missing-current-owner-mapping", "wrong-current-owner", "missing-target-episode", "target-episode-not-normal",
    "target-provider-slot-already-populated",
)


def weak_automatic(source: Column, confidence: Column) -> Column:
    """May a job replace the mapping? Only automatic ones of a whole confidence up to WEAK."""
    whole = (confidence >= 0) & (confidence == F.floor(confidence)) & (confidence <= WEAK)
    return F.coalesce(source.isin("fuzzy", "api") & whole, F.lit(False))


#: Addresses of an episode by provider: host with or without www and port, segments between slashes; what they name.
_SITE, _END = r"^(?i:https?)://(?i:(?:www\.)?{})(?::[0-9]*)?/+", r"/*(?:[?#].*)?$"
ADDRESSES = {
    "tmdb": _SITE.format(r"themoviedb\.org") + r"tv/+([^/?#]+)/+season/+([^/?#]+)/+episode/+([^/?#]+)" + _END,
    "thetvdb": _SITE.format(r"thetvdb\.com") + r"series/+([^/?#]+)/+episodes/+([^/?#]+)" + _END,
}


def with_parent(rows: DataFrame) -> DataFrame:
    """``rows`` (provider, url, provider_id, season, number) with show and in_season: the parent that an episode's address
    names, if all of its parts agree with the row; else nulls. Each address is matched once."""
    c = F.col
    found = [F.when(c("provider") == p, F.regexp_replace("url", pattern, "\n" + "\n".join(f"${i + 1}" for i in range(pattern.count("([^/?#]+)"))))) for p, pattern in ADDRESSES.items()]
    # A row of its own for what is used several times: Spark would match again for each use.
    parts = F.split(F.coalesce(*found), "\n")
    split = rows.withColumn("_parts", parts).withColumn("_named", F.when(F.size("_parts") > 2, F.struct(*[positive_id(F.get("_parts", F.lit(i))).alias(f"p{i}") for i in (1, 2, 3)], positive_id(c("season")).alias("s"))))
    named = split.select(*rows.columns, F.inline(F.array("_named")))
    tmdb = (c("provider") == "tmdb") & (c("p2") == c("s")) & (c("p3") == positive_id(c("number")))
    tvdb = (c("provider") == "thetvdb") & (c("p2") == positive_id(c("provider_id")))
    agrees = F.coalesce((tmdb | tvdb) & c("p1").isNotNull() & c("s").isNotNull(), F.lit(False))
    return named.select(*rows.columns, F.when(agrees, c("p1")).alias("show"), F.when(agrees, c("s")).alias("in_season"))


def orphan_plan(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """One row for each anime_id and provider of orphan episode mappings: reason, parent_id, parent_url, confidence, n.

    ``rows``: anime_id, provider, url, provider_id, season, number, source, confidence. A parent that ``existing``
    (provider, provider_id) holds already, or that several groups ask for, goes to none of them.
    """
    c = F.col
    seen = with_parent(rows).select("anime_id", "provider", "confidence", weak_automatic(c("source"), c("confidence")).alias("weak"), "show", "in_season")
    groups = seen.groupBy("anime_id", "provider").agg(
        F.count("*").alias("n"), F.bool_and("weak").alias("weak"), F.count("show").alias("known"), F.min("show").alias("show"), F.max("show").alias("show2"), F.min("in_season").alias("season"), F.max("in_season").alias("season2"),
        F.least(F.lit(WEAK), F.min("confidence")).cast("int").alias("confidence"),
    )
    clear = first_reason(*zip(ORPHAN_REASONS[:4], (~c("provider").isin(*ADDRESSES), ~c("weak"), c("known") < c("n"), (c("show") != c("show2")) | (c("season") != c("season2"))), strict=True))
    parent = F.concat_ws(":", c("show").cast("string"), c("season").cast("string"))
    planned = staged(groups.select("anime_id", "provider", clear.alias("reason"), F.when(clear.isNull(), parent).alias("parent"), "show", "season", "confidence", "n"), "orphans")
    # Only groups that ask for a parent are joined: the others have none, and would all meet under a null key.
    asking = planned.where("reason IS NULL")
    several = asking.groupBy("provider", "parent").agg(F.count("*").alias("askers")).where("askers > 1").select("provider", "parent")
    gone = several.unionByName(existing.select("provider", F.col("provider_id").alias("parent"))).distinct().withColumn("_gone", F.lit(ORPHAN_REASONS[4]))
    judged = asking.join(gone, ["provider", "parent"], "left").withColumn("reason", c("_gone")).select(*planned.columns)
    out = planned.where("reason IS NOT NULL").unionByName(judged)
    good = c("reason").isNull()
    url = F.when(c("provider") == "tmdb", F.concat(F.lit("https://www.themoviedb.org/tv/"), c("show").cast("string"), F.lit("/season/"), c("season").cast("string")))
    return out.select("anime_id", "provider", "reason", *[F.when(good, x).alias(n) for n, x in (("parent_id", c("parent")), ("parent_url", url), ("confidence", c("confidence")))], "n")


def linear_segments(rows: DataFrame, owner: str, identity: list[str]) -> DataFrame:
    """One row for each owner and identity: reason, ps, pe, ls, le, offset, n.

    ``rows``: owner, identity, local_number, local_count, provider_number, source, confidence. A segment covers 1 to
    local_count and runs in step with the provider's numbers. ``overlapping`` looks at candidates against each other.
    """
    keys, c = [owner, *identity], F.col
    local, provider = positive_id(c("local_number")), positive_id(c("provider_number"))
    seen = rows.select(*keys, local.alias("x"), provider.alias("p"), positive_id(c("local_count")).alias("expected"), weak_automatic(c("source"), c("confidence")).alias("weak"))
    w = Window.partitionBy(*keys).orderBy("x", "p")
    steps = seen.withColumns({"at": F.row_number().over(w), "before": F.lag("p").over(w)})
    a = steps.groupBy(*keys).agg(
        F.bool_and("weak").alias("weak"), F.count("*").alias("n"), F.count("expected").alias("counts"), F.min("expected").alias("expected"), F.max("expected").alias("expected2"),
        F.count("x").alias("nx"), F.count("p").alias("np"), F.size(F.collect_set("x")).alias("dx"), F.size(F.collect_set("p")).alias("dp"), F.min("p").alias("ps"), F.max("p").alias("pe"),
        F.min(F.when(c("x") != c("at"), c("at"))).alias("gap"), F.min(F.when(c("p") != c("before") + 1, c("at"))).alias("jump"),
    )
    no_cover = (c("counts") < c("n")) | (c("expected") != c("expected2")) | (c("n") != c("expected")) | (c("nx") < c("n"))
    reason = F.coalesce(
        F.when(~c("weak"), LINEAR_REASONS[0]), F.when(no_cover, LINEAR_REASONS[1]), F.when(c("np") < c("n"), LINEAR_REASONS[2]), F.when((c("dx") < c("n")) | (c("dp") < c("n")), LINEAR_REASONS[3]),
        F.when(c("gap") <= F.coalesce("jump", "gap"), LINEAR_REASONS[1]), F.when(c("jump").isNotNull(), LINEAR_REASONS[3]),
    )
    good = reason.isNull()
    return a.select(*keys, reason.alias("reason"), *[F.when(good, x).alias(n) for n, x in (("ps", c("ps")), ("pe", c("pe")), ("ls", F.lit(1).cast("long")), ("le", c("n")), ("offset", c("ps") - 1))], "n")


def overlapping(rows: DataFrame, owner: str, identity: list[str]) -> DataFrame:
    """``rows`` (owner, identity, reason, ps, pe): candidates of one identity and different owners that meet are all rejected.

    Only rows without a reason so far take part; rows with one come back as they are.
    """
    keys = [owner, *identity]
    left = staged(rows, "candidates")  # looked at twice
    free = without_overlap(left.where("reason IS NULL"), identity, owner, "ps", "pe").select(*keys, F.lit(True).alias("_free")).distinct()
    joined = left.join(free, keys, "left")
    reason = F.coalesce("reason", F.when(F.col("_free").isNull(), OVERLAP))
    return joined.select(*[F.when(reason.isNull(), F.col(x)).alias(x) if x in ("ps", "pe", "ls", "le", "offset") else reason.alias(x) if x == "reason" else F.col(x) for x in rows.columns])


def aligned_segments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group of ``rows`` (keys, provider_number, local_number, kind): reason, ps, pe, ls, le, n."""
    c = F.col
    bad = ~F.coalesce((positive_id(c("provider_number")) > 0) & (positive_id(c("local_number")) > 0), F.lit(False))
    w = Window.partitionBy(*keys).orderBy("provider_number", "local_number")
    steps = rows.withColumns({"_at": F.row_number().over(w), "_p": F.lag("provider_number").over(w), "_x": F.lag("local_number").over(w), "_bad": bad})
    a = steps.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_or(~c("kind").eqNullSafe("normal")).alias("special"), F.bool_or("_bad").alias("bad"), F.size(F.collect_set("provider_number")).alias("dp"),
        F.size(F.collect_set("local_number")).alias("dx"), F.min(F.when(c("provider_number") != c("_p") + 1, c("_at"))).alias("jump_p"), F.min(F.when(c("local_number") != c("_x") + 1, c("_at"))).alias("jump_x"),
        F.min("provider_number").alias("ps"), F.max("provider_number").alias("pe"), F.min("local_number").alias("ls"), F.max("local_number").alias("le"),
    )
    reason = first_reason(*zip(ALIGNED_REASONS[1:7], (
        c("special"), c("bad"), c("dp") < c("n"), c("dx") < c("n"), c("jump_p") <= F.coalesce("jump_x", "jump_p"), c("jump_x").isNotNull(),
    ), strict=True))
    return a.select(*keys, reason.alias("reason"), *[F.when(reason.isNull(), c(x)).alias(x) for x in ("ps", "pe", "ls", "le")], "n")


def dual_plan(seasons: DataFrame, rows: DataFrame, season: list[str]) -> DataFrame:
    """One row for each of ``seasons`` (season, ownership, owner, orphan): reason and both segments' provider ranges.

    ``rows``: season, anime_id, provider_number, local_number, kind. The segments must lie as the ownership class says.
    """
    segments = aligned_segments(spread(rows, [*season, "anime_id"]), [*season, "anime_id"])
    joined = seasons
    for who in ("owner", "orphan"):
        own = segments.select(*season, F.col("anime_id").alias(who), *[F.col(x).alias(f"{who}_{x}") for x in ("reason", "ps", "pe", "n")])
        joined = joined.join(dealt(own), [*season, who], "left")
    c = F.col
    adjacent = F.coalesce(c("ownership").isin("owner-then-orphan-adjacent", "orphan-then-owner-adjacent"), F.lit(False))
    fault = {who: F.when(c(f"{who}_n").isNull(), ALIGNED_REASONS[0]).otherwise(c(f"{who}_reason")) for who in ("owner", "orphan")}
    first, second = (F.when(c("ownership") == "owner-then-orphan-adjacent", c(a)).otherwise(c(b)) for a, b in (("owner_pe", "orphan_pe"), ("orphan_ps", "owner_ps")))
    reason = F.coalesce(F.when(~adjacent, "not-adjacent-ownership"), fault["owner"], fault["orphan"], F.when(first + 1 != second, "segment-order-mismatch"))
    good = reason.isNull()
    return joined.select(*season, "owner", "orphan", reason.alias("reason"), *[F.when(good, c(x)).alias(x) for x in ("owner_ps", "owner_pe", "orphan_ps", "orphan_pe")])


def _one_to_n(count: Column, distinct: Column, low: Column, high: Column) -> Column:
    return (count == distinct) & ((count == 0) | ((low == 1) & (high == count)))


def whole_season_plan(pairs: DataFrame, episodes: DataFrame, mapped: DataFrame, locals_: DataFrame, season: list[str]) -> DataFrame:
    """One row for each of ``pairs`` (season, target, owner): reason, n_target, n_owner, moves (the numbers that the owner holds).

    ``episodes`` (season, episode_id, number), authoritative; ``mapped`` (season, episode_id, anime_id, local_number, kind), a row an episode;
    ``locals_`` (anime_id, number): normal episodes. The target must own the strict majority, the owner exactly the rest.
    Pairs are sized by title first, and the plan lies by season; ``episodes`` and ``mapped`` that do so already don't move.
    """
    c = F.col
    a = episodes.groupBy(*season).agg(F.count("*").alias("n"), F.size(F.collect_set("number")).alias("dn"), F.size(F.collect_set("episode_id")).alias("di"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    own = spread(locals_, ["anime_id"]).groupBy("anime_id").agg(F.count("*").alias("k"), F.size(F.collect_set("number")).alias("dk"), F.min("number").alias("klo"), F.max("number").alias("khi"))
    target = own.select(F.col("anime_id").alias("target"), "k", "dk", "klo", "khi")
    owner = own.select(F.col("anime_id").alias("owner"), F.col("k").alias("owner_k"))
    held = pairs.join(dealt(episodes), season).join(dealt(mapped.withColumn("_held", F.lit(True))), [*season, "episode_id"], "left")
    mine, theirs = c("anime_id") == c("target"), c("anime_id") == c("owner")
    fault = F.coalesce(
        F.when(c("_held").isNull(), SEASON_REASONS[4]), F.when(~c("kind").eqNullSafe("normal"), SEASON_REASONS[5]),
        F.when(mine, F.when(~c("local_number").eqNullSafe(c("number")), SEASON_REASONS[6])).when(theirs, F.lit(None)).otherwise(SEASON_REASONS[5]),
    )
    per = held.withColumn("_fault", fault).groupBy(*season, "target", "owner").agg(
        F.min(F.when(c("_fault").isNotNull(), F.struct("number", "_fault"))).alias("first"), F.count_if(mine).alias("n_target"), F.count_if(theirs).alias("n_owner"),
        F.array_sort(F.collect_list(F.when(theirs, c("number")))).alias("moves"),
    )
    sized = pairs.join(dealt(target), "target", "left").join(dealt(owner), "owner", "left")
    joined = sized.join(dealt(a), season, "left").join(dealt(per), [*season, "target", "owner"], "left")
    k = F.coalesce("k", F.lit(0))
    reason = F.coalesce(
        F.when(c("n").isNull() | ~_one_to_n(c("n"), c("dn"), c("lo"), c("hi")) | (c("di") < c("n")), SEASON_REASONS[0]), F.when(k != c("n"), SEASON_REASONS[1]),
        F.when(~_one_to_n(k, c("dk"), c("klo"), c("khi")), SEASON_REASONS[2]), F.when(F.coalesce("owner_k", F.lit(0)) == c("n"), SEASON_REASONS[3]), c("first._fault"),
        F.when(c("n_owner") == 0, SEASON_REASONS[7]), F.when(c("n_owner") + c("n_target") != c("n"), SEASON_REASONS[8]), F.when(c("n_target") <= c("n_owner"), SEASON_REASONS[9]),
    )
    good = reason.isNull()
    return joined.select(*season, "target", "owner", reason.alias("reason"), *[F.when(good, c(x)).alias(x) for x in ("n_target", "n_owner", "moves")])


def transfer_plan(moves: DataFrame, episodes: DataFrame, mapped: DataFrame, targets: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(plans, moves): one row a group with ``reason`` and n, and the rows of groups without one. A group moves as a whole or not at all;
    its first failing number decides.

    ``moves`` (group, owner, target, number); ``episodes`` (group, number, episode_id); ``mapped`` (group, episode_id,
    mapping_id, anime_id, from_id); ``targets`` (target, number, to_id, kind, populated), of which a normal one goes before others.
    ``moves``, ``episodes`` and ``mapped`` that lie by group, and ``targets`` that lie by target, don't move for it.
    """
    c = F.col
    best = targets.groupBy("target", "number").agg(F.min_by(F.struct("to_id", "kind", "populated"), F.struct(~c("kind").eqNullSafe("normal"), "to_id")).alias("to"))
    known = moves.join(dealt(episodes.select(*group, "number", "episode_id")), [*group, "number"], "left")
    known = known.join(dealt(mapped.select(*group, "episode_id", "mapping_id", "anime_id", "from_id")), [*group, "episode_id"], "left")
    known = spread(known, ["target"]).join(dealt(best), ["target", "number"], "left")
    fault = first_reason(*zip(TRANSFER_REASONS[1:], (
        c("episode_id").isNull(), c("mapping_id").isNull(), ~c("anime_id").eqNullSafe(c("owner")), c("to").isNull(), ~c("to.kind").eqNullSafe("normal"), F.coalesce(c("to.populated"), F.lit(False)),
    ), strict=True))
    checked = known.withColumn("_fault", fault)
    a = checked.groupBy(*group).agg(F.count("*").alias("n"), F.size(F.collect_set("number")).alias("d"), F.min(F.when(c("_fault").isNotNull(), F.struct("number", "_fault"))).alias("first"))
    plans = a.select(*group, F.coalesce(F.when(c("d") < c("n"), TRANSFER_REASONS[0]), c("first._fault")).alias("reason"), "n")
    rows = checked.join(dealt(plans.where("reason IS NULL").select(*group)), group, "left_semi").select(*group, "mapping_id", "episode_id", "number", "from_id", c("to.to_id").alias("to_id"))
    return plans, rows

