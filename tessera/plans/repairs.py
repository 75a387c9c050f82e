"""Registered queries: repair plans over mapping tables that are made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify, repair
from tessera.operators.relational import dealt, spread

from .catalogue import query, table

#: The same text serves Spark and DuckDB.
_ORPHANS = """SELECT l_orderkey AS anime_id, CASE l_orderkey % 3 WHEN 0 THEN 'tmdb' WHEN 1 THEN 'thetvdb' ELSE 'kitsu' END AS provider,
  CASE WHEN l_orderkey % 3 = 0 THEN concat('https://www.themoviedb.org/tv/', CAST(l_orderkey % 5000 + CASE WHEN l_partkey % 30 = 0 THEN 2 ELSE 1 END AS VARCHAR(20)), '/season/', CAST(l_orderkey % 2 + 1 AS VARCHAR(20)), '/episode/', CAST(l_linenumber AS VARCHAR(20)))
    ELSE concat('http://thetvdb.com/series/', CAST(l_orderkey % 7000 + 1 AS VARCHAR(20)), '/episodes/', CAST(l_partkey AS VARCHAR(20))) END AS url,
  CAST(CASE WHEN l_partkey % 41 = 0 THEN 7 ELSE l_partkey END AS VARCHAR(20)) AS provider_id, CAST(l_orderkey % 2 + 1 AS VARCHAR(20)) AS season,
  CAST(CASE WHEN l_partkey % 43 = 0 THEN 9 ELSE l_linenumber END AS VARCHAR(20)) AS number, CASE WHEN l_partkey % 37 = 0 THEN 'manual' ELSE 'fuzzy' END AS source, CAST(l_suppkey % 86 AS INT) AS confidence FROM lineitem"""
_OWNED = "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'tmdb' ELSE 'thetvdb' END AS provider, concat(CAST(o_custkey % 400 + 1 AS VARCHAR(20)), ':1') AS provider_id FROM orders"


def _made(spark: SparkSession, d: str, text: str, name: str) -> DataFrame:
    return spark.sql(text.replace(f"FROM {name}", "FROM {rows}"), rows=table(spark, d, name))


@query(
    "orphan_plans",
    rf"""WITH r AS ({_ORPHANS}), h AS (SELECT DISTINCT * FROM ({_OWNED})),
    e AS (SELECT *, CASE WHEN provider = 'tmdb' AND regexp_full_match(url, 'https?://(www\.)?themoviedb\.org/tv/[1-9][0-9]*/season/[0-9]+/episode/[0-9]+') AND split_part(url, '/', 7) = season AND split_part(url, '/', 9) = number THEN split_part(url, '/', 5) || ':' || season
      WHEN provider = 'thetvdb' AND regexp_full_match(url, 'https?://(www\.)?thetvdb\.com/series/[1-9][0-9]*/episodes/[0-9]+') AND split_part(url, '/', 7) = provider_id THEN split_part(url, '/', 5) || ':' || season END AS parent FROM r),
    g AS (SELECT anime_id, provider, count(*) AS n, bool_and(source IN ('fuzzy', 'api') AND confidence <= 85) AS weak, count(parent) AS k, min(parent) AS parent, max(parent) AS other, min(confidence) AS c FROM e GROUP BY ALL),
    p AS (SELECT *, CASE WHEN provider NOT IN ('tmdb', 'thetvdb') THEN 'unsupportedProvider' WHEN NOT weak THEN 'strongerOrManualEvidence' WHEN k < n THEN 'incompleteParentEvidence' WHEN parent <> other THEN 'conflictingParentEvidence' END AS why FROM g),
    q AS (SELECT *, count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY provider, parent) AS askers, EXISTS (SELECT 1 FROM h WHERE h.provider = p.provider AND h.provider_id = p.parent) AS held FROM p),
    f AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN held OR askers > 1 THEN 'providerIdentityCollision' END AS reason FROM q)
    SELECT anime_id, provider, reason, CASE WHEN reason IS NULL THEN parent END AS parent_id, CASE WHEN reason IS NULL AND provider = 'tmdb' THEN 'https://www.themoviedb.org/tv/' || split_part(parent, ':', 1) || '/season/' || split_part(parent, ':', 2) END AS parent_url,
    CASE WHEN reason IS NULL THEN least(85, c) END AS confidence, n FROM f""",
)
def orphan_plans(spark: SparkSession, d: str) -> DataFrame:
    return repair.orphan_plan(_made(spark, d, _ORPHANS, "lineitem"), _made(spark, d, _OWNED, "orders"))


_LINEAR = """SELECT l_orderkey AS owner, l_orderkey % 500 AS identity, CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber ELSE CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) END AS local_number,
  CASE WHEN l_partkey % 90 = 0 THEN -1 ELSE count(*) OVER (PARTITION BY l_orderkey) END AS local_count,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + l_orderkey % 9 * 6 + CASE WHEN l_partkey % 80 = 0 THEN 1 ELSE 0 END AS provider_number,
  CASE WHEN l_partkey % 70 = 0 THEN 'manual' ELSE 'api' END AS source, CAST(l_suppkey % 86 AS INT) AS confidence FROM lineitem"""


@query(
    "linear_segments",
    f"""WITH r AS ({_LINEAR}), s AS (SELECT *, row_number() OVER w AS place, lag(provider_number) OVER w AS before FROM r WINDOW w AS (PARTITION BY owner, identity ORDER BY local_number, provider_number)),
    a AS (SELECT owner, identity, count(*) AS n, bool_or(source = 'manual') AS strong, bool_or(local_count < 1) AS uncounted, min(local_count) AS c1, max(local_count) AS c2, count(DISTINCT local_number) AS dx, count(DISTINCT provider_number) AS dp,
      min(place) FILTER (WHERE local_number <> place) AS gap, min(place) FILTER (WHERE provider_number <> before + 1) AS jump, min(provider_number) AS ps, max(provider_number) AS pe FROM s GROUP BY ALL),
    p AS (SELECT *, CASE WHEN strong THEN 'stronger-or-manual-evidence' WHEN uncounted OR c1 <> c2 OR n <> c1 THEN 'invalid-local-coverage' WHEN dx < n OR dp < n THEN 'non-linear-numbering'
      WHEN gap IS NOT NULL AND (jump IS NULL OR gap <= jump) THEN 'invalid-local-coverage' WHEN jump IS NOT NULL THEN 'non-linear-numbering' END AS why FROM a),
    f AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN EXISTS (SELECT 1 FROM p b WHERE b.why IS NULL AND b.identity = p.identity AND b.owner <> p.owner AND b.ps <= p.pe AND p.ps <= b.pe) THEN 'overlapping-candidate-segment' END AS reason FROM p)
    SELECT owner, identity, reason, CASE WHEN reason IS NULL THEN ps END AS ps, CASE WHEN reason IS NULL THEN pe END AS pe, CASE WHEN reason IS NULL THEN 1 END AS ls, CASE WHEN reason IS NULL THEN n END AS le,
    CASE WHEN reason IS NULL THEN ps - 1 END AS "offset", n FROM f""",
)
def linear_segments(spark: SparkSession, d: str) -> DataFrame:
    return repair.overlapping(repair.linear_segments(_made(spark, d, _LINEAR, "lineitem"), "owner", ["identity"]), "owner", ["identity"])


_DUAL = """SELECT l_orderkey AS season, CASE WHEN l_linenumber <= l_orderkey % 4 + 1 THEN l_orderkey * 10 + 1 ELSE l_orderkey * 10 + 2 END AS anime_id, l_linenumber AS provider_number,
  CASE WHEN l_linenumber <= l_orderkey % 4 + 1 THEN l_linenumber ELSE l_linenumber - l_orderkey % 4 - 1 END + CASE WHEN l_partkey % 45 = 0 THEN 1 ELSE 0 END AS local_number,
  CASE WHEN l_partkey % 55 = 0 THEN 'special' ELSE 'normal' END AS kind FROM lineitem"""
_SPLIT = "SELECT o_orderkey AS season, o_orderkey * 10 + o_orderkey % 2 + 1 AS owner, o_orderkey * 10 + 2 - o_orderkey % 2 AS orphan FROM orders"


@query(
    "dual_plans",
    f"""WITH r AS ({_DUAL}), s AS (SELECT *, row_number() OVER w AS place, lag(provider_number) OVER w AS bp, lag(local_number) OVER w AS bx FROM r WINDOW w AS (PARTITION BY season, anime_id ORDER BY provider_number, local_number)),
    a AS (SELECT season, anime_id, count(*) AS n, bool_or(kind <> 'normal') AS special, bool_or(local_number < 1) AS bad, count(DISTINCT provider_number) AS dp, count(DISTINCT local_number) AS dx, min(place) FILTER (WHERE provider_number <> bp + 1) AS jp,
      min(place) FILTER (WHERE local_number <> bx + 1) AS jx, min(provider_number) AS ps, max(provider_number) AS pe FROM s GROUP BY ALL),
    g AS (SELECT *, CASE WHEN special THEN 'non-normal-local-episode' WHEN bad THEN 'invalid-episode-number' WHEN dp < n THEN 'duplicate-provider-episode-number' WHEN dx < n THEN 'duplicate-local-episode-number'
      WHEN jp IS NOT NULL AND (jx IS NULL OR jp <= jx) THEN 'non-contiguous-provider-range' WHEN jx IS NOT NULL THEN 'non-contiguous-local-range' END AS why FROM a),
    i AS (SELECT DISTINCT season, anime_id, provider_number - dense_rank() OVER (PARTITION BY season, anime_id ORDER BY provider_number) AS run, min(provider_number) OVER w AS lo, max(provider_number) OVER w AS hi FROM r WINDOW w AS (PARTITION BY season, anime_id)),
    o AS (SELECT season, anime_id, count(*) AS runs, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY ALL),
    t AS (SELECT t.*, w.runs AS wr, w.lo AS wl, w.hi AS wh, p.runs AS pr, p.lo AS pl, p.hi AS ph FROM ({_SPLIT}) t LEFT JOIN o w ON w.season = t.season AND w.anime_id = owner LEFT JOIN o p ON p.season = t.season AND p.anime_id = orphan),
    c AS (SELECT *, wr = 1 AND pr = 1 AND wh + 1 = pl AS first, wr = 1 AND pr = 1 AND ph + 1 = wl AS second FROM t),
    f AS (SELECT c.season, owner, orphan, w.ps AS wps, w.pe AS wpe, p.ps AS pps, p.pe AS ppe, CASE WHEN NOT coalesce(first OR second, FALSE) THEN 'not-adjacent-ownership' WHEN w.why IS NOT NULL THEN w.why WHEN p.why IS NOT NULL THEN p.why END AS reason
      FROM c LEFT JOIN g w ON w.season = c.season AND w.anime_id = owner LEFT JOIN g p ON p.season = c.season AND p.anime_id = orphan)
    SELECT season, owner, orphan, reason, CASE WHEN reason IS NULL THEN wps END AS owner_ps, CASE WHEN reason IS NULL THEN wpe END AS owner_pe, CASE WHEN reason IS NULL THEN pps END AS orphan_ps, CASE WHEN reason IS NULL THEN ppe END AS orphan_pe FROM f""",
)
def dual_plans(spark: SparkSession, d: str) -> DataFrame:
    rows, split = _made(spark, d, _DUAL, "lineitem"), _made(spark, d, _SPLIT, "orders")
    owned = spread(rows, ["season"]).join(dealt(split), "season")
    classes = classify.ownership(owned, ["season", "owner", "orphan"], "provider_number", "anime_id", F.col("orphan"), F.col("owner"))
    return repair.dual_plan(split.join(classes, ["season", "owner", "orphan"], "left"), rows, ["season"])


def _seasons(spark: SparkSession, d: str, **by: str) -> DataFrame:
    """Seasons of three to seven episodes; each 13th lacks its first number.

    With ``by``, a column's name and what it is of a season, orders are dealt out by it before they become several episodes: tables
    made of these lie by it (``shared.staged``)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("season"), "o_custkey")
    o = spread(o.withColumns({name: F.expr(text) for name, text in by.items()}), list(by)) if by else o
    numbers = F.sequence(F.when(F.col("season") % 13 == 0, 2).otherwise(1), (F.col("season") % 5 + 3).cast("int"))
    return o.select(*{"season": 0, "o_custkey": 0, **by}, F.explode(numbers).alias("number")).withColumn("episode_id", F.col("season") * 100 + F.col("number"))


_SEASONS_SQL = "e AS (SELECT season, o_custkey, number, season * 100 + number AS episode_id FROM (SELECT o_orderkey AS season, o_custkey, unnest(range(CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END, o_orderkey % 5 + 4)) AS number FROM orders))"
#: Who holds an episode: mostly the target (season * 10 + 1), sometimes the owner (+ 2), rarely a third or nobody.
_HELD = """SELECT season, episode_id, season * 10 + CASE WHEN (episode_id * 7 + o_custkey) % 61 = 0 THEN 3 WHEN (episode_id + o_custkey) % 4 = 0 THEN 2 ELSE 1 END AS anime_id,
  number + CASE WHEN (episode_id + o_custkey) % 67 = 0 THEN 1 ELSE 0 END AS local_number, CASE WHEN (episode_id + o_custkey) % 71 = 0 THEN 'special' ELSE 'normal' END AS kind, episode_id + 5 AS mapping_id, episode_id + 7 AS from_id
  FROM e WHERE (episode_id * 3 + o_custkey) % 73 > 0"""
_LOCALS = """SELECT season * 10 + 1 AS anime_id, number + CASE WHEN season % 17 = 0 THEN 1 ELSE 0 END AS number FROM e WHERE season % 19 > 0 OR number > 2
  UNION ALL SELECT season * 10 + 2, number FROM e WHERE season % 11 = 0 OR number > 2"""


@query(
    "whole_season_plans",
    f"""WITH {_SEASONS_SQL}, m AS ({_HELD}), l AS ({_LOCALS}), k AS (SELECT anime_id, count(*) AS k, count(DISTINCT number) AS dk, min(number) AS lo, max(number) AS hi FROM l GROUP BY 1),
    a AS (SELECT season, count(*) AS n, count(DISTINCT number) AS dn, min(number) AS lo, max(number) AS hi FROM e GROUP BY 1),
    x AS (SELECT e.season, e.number, m.anime_id, CASE WHEN m.episode_id IS NULL THEN 'unmapped-provider-episodes' WHEN kind <> 'normal' OR anime_id % 10 = 3 THEN 'third-anime-involved' WHEN anime_id % 10 = 1 AND local_number <> number THEN 'target-mapping-number-mismatch' END AS fault
      FROM e LEFT JOIN m ON m.season = e.season AND m.episode_id = e.episode_id),
    p AS (SELECT season, arg_min(fault, number) FILTER (WHERE fault IS NOT NULL) AS fault, count(*) FILTER (WHERE anime_id % 10 = 1) AS nt, count(*) FILTER (WHERE anime_id % 10 = 2) AS nw, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (WHERE anime_id % 10 = 2) AS moves FROM x GROUP BY 1),
    f AS (SELECT a.season, nt, nw, moves, CASE WHEN n <> dn OR a.lo <> 1 OR a.hi <> n THEN 'invalid-authoritative-numbering' WHEN coalesce(t.k, 0) <> n THEN 'target-local-count-mismatch' WHEN t.k <> t.dk OR t.lo <> 1 OR t.hi <> t.k THEN 'target-local-numbering-invalid'
      WHEN coalesce(w.k, 0) = n THEN 'owner-also-full-season-sized' WHEN fault IS NOT NULL THEN fault WHEN nw = 0 THEN 'nothing-to-move' WHEN nt + nw <> n THEN 'owner-does-not-fill-target-gaps' WHEN nt <= nw THEN 'target-not-majority-owner' END AS reason
      FROM a JOIN p ON p.season = a.season LEFT JOIN k t ON t.anime_id = a.season * 10 + 1 LEFT JOIN k w ON w.anime_id = a.season * 10 + 2)
    SELECT season, season * 10 + 1 AS target, season * 10 + 2 AS owner, reason, CASE WHEN reason IS NULL THEN nt END AS n_target, CASE WHEN reason IS NULL THEN nw END AS n_owner, CASE WHEN reason IS NULL THEN moves END AS moves FROM f""",
)
def whole_season_plans(spark: SparkSession, d: str) -> DataFrame:
    e = _seasons(spark, d)
    plan = _whole_plans(e, e, e)
    return plan.withColumn("moves", F.array_join("moves", ","))


def _whole_plans(asked: DataFrame, e: DataFrame, own: DataFrame) -> DataFrame:
    """Plans of the seasons ``asked``, each of which may come several times: by episodes ``e``, and ``own`` ones of titles."""
    mapped, locals_ = (rows.sparkSession.sql(text.replace("FROM e", "FROM {e}"), e=rows) for text, rows in ((_HELD, e), (_LOCALS, own)))
    pairs = asked.select("season").distinct().select("season", (F.col("season") * 10 + 1).alias("target"), (F.col("season") * 10 + 2).alias("owner"))
    return repair.whole_season_plan(pairs, e.select("season", "episode_id", "number"), mapped.select("season", "episode_id", "anime_id", "local_number", "kind"), locals_, ["season"])


@query(
    "transfer_plans",
    f"""WITH {_SEASONS_SQL}, m AS ({_HELD}), v AS (SELECT season, number FROM e WHERE (episode_id + o_custkey) % 3 = 0 UNION ALL SELECT season, 50 FROM e WHERE number = 3 AND season % 29 = 0 UNION ALL SELECT season, number FROM e WHERE number = 3 AND season % 31 = 0),
    t AS (SELECT season, number, CASE WHEN episode_id % 23 = 0 THEN 'special' ELSE 'normal' END AS kind, episode_id % 27 = 0 AS populated FROM e WHERE episode_id % 21 > 0),
    x AS (SELECT v.season, v.number, CASE WHEN e.episode_id IS NULL THEN 'missing-authoritative-move-episode' WHEN m.episode_id IS NULL THEN 'missing-current-owner-mapping' WHEN m.anime_id % 10 <> 2 THEN 'wrong-current-owner' WHEN t.season IS NULL THEN 'missing-target-episode'
      WHEN t.kind <> 'normal' THEN 'target-episode-not-normal' WHEN t.populated THEN 'target-provider-slot-already-populated' END AS fault
      FROM v LEFT JOIN e ON e.season = v.season AND e.number = v.number LEFT JOIN m ON m.season = v.season AND m.episode_id = e.episode_id LEFT JOIN t ON t.season = v.season AND t.number = v.number),
    p AS (SELECT season, count(*) AS n, count(DISTINCT number) AS d, arg_min(fault, number) FILTER (WHERE fault IS NOT NULL) AS fault FROM x GROUP BY 1)
    SELECT season, CASE WHEN d < n THEN 'duplicate-provider-episode-number' ELSE fault END AS reason, n FROM p""",
)
def transfer_plans(spark: SparkSession, d: str) -> DataFrame:
    e = _seasons(spark, d)
    return _transfers(e, e, e.withColumn("target", F.expr(_TARGET)))


_TARGET = "season * 10 + 1"


def _transfers(asked: DataFrame, e: DataFrame, titled: DataFrame) -> DataFrame:
    """Plans of the transfers of the episodes ``asked``: by all episodes ``e``, and ``titled`` ones that have their target."""
    spark = e.sparkSession
    mapped = spark.sql(_HELD.replace("FROM e", "FROM {e}"), e=e)
    moved = """SELECT season, number FROM {e} WHERE (episode_id + o_custkey) % 3 = 0 UNION ALL SELECT season, 50 FROM {e} WHERE number = 3 AND season % 29 = 0 UNION ALL SELECT season, number FROM {e} WHERE number = 3 AND season % 31 = 0"""
    moves = spark.sql(moved, e=asked).withColumns({"owner": F.col("season") * 10 + 2, "target": F.expr(_TARGET)})
    targets = titled.where("episode_id % 21 > 0").select("target", "number", F.col("episode_id").alias("to_id"), F.when(F.col("episode_id") % 23 == 0, "special").otherwise("normal").alias("kind"), (F.col("episode_id") % 27 == 0).alias("populated"))
    return repair.transfer_plan(moves, e.select("season", "number", "episode_id"), mapped.select("season", "episode_id", "mapping_id", "anime_id", "from_id"), targets, ["season"])[0]
