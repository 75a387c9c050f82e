"""Registered queries: slug resolution, and planner jobs whose gates are lookups in tables made of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import classify, facts, matching, planning, repair, slugs
from tessera.operators.relational import dealt, spread
from tessera.sources.shared import staged

from . import jobs, lookups, repairs
from .catalogue import oracle_sql, query, table

_made = repairs._made
#: Orphan mappings, a group an order, that name shows by slug; the same text serves Spark and DuckDB.
_SLUGGED = """SELECT o * 100 + i AS mapping_id, o AS anime_id, CASE WHEN o % 17 = 0 THEN 'tmdb' ELSE 'thetvdb' END AS provider,
  concat(CASE WHEN p % 83 = 0 THEN 'http://example.com' ELSE 'https://www.thetvdb.com' END, '/series/', CASE WHEN p % 97 = 0 THEN CAST(k + 1 AS VARCHAR(20)) WHEN p % 97 = 1 THEN '777777' ELSE concat(CASE WHEN p % 2 = 0 THEN 'Show%20' ELSE 'show%20' END, CAST(k AS VARCHAR(20)), CASE WHEN p % 89 = 0 THEN 'x' ELSE '' END) END,
    '/episodes/', CAST(k * 1000 + n + CASE WHEN p % 79 = 0 THEN 1 ELSE 0 END AS VARCHAR(20))) AS url, CAST(k * 1000 + n AS VARCHAR(20)) AS provider_id, CASE WHEN p % 101 = 0 THEN '2' ELSE '1' END AS season, CAST(n AS VARCHAR(20)) AS number,
  CASE WHEN p % 73 = 0 THEN 'manual' ELSE 'fuzzy' END AS source, CAST(s % 86 AS INT) AS confidence, i AS local_number, c AS local_count, k
  FROM (SELECT l_orderkey AS o, l_orderkey % 7000 AS k, l_partkey AS p, l_suppkey AS s, row_number() OVER w AS i, row_number() OVER w + l_orderkey % 9 * 4 + CASE WHEN l_partkey % 71 = 0 THEN 1 ELSE 0 END AS n, count(*) OVER (PARTITION BY l_orderkey) AS c
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""
_SERIES = "SELECT DISTINCT concat(' SHOW ', CAST(k AS VARCHAR(20))) AS slug, CAST(k + 1 AS BIGINT) AS series_id FROM r WHERE k % 37 > 0"
_AUTHORITATIVE = "SELECT DISTINCT CAST(k + 1 AS BIGINT) AS series_id, CAST(1 AS BIGINT) AS season, CAST(provider_id AS BIGINT) AS episode_id, CAST(number AS BIGINT) + CASE WHEN CAST(provider_id AS BIGINT) % 211 = 0 THEN 1 ELSE 0 END AS number FROM r WHERE CAST(provider_id AS BIGINT) % 307 > 0"
_EXISTING = "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'tmdb' ELSE 'thetvdb' END AS provider, concat(CAST(o_custkey % 1500 + 1 AS VARCHAR(20)), ':1') AS provider_id FROM orders"
_SLUG_SQL = f"""r AS MATERIALIZED ({_SLUGGED}), sr AS ({_SERIES}), au AS ({_AUTHORITATIVE}), v AS (SELECT *, replace(split_part(url, '/', 5), '%20', ' ') AS sh, split_part(url, '/', 3) = 'www.thetvdb.com' AND split_part(url, '/', 7) = provider_id AS ok FROM r WHERE provider = 'thetvdb'),
  w AS (SELECT *, CASE WHEN ok AND sh SIMILAR TO '[0-9]+' THEN CAST(sh AS BIGINT) END AS sid, CASE WHEN ok AND NOT sh SIMILAR TO '[0-9]+' THEN sh END AS slug FROM v),
  g AS (SELECT anime_id, count(*) AS n, bool_and(ok AND source = 'fuzzy') AS fine, count(DISTINCT lower(slug)) AS nslug, count(DISTINCT season) AS nseason, count(DISTINCT sid) AS nsid, min(lower(slug)) AS slug, min(sid) AS sid, min(season) AS season, arg_max(slug, mapping_id) AS spelling, least(85, min(confidence)) AS confidence FROM w GROUP BY 1),
  h AS (SELECT g.*, NOT (fine AND nslug = 1 AND nseason = 1 AND nsid <= 1) AS bad, sr.series_id FROM g LEFT JOIN sr ON lower(trim(sr.slug)) = g.slug),
  t AS (SELECT w.anime_id, bool_and(au.number IS NOT NULL AND au.number = CAST(w.number AS BIGINT)) AS there FROM w JOIN h USING (anime_id) LEFT JOIN au ON au.series_id = h.series_id AND au.season = CAST(w.season AS BIGINT) AND au.episode_id = CAST(w.provider_id AS BIGINT) GROUP BY 1),
  z AS (SELECT h.*, CASE WHEN bad THEN 'conflicting-provider-identity' WHEN series_id IS NULL THEN 'tvdb-slug-not-found' WHEN NOT there OR (sid IS NOT NULL AND sid <> series_id) THEN 'tvdb-episode-verification-failed' END AS why, series_id || ':' || season AS ident FROM h JOIN t USING (anime_id))"""


def _slugged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(mappings, resolved groups)."""
    r = staged(_made(spark, d, _SLUGGED, "lineitem"), "slugged")  # its windows are gone through once
    series, episodes = (spark.sql(text.replace("FROM r", "FROM {r}"), r=r) for text in (_SERIES, _AUTHORITATIVE))
    return r, staged(slugs.resolved_slugs(*slugs.slug_groups(r.drop("k")), series, episodes), "resolved")


@query(
    "slug_repairs",
    f"""WITH {_SLUG_SQL}, x AS (SELECT DISTINCT provider_id FROM ({_EXISTING}) WHERE provider = 'thetvdb'), q AS (SELECT *, count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY ident) AS askers FROM z)
        SELECT anime_id, CASE WHEN why IS NULL AND (askers > 1 OR ident IN (SELECT provider_id FROM x)) THEN 'providerIdentityCollision' ELSE why END AS reason, CASE WHEN why IS NULL OR why = 'tvdb-episode-verification-failed' THEN ident END AS provider_id,
        CASE WHEN why IS NULL THEN spelling END AS slug, CASE WHEN why IS NULL THEN 'https://thetvdb.com/series/' || replace(spelling, ' ', '%20') || '/seasons/official/' || season END AS url, CASE WHEN why IS NULL THEN confidence END AS confidence, n FROM q""",
)
def slug_repairs(spark: SparkSession, d: str) -> DataFrame:
    return slugs.without_collisions(_slugged(spark, d)[1], _made(spark, d, _EXISTING, "orders"))


#: Lookups of the jobs over seasons (o_orderkey): target season * 10 + 1, owner season * 10 + 2. {own} is the owner's last digit.
_IDENT = "'tmdb' AS provider, concat(CAST({} AS VARCHAR(20)), ':1') AS provider_id"
_ASSOCIATED = f"""SELECT l_orderkey * 100 + l_linenumber AS association_id, l_orderkey * 10 + CASE l_linenumber WHEN 1 THEN {{own}} WHEN 2 THEN 3 ELSE 3 - {{own}} END AS anime_id, 'tmdb' AS provider, concat(CAST(l_orderkey AS VARCHAR(20)), CASE WHEN l_linenumber = 3 THEN ':2' ELSE ':1' END) AS provider_id
  FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber > 4 THEN 1 ELSE l_linenumber END AS l_linenumber FROM lineitem WHERE l_linenumber IN (1, 5, 6, 7) AND l_partkey % 29 > 0 OR l_linenumber = 2 AND l_partkey % 23 = 0 OR l_linenumber = 3 AND l_partkey % 19 = 0 OR l_linenumber = 4 AND l_partkey % 31 = 0) x"""
_SEGMENTED = "SELECT l_orderkey * 100 + l_linenumber AS association_id FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 13 = 0"
_PARENTS = f"SELECT o_orderkey * 10 + CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 3 = 0 THEN 3 ELSE 2 END AS anime_id, {_IDENT.format('o_orderkey')} FROM orders WHERE o_custkey % 17 > 0"
_FOREIGN = "SELECT l_orderkey * 10 + CASE WHEN l_partkey % 2 = 0 THEN 1 ELSE 2 END AS anime_id, l_orderkey * 100 + 90 AS episode_id FROM lineitem WHERE l_partkey % 37 = 0"
_DESCRIBED = "SELECT o_orderkey * 10 + 1 AS anime_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 12 > 0"


def _facts_sql(own: str, target: str) -> str:
    """Facts by season, by subqueries of their own."""
    return f"""ac AS ({_ASSOCIATED.format(own=own)}), sg AS ({_SEGMENTED}), pa AS ({_PARENTS}), fo AS ({_FOREIGN}), de AS ({_DESCRIBED}), hm AS (SELECT anime_id, episode_id FROM ({repairs._HELD}) UNION ALL SELECT * FROM fo),
      fb AS (SELECT season, {target} AS tg, (SELECT count(*) FROM ac WHERE provider_id = s.season || ':1') AS n_owners, (SELECT count(*) FROM ac WHERE provider_id = s.season || ':1' AND anime_id <> {target}) AS n_others, EXISTS (SELECT 1 FROM ac WHERE provider_id = s.season || ':1' AND anime_id = {target}) AS associated,
        EXISTS (SELECT 1 FROM ac WHERE ac.anime_id = {target}) AS any_, (SELECT count(*) FROM ac JOIN sg USING (association_id) WHERE provider_id = s.season || ':1') AS cut, (SELECT min(anime_id) FROM ac WHERE provider_id = s.season || ':1' AND anime_id <> {target}) AS ow,
        (SELECT min(anime_id) FROM pa WHERE provider_id = s.season || ':1') AS parent, EXISTS (SELECT 1 FROM de WHERE de.anime_id = {target}) AS described FROM (SELECT o_orderkey AS season FROM orders) s),
      out_ AS (SELECT DISTINCT anime_id, anime_id // 10 AS season FROM hm WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.season = anime_id // 10 AND e.episode_id = hm.episode_id)),
      f AS (SELECT fb.*, EXISTS (SELECT 1 FROM out_ WHERE out_.anime_id = tg) AS tout, n_others = 1 AND EXISTS (SELECT 1 FROM out_ WHERE out_.anime_id = ow) AS oout FROM fb)"""


def _facts(spark: SparkSession, d: str, own: str, target: str, scope: Column | bool = False, asked: DataFrame | None = None) -> DataFrame:
    """Facts of all seasons, or of those ``asked`` (season and more columns, which stay)."""
    orders, lines, e = table(spark, d, "orders"), table(spark, d, "lineitem"), repairs._seasons(spark, d)
    asked = orders.selectExpr("o_orderkey AS season") if asked is None else asked
    groups = asked.selectExpr("*", f"{target} AS anime_id", *_IDENT.format("season").replace("'tmdb' AS provider, ", "'tmdb' AS provider|").split("|"))
    from_lines = lambda text: spark.sql(text.replace("FROM lineitem", "FROM {rows}"), rows=lines)
    held = spark.sql(repairs._HELD.replace("FROM e", "FROM {e}"), e=e).select("anime_id", "episode_id")
    mapped = held.unionByName(from_lines(_FOREIGN)).withColumn("provider", F.lit("tmdb"))
    seasons = repairs._seasons(spark, d, provider_id="concat(CAST(season AS STRING), ':1')").select(F.lit("tmdb").alias("provider"), "provider_id", "episode_id")
    described = spark.sql(_DESCRIBED.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}"), o=orders, c=dealt(table(spark, d, "customer")))
    own_sql = own.replace("l_season", "l_orderkey")
    return facts.collision_facts(groups, from_lines(_ASSOCIATED.format(own=own_sql)), from_lines(_SEGMENTED), spark.sql(_PARENTS.replace("FROM orders", "FROM {rows}"), rows=orders), mapped, seasons, described, scope)


def _reasons(frame: DataFrame, key: str, name: str) -> DataFrame:
    return dealt(frame.select(F.col(key).alias("season"), F.col("reason").alias(name)))


_CHECKS_SQL = f"w AS ({oracle_sql()['whole_season_plans']}), v AS ({oracle_sql()['transfer_plans']}), i AS ({oracle_sql()['identity_checks']}), a AS ({oracle_sql()['airdate_checks']})"
_JOINED_SQL = "FROM f JOIN w ON w.season = f.season JOIN i ON i.o_orderkey = f.season JOIN a ON a.o_orderkey = f.season LEFT JOIN v ON v.season = f.season"
_TARGET = "season * 10 + 1"


def _evidenced(spark: SparkSession, d: str) -> DataFrame:
    """Every season with the reasons of the checks of its identity and its air date, written once."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("season"))
    for name, checks in (("identity", jobs.identity_checks), ("airdate", jobs.airdate_checks)):
        rows = rows.join(_reasons(checks(spark, d), "o_orderkey", name), "season")
    return staged(rows, "evidenced")


def _planned(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the reason against a plan for the whole season."""
    plans = repairs._whole_plans(rows, repairs._seasons(spark, d, season="season"), repairs._seasons(spark, d))
    return rows.join(_reasons(plans, "season", "whole"), "season")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """The facts of every season and the reasons of the checks that are made elsewhere, written once."""
    return staged(_planned(spark, d, _facts(spark, d, "2", _TARGET, asked=_evidenced(spark, d))), "checked", as_they_lie=True)


_OWN_REASON = """CASE WHEN n_owners = 0 THEN 'missing-provider-entity' WHEN any_ THEN 'target-provider-association-already-exists' WHEN n_owners <> 1 THEN 'owner-count-not-one' WHEN cut > 0 THEN 'existing-provider-segments' WHEN parent IS NULL THEN 'missing-legacy-parent'
  WHEN parent <> ow THEN 'legacy-parent-owner-mismatch' WHEN tout THEN 'target-provider-scope-mismatch' WHEN oout THEN 'owner-provider-scope-mismatch' WHEN w.reason IS NOT NULL THEN w.reason WHEN NOT described THEN 'missing-target-metadata'
  WHEN i.reason IS NOT NULL THEN i.reason WHEN a.reason IS NOT NULL THEN a.reason WHEN v.reason IS NOT NULL THEN v.reason ELSE 'candidate' END"""


@query("ownership_repair_job", f"WITH {repairs._SEASONS_SQL}, {_facts_sql('2', _TARGET)}, {_CHECKS_SQL} SELECT {_OWN_REASON} AS reason, count(*) AS n {_JOINED_SQL} GROUP BY 1")
def ownership_repair_job(spark: SparkSession, d: str) -> DataFrame:
    """Seasons by the first gate that they fail: facts first, then plans of those in scope, then transfers of what is left."""
    c, kept = F.col, ["season", "described", "identity", "airdate", "reason"]

    def in_scope(rows: DataFrame) -> DataFrame:
        return _facts(spark, d, "2", _TARGET, facts.claimed().isNull(), rows).withColumn("reason", facts.out_of_scope()).select(*kept)

    def supported(rows: DataFrame) -> DataFrame:
        return _planned(spark, d, rows).withColumn("reason", facts.unsupported(c("whole"), c("identity"), c("airdate"))).select("season", "reason")

    def transferable(rows: DataFrame) -> DataFrame:
        e, titled = repairs._seasons(spark, d, season="season"), repairs._seasons(spark, d, target=repairs._TARGET)
        plans = repairs._transfers(e.join(dealt(rows.select("season")), "season", "left_semi"), e, titled)
        return rows.join(_reasons(plans, "season", "reason"), "season", "left")

    return planning.reason_counts(planning.gated_in_turn(_evidenced(spark, d), in_scope, supported, transferable))


_AIR_REASON = """CASE WHEN n_owners = 0 THEN 'missing-provider-entity' WHEN associated THEN 'target-association-already-exists' WHEN n_others <> 1 THEN 'owner-count-not-one' WHEN w.reason IS NOT NULL THEN w.reason WHEN NOT described THEN 'missing-target-metadata'
  WHEN i.reason IS NOT NULL THEN i.reason WHEN a.reason IS NOT NULL THEN a.reason ELSE 'candidate' END"""


@query("season_airdate_reasons", f"WITH {repairs._SEASONS_SQL}, {_facts_sql('2', _TARGET)}, {_CHECKS_SQL} SELECT {_AIR_REASON} AS reason, count(*) AS n {_JOINED_SQL} GROUP BY 1")
def season_airdate_reasons(spark: SparkSession, d: str) -> DataFrame:
    return planning.reason_counts(_checked(spark, d).withColumn("reason", facts.season_airdates(F.col("whole"), F.col("identity"), F.col("airdate"))))


@query(
    "season_airdate_job",
    f"""WITH {repairs._SEASONS_SQL}, {_facts_sql('2', _TARGET)}, {_CHECKS_SQL}, r AS (SELECT n_owners > 0 AND NOT associated AND n_others = 1 AND w.reason IS NULL AS x, described AND i.reason IS NULL AS y, a.reason IS NULL AS z {_JOINED_SQL})
        SELECT 'structurally-safe' AS gate, count(*) FILTER (WHERE x) AS n FROM r UNION ALL SELECT 'identity-verified', count(*) FILTER (WHERE x AND y) FROM r UNION ALL SELECT 'airdate-verified', count(*) FILTER (WHERE x AND y AND z) FROM r""",
)
def season_airdate_job(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    none = F.lit(None).cast("string")
    structural = facts.season_airdates(c("whole"), none, none)
    gates = [("structurally-safe", structural.isNotNull() & ~structural.eqNullSafe("missing-target-metadata")), ("identity-verified", ~c("described") | c("identity").isNotNull()), ("airdate-verified", c("airdate").isNotNull())]
    return planning.passed_counts(_checked(spark, d), gates)


@query(
    "count_mismatch_job",
    f"""WITH {repairs._SEASONS_SQL}, {_facts_sql('2', _TARGET)}, l AS ({repairs._LOCALS}), s AS (SELECT season, count(*) AS n, min(number) AS lo, max(number) AS hi FROM e GROUP BY 1), k AS (SELECT anime_id, count(*) AS k, min(number) AS lo, max(number) AS hi FROM l GROUP BY 1)
        SELECT f.season, s.n AS n_season, coalesce(k.k, 0) AS n_local FROM f JOIN s USING (season) LEFT JOIN k ON k.anime_id = tg
        WHERE n_owners = 1 AND NOT associated AND NOT any_ AND cut = 0 AND parent = ow AND NOT tout AND NOT oout AND s.lo = 1 AND s.hi = s.n AND coalesce(k.k, 0) <> s.n""",
)
def count_mismatch_job(spark: SparkSession, d: str) -> DataFrame:
    """Seasons in scope of which the title has another number of episodes than the provider."""
    e = repairs._seasons(spark, d)
    season = e.groupBy("season").agg(F.count("*").alias("n_season"), F.min("number").alias("lo"), F.max("number").alias("hi")).where("lo = 1 AND hi = n_season")
    own = spark.sql(repairs._LOCALS.replace("FROM e", "FROM {e}"), e=e).groupBy("anime_id").agg(F.count("*").alias("n_local"))
    rows = _facts(spark, d, "2", _TARGET, facts.claimed().isNull()).where(facts.in_scope()).join(dealt(season), "season").join(dealt(own), "anime_id", "left")
    return rows.withColumn("n_local", F.coalesce("n_local", F.lit(0))).where("n_local <> n_season").select("season", "n_season", "n_local")


_ORPHAN, _DUAL_OWN = "season * 10 + 2 - season % 2", "(l_orderkey % 2 + 1)"


@query(
    "dual_segment_job",
    f"""WITH {repairs._SEASONS_SQL}, {_facts_sql(_DUAL_OWN, _ORPHAN)}, p AS ({oracle_sql()['dual_plans']}), r AS (SELECT o_custkey, CASE WHEN n_owners = 0 THEN 'missing-provider-entity' WHEN associated THEN 'orphan-association-already-exists' WHEN n_others <> 1 THEN 'owner-count-not-one' WHEN cut > 0 THEN 'existing-segments-present'
          WHEN p.reason IS NOT NULL THEN p.reason END AS why FROM f JOIN p USING (season) JOIN orders ON o_orderkey = f.season), k AS (SELECT *, count(*) FILTER (WHERE why IS NULL) OVER (PARTITION BY o_custkey) AS n FROM r)
        SELECT coalesce(CASE WHEN why IS NULL AND n > 1 THEN 'multiple-safe-orphans-for-entity' ELSE why END, 'candidate') AS reason, count(*) AS n FROM k GROUP BY 1""",
)
def dual_segment_job(spark: SparkSession, d: str) -> DataFrame:
    rows, split = _made(spark, d, repairs._DUAL, "lineitem"), _made(spark, d, repairs._SPLIT, "orders")
    classes = classify.ownership(spread(rows, ["season"]).join(dealt(split), "season"), ["season", "owner", "orphan"], "provider_number", "anime_id", F.col("orphan"), F.col("owner"))
    seasons = split.join(classes, ["season", "owner", "orphan"], "left")
    plans = repair.dual_plan(seasons, rows, ["season"]).select("season", F.col("reason").alias("plan"))
    known = spread(_facts(spark, d, _DUAL_OWN, _ORPHAN).drop("owner"), ["season"]).join(plans, "season").join(seasons.select("season", "ownership"), "season").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("season"), "o_custkey"), "season")
    return planning.reason_counts(planning.reject_single_use(known.withColumn("reason", facts.dual_segments(F.col("ownership"), F.col("plan"))), ["o_custkey"], "multiple-safe-orphans-for-entity"))


_OWNERS = "SELECT o_orderkey AS association_id, CASE WHEN o_custkey % 5 = 0 THEN o_orderkey ELSE -o_orderkey END AS anime_id, 'thetvdb' AS provider, concat(CAST(o_orderkey % 7000 + 1 AS VARCHAR(20)), ':1') AS provider_id FROM orders WHERE o_custkey % 6 > 0"


@query(
    "collision_segment_job",
    f"""WITH {_SLUG_SQL}, own AS ({_OWNERS}), b AS (SELECT z.anime_id, z.why, z.ident, r.local_number AS x, CAST(r.number AS BIGINT) AS y, r.local_count FROM z JOIN r ON r.anime_id = z.anime_id AND r.provider = 'thetvdb'),
        s AS (SELECT *, lag(y) OVER (PARTITION BY anime_id ORDER BY x, y) AS before FROM b), p AS (SELECT anime_id, min(why) AS why, min(ident) AS ident, count(DISTINCT y) < count(*) OR count(*) FILTER (WHERE y <> before + 1) > 0 AS broken, min(y) AS ps, max(y) AS pe FROM s GROUP BY 1),
        q AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN broken THEN 'non-linear-numbering' WHEN NOT EXISTS (SELECT 1 FROM own WHERE own.provider_id = ident) THEN 'missing-provider-entity' WHEN NOT EXISTS (SELECT 1 FROM own WHERE own.provider_id = ident AND own.anime_id <> p.anime_id) THEN 'provider-entity-has-no-other-owner' END AS reason FROM p)
        SELECT CASE WHEN reason IS NOT NULL THEN reason WHEN EXISTS (SELECT 1 FROM q o WHERE o.reason IS NULL AND o.ident = q.ident AND o.anime_id <> q.anime_id AND o.ps <= q.pe AND q.ps <= o.pe) THEN 'overlapping-candidate-segment' ELSE 'candidate' END AS reason, count(*) AS n FROM q GROUP BY 1""",
)
def collision_segment_job(spark: SparkSession, d: str) -> DataFrame:
    """Slugs are resolved, segments planned for resolved groups, owners looked up, and candidates compared at the end."""
    r, resolved = _slugged(spark, d)
    groups = resolved.select("anime_id", F.lit("thetvdb").alias("provider"), "provider_id", F.col("reason").alias("identity"))
    rows = r.select("anime_id", "local_number", "local_count", F.col("number").alias("provider_number"), "source", "confidence").join(groups.where("identity IS NULL").select("anime_id", "provider_id"), "anime_id")
    plans = repair.linear_segments(rows, "anime_id", ["provider_id"]).withColumnRenamed("reason", "plan")
    none, clear = groups.limit(0), groups.where("identity IS NULL")
    owners = _made(spark, d, _OWNERS, "orders")
    known = facts.collision_facts(clear, owners, none.select(F.lit(0).cast("bigint").alias("association_id")), owners, none.select("anime_id", "provider", F.lit(0).alias("episode_id")), none.select("provider", "provider_id", F.lit(0).alias("episode_id")), none.select("anime_id"), False)
    outcomes = known.join(plans, ["anime_id", "provider_id"], "left").withColumn("reason", facts.collision_segments(F.col("identity"), F.col("plan")))
    outcomes = outcomes.select("anime_id", "provider_id", "reason", "ps", "pe")
    # Groups without an identity have their reason already; most would meet under a null key.
    return planning.reason_counts(repair.overlapping(outcomes, "anime_id", ["provider_id"]).select("reason").unionByName(groups.where("identity IS NOT NULL").select(F.col("identity").alias("reason"))))


@query(
    "season_ownership_job",
    f"""WITH {repairs._SEASONS_SQL}, {_facts_sql('2', _TARGET)}, h AS ({repairs._HELD}), r AS (SELECT e.season, e.number, CASE WHEN h.anime_id IS NULL THEN 'u' WHEN h.anime_id = e.season * 10 + 1 THEN 'o' WHEN h.anime_id = e.season * 10 + 2 THEN 'w' ELSE 'x' END AS who
          FROM e JOIN f ON f.season = e.season AND n_others > 0 LEFT JOIN h ON h.season = e.season AND h.episode_id = e.episode_id),
        s AS (SELECT *, number - row_number() OVER (PARTITION BY season, who ORDER BY number) AS run FROM r),
        a AS (SELECT season, count(*) AS n, count(*) FILTER (WHERE who = 'x') AS nx, count(*) FILTER (WHERE who = 'u') AS nu, count(*) FILTER (WHERE who = 'o') AS no, count(*) FILTER (WHERE who = 'w') AS nw, count(DISTINCT run) FILTER (WHERE who = 'o') AS ro, count(DISTINCT run) FILTER (WHERE who = 'w') AS rw,
          min(number) FILTER (WHERE who = 'o') AS lo, max(number) FILTER (WHERE who = 'o') AS ho, min(number) FILTER (WHERE who = 'w') AS lw, max(number) FILTER (WHERE who = 'w') AS hw FROM s GROUP BY 1)
        SELECT CASE WHEN nx > 0 THEN 'other-anime-involved' WHEN ro = 0 AND rw = 0 THEN 'unmapped-only' WHEN rw = 0 THEN 'orphan-only' WHEN ro = 0 THEN 'owner-only' WHEN ro = 1 AND rw = 1 AND hw + 1 = lo THEN 'owner-then-orphan-adjacent' WHEN ro = 1 AND rw = 1 AND ho + 1 = lw THEN 'orphan-then-owner-adjacent'
          WHEN ro = 1 AND rw = 1 THEN 'owner-orphan-with-gap' ELSE 'fragmented-between-owner-and-orphan' END AS ownership, count(*) AS groups, sum(n)::BIGINT AS authoritative, sum(no)::BIGINT AS orphan_owned, sum(nw)::BIGINT AS owner_owned, sum(nx)::BIGINT AS other_owned, sum(nu)::BIGINT AS unmapped FROM a GROUP BY 1""",
)
def season_ownership_job(spark: SparkSession, d: str) -> DataFrame:
    """Seasons with another owner, by how their episodes are shared."""
    e = repairs._seasons(spark, d)
    held = spark.sql(repairs._HELD.replace("FROM e", "FROM {e}"), e=e).select("season", "episode_id", "anime_id")
    groups = _facts(spark, d, "2", _TARGET).where("n_others > 0").select("season", F.col("anime_id").alias("orphan"), (F.col("season") * 10 + 2).alias("holder"))
    rows = spread(e.select("season", "number", "episode_id").join(held, ["season", "episode_id"], "left"), ["season"]).join(dealt(groups), "season")
    return classify.ownership_summary(rows, ["season"], "number", "anime_id", F.col("orphan"), F.col("holder"))


_COUNT = "CAST(season % 5 + 3 - o_custkey % 3 AS INT)"


@query(
    "merged_transform_job",
    f"""WITH {repairs._SEASONS_SQL}, {_facts_sql('2', _TARGET)}, l AS ({repairs._LOCALS}), s AS (SELECT season, {_COUNT} AS c, count(*) AS n, min(number) AS lo, max(number) AS hi FROM e GROUP BY ALL), k AS (SELECT anime_id, count(*) AS k FROM l GROUP BY 1),
        g AS (SELECT f.season, c, s.lo, s.hi FROM f JOIN s USING (season) LEFT JOIN k ON k.anime_id = tg WHERE n_owners = 1 AND NOT associated AND NOT any_ AND cut = 0 AND parent = ow AND NOT tout AND NOT oout AND coalesce(k.k, 0) <> s.n AND c <> s.n),
        h AS (SELECT g.*, m.local_number AS x, m.episode_id - g.season * 100 AS p FROM g JOIN ({repairs._HELD}) m ON m.season = g.season AND m.anime_id = g.season * 10 + 1),
        a AS (SELECT season, c, lo, hi, min(p - x) AS o, max(p - x) AS o2, min(x) AS lx, max(x) AS hx, count(*) AS n, count(DISTINCT x) AS nx, bool_or(x < 1 OR x > c) AS far FROM h GROUP BY ALL),
        r AS (SELECT *, CASE WHEN far THEN 'invalid-local-episode-number' WHEN nx < n THEN 'duplicate-local-episode-number' WHEN o <> o2 THEN 'non-linear-observed-transform' WHEN o + 1 < lo OR o + c > hi THEN 'inferred-segment-outside-provider-season' END AS reason FROM a)
        SELECT 'reason' AS measure, reason AS value, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL UNION ALL SELECT 'offset', CAST(o AS VARCHAR), count(*) FROM r WHERE reason IS NULL GROUP BY ALL
        UNION ALL SELECT 'boundary', CASE WHEN lx = 1 AND hx = c THEN 'both-boundaries-observed' WHEN lx = 1 THEN 'local-start-observed' WHEN hx = c THEN 'local-end-observed' ELSE 'internal-only' END, count(*) FROM r WHERE reason IS NULL GROUP BY ALL""",
)
def merged_transform_job(spark: SparkSession, d: str) -> DataFrame:
    """Transforms observed of seasons in scope whose title has another count than its metadata says."""
    e = repairs._seasons(spark, d)
    season = e.groupBy("season", "o_custkey").agg(F.count("*").alias("n_season")).selectExpr("season", "n_season", f"{_COUNT} AS count")
    own = spark.sql(repairs._LOCALS.replace("FROM e", "FROM {e}"), e=e).groupBy("anime_id").agg(F.count("*").alias("n_local"))
    rows = _facts(spark, d, "2", _TARGET, facts.claimed().isNull()).where(facts.in_scope()).join(dealt(season), "season").join(dealt(own), "anime_id", "left").withColumn("n_local", F.coalesce("n_local", F.lit(0)))
    mismatch = classify.count_mismatch(F.col("n_season"), F.col("n_local"), F.col("count"))
    chosen = rows.where(mismatch == "local-mismatch-metadata-differs").select("season", "anime_id", "count")
    held = spark.sql(repairs._HELD.replace("FROM e", "FROM {e}"), e=e).select("season", "episode_id", "anime_id", "local_number")
    mapped = held.join(dealt(chosen), ["season", "anime_id"]).select("season", "episode_id", "local_number", "count")
    return planning.transform_report(planning.observed_transform(mapped, e.select("season", "episode_id", "number"), ["season"], "count"))


@query(
    "ambiguous_mapping_job",
    f"""WITH {lookups._MATCHED_SQL}, cand AS (SELECT w.* FROM w WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = w.anime_id AND o_custkey % 4 > 0)), grp AS (SELECT anime_id, count(*) AS n, count(*) FILTER (WHERE match = 'strong-match') AS s, count(*) FILTER (WHERE repair = 'verified-keep') AS k, count(*) FILTER (WHERE repair = 'verified-retire') AS r FROM cand GROUP BY 1)
        SELECT 'verdict' AS measure, CASE WHEN s = 1 THEN 'exactly-one-strong-match' WHEN s > 1 THEN 'multiple-strong-match' ELSE 'no-strong-match' END AS value, count(*) AS n FROM grp GROUP BY ALL UNION ALL SELECT 'repair-safe', CAST(n >= 2 AND k = 1 AND r = n - 1 AS VARCHAR), count(*) FROM grp GROUP BY ALL
        UNION ALL SELECT 'class', match, count(*) FROM cand GROUP BY ALL UNION ALL SELECT 'repair', repair, count(*) FROM cand GROUP BY ALL""",
)
def ambiguous_mapping_job(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of titles that have an identity, by verdict, class and repair status."""
    identities = table(spark, d, "orders").where("o_custkey % 4 > 0").select(F.col("o_orderkey").alias("anime_id"))
    return matching.ambiguity_report(_made(spark, d, lookups._CANDIDATES, "lineitem"), identities, "anime_id")
