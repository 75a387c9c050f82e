"""Registered queries: evidence checks of planner jobs, and their plans for prefixes and suffixes of a season."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evidence, reads

from . import repairs
from .catalogue import query, table

_TITLES = "SELECT o_orderkey, o_custkey % 9 + 3 AS n, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey ELSE o_custkey END % 9 + 3 AS m, o_custkey % 13 AS n_titles, 0.5 + o_custkey % 6 / 10.0 AS similarity FROM orders"


@query(
    "identity_checks",
    f"""WITH t AS ({_TITLES}) SELECT o_orderkey, CASE WHEN n <> m THEN 'target-metadata-count-mismatch' WHEN n_titles = 0 THEN 'provider-title-unavailable' WHEN similarity < 0.72 THEN 'provider-title-mismatch' END AS reason FROM t""",
)
def identity_checks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return repairs._made(spark, d, _TITLES, "orders").select("o_orderkey", evidence.identity_reason(c("n"), c("m"), c("n_titles"), c("similarity")).alias("reason"))


_DATES = """SELECT o_orderkey, CASE WHEN o_custkey % 8 = 0 THEN '1996-02-30' WHEN o_custkey % 9 = 0 THEN NULL ELSE '1996-01-31' END AS start, CASE WHEN o_custkey % 7 = 0 THEN 'soon' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS aired FROM orders"""


@query(
    "airdate_checks",
    f"""WITH t AS ({_DATES}) SELECT o_orderkey, CASE WHEN start IS NULL OR start = '1996-02-30' THEN 'target-start-date-unavailable' WHEN aired = 'soon' THEN 'provider-airdate-unavailable'
        WHEN abs(date_diff('day', CAST('1996-01-31' AS DATE), TRY_CAST(aired AS DATE))) > 180 THEN 'provider-start-date-mismatch' END AS reason FROM t""",
)
def airdate_checks(spark: SparkSession, d: str) -> DataFrame:
    return repairs._made(spark, d, _DATES, "orders").select("o_orderkey", evidence.airdate_reason(F.col("start"), F.col("aired")).alias("reason"))


@query(
    "relation_classes",
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'missing-anime-metadata' WHEN c_custkey % 4 = 0 THEN 'direct-prequel-sequel' WHEN c_custkey % 4 = 1 THEN 'direct-related-other' ELSE 'not-directly-related' END AS relation FROM customer""",
)
def relation_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    kinds = F.when(k % 4 == 0, F.array(F.lit("OTHER"), F.lit(" sequel"))).when(k % 4 == 1, F.array(F.lit("SIDE_STORY"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "customer").select("c_custkey", evidence.relation_evidence(k % 5 > 0, kinds).alias("relation"))


_WRITES = """SELECT o_custkey AS anime_id, CASE o_orderkey % 3 WHEN 0 THEN 'tmdb' WHEN 1 THEN 'thetvdb' ELSE 'kitsu' END AS provider, CASE WHEN o_orderkey % 97 = 0 THEN '  ' ELSE concat(CAST(o_orderkey % 40 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '' END) END AS provider_id,
  o_orderkey % 4 = 0 AS is_primary, o_orderkey AS position, CASE WHEN o_orderkey % 5 > 0 THEN concat(' http://x/', CAST(o_orderkey AS VARCHAR(20))) ELSE '' END AS url FROM orders"""


@query(
    "mapping_faults",
    f"""WITH w AS ({_WRITES}), i AS (SELECT anime_id, provider, trim(provider_id) AS x, count(*) AS n, count(*) FILTER (WHERE is_primary) AS p FROM w GROUP BY ALL)
        SELECT anime_id, provider, CASE WHEN bool_or(x = '') THEN 'blank' WHEN max(n) > 1 THEN 'duplicate' WHEN sum(n) > 1 AND sum(p) <> 1 THEN 'not-one-primary' END AS fault FROM i GROUP BY ALL""",
)
def mapping_faults(spark: SparkSession, d: str) -> DataFrame:
    return evidence.mapping_faults(repairs._made(spark, d, _WRITES, "orders"), ["anime_id"])


@query(
    "authoritative_identities",
    f"""WITH w AS (SELECT *, trim(provider_id) AS x, nullif(trim(url), '') AS u FROM ({_WRITES})), a AS (SELECT anime_id, provider, bool_or(x = '') AS blank, count(DISTINCT x) AS k, max(x) AS x, arg_max({{'u': u}}, position).u AS u FROM w GROUP BY ALL),
        f AS (SELECT *, CASE WHEN blank THEN 'blank-provider-id' WHEN k > 1 THEN 'multiple-identities' END AS fault FROM a)
        SELECT anime_id, provider, CASE WHEN fault IS NULL THEN x END AS provider_id, CASE WHEN fault IS NULL THEN u END AS url, fault FROM f""",
)
def authoritative_identities(spark: SparkSession, d: str) -> DataFrame:
    return evidence.authoritative(repairs._made(spark, d, _WRITES, "orders"), ["anime_id"], "position")


#: Seasons of three to seven episodes: the target claims the first few, the owner and rarely a third hold others.
_CLAIMS = """SELECT o_orderkey AS season, o_orderkey * 10 + 1 AS target, o_orderkey * 10 + 2 AS owner, CAST(CASE WHEN o_custkey % 31 = 0 THEN 0 ELSE o_custkey % 4 + 1 END AS INT) AS n, CAST(CASE WHEN o_custkey % 23 = 0 THEN 1 ELSE 0 END AS INT) AS "offset", o_custkey % 19 > 0 AS local_ok,
  CASE WHEN o_custkey % 29 = 0 THEN 'x' ELSE '1996-01-31' END AS start_date, CASE WHEN o_custkey % 37 = 0 THEN '' ELSE '1996-08-01' END AS end_date FROM orders"""
_AIRED = "CASE WHEN (episode_id + o_custkey) % 59 = 0 THEN NULL WHEN (episode_id + o_custkey) % 61 = 0 THEN '1999-01-01' ELSE concat('1996-0', CAST(number AS VARCHAR(20)), '-15') END"
_HOLDERS = "SELECT season, number, season * 10 + CASE WHEN (episode_id * 7 + o_custkey) % 41 = 0 THEN 3 WHEN (episode_id + o_custkey) % 4 = 0 THEN 2 ELSE 1 END AS anime_id FROM e WHERE (episode_id * 3 + o_custkey) % 43 > 0 AND (number <= o_custkey % 4 + 1 OR o_custkey % 47 = 0)"


@query(
    "prefix_plans",
    f"""WITH {repairs._SEASONS_SQL}, t AS ({_CLAIMS}), x AS (SELECT e.*, {_AIRED} AS aired FROM e), h AS ({_HOLDERS}),
    a AS (SELECT season, count(*) AS m, min(number) AS lo, max(number) AS hi, count(DISTINCT number) AS dm FROM e GROUP BY 1), p AS (SELECT season, count(*) AS pairs FROM h WHERE anime_id % 10 = 1 GROUP BY 1),
    o AS (SELECT t.season, count(h.number) AS k, count(*) FILTER (WHERE h.number > t.n) AS far FROM t LEFT JOIN h ON h.season = t.season AND anime_id % 10 = 1 GROUP BY 1),
    g AS (SELECT t.season, x.number, CASE WHEN h.season IS NULL THEN 'missing-prefix-provider-episode-unmapped' WHEN h.anime_id % 10 = 3 THEN 'missing-prefix-owned-by-other-anime' END AS fault
      FROM t JOIN x ON x.season = t.season AND x.number <= t.n LEFT JOIN h ON h.season = t.season AND h.number = x.number WHERE NOT coalesce(h.anime_id % 10 = 1, FALSE)),
    b AS (SELECT season, arg_min(fault, number) FILTER (WHERE fault IS NOT NULL) AS fault, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS missing FROM g GROUP BY 1),
    f AS (SELECT t.season, target, b.missing, CASE WHEN n <= 0 THEN 'metadata-count-unavailable' WHEN a.lo <> 1 OR dm <> m OR hi <> m THEN 'authoritative-season-not-contiguous' WHEN m <= n THEN 'provider-season-not-larger-than-target' WHEN NOT local_ok THEN 'target-local-coverage-mismatch'
      WHEN "offset" <> 0 OR o.far > 0 THEN 'target-transform-not-zero-prefix' WHEN o.k * 2 <= n THEN 'target-not-strict-majority' WHEN b.fault IS NOT NULL THEN b.fault WHEN start_date = 'x' THEN 'target-start-date-unavailable' WHEN end_date = '' THEN 'target-end-date-unavailable'
      WHEN y.aired IS NULL OR z.aired IS NULL THEN 'provider-prefix-boundary-airdate-unavailable' WHEN y.aired > '1997' THEN 'provider-prefix-start-date-mismatch' WHEN z.aired > '1997' OR abs(date_diff('day', DATE '1996-08-01', CAST(z.aired AS DATE))) > 180 THEN 'provider-prefix-end-date-mismatch' END AS reason
      FROM t JOIN a ON a.season = t.season JOIN o ON o.season = t.season LEFT JOIN b ON b.season = t.season LEFT JOIN x y ON y.season = t.season AND y.number = 1 LEFT JOIN x z ON z.season = t.season AND z.number = t.n)
    SELECT season, target, reason, CASE WHEN reason IS NULL THEN coalesce(missing, '') END AS missing FROM f""",
)
def prefix_plans(spark: SparkSession, d: str) -> DataFrame:
    e = repairs._seasons(spark, d)
    owned = spark.sql(_HOLDERS.replace("FROM e", "FROM {e}"), e=e).withColumn("number", F.col("number").cast("int"))
    claims = spark.sql(_CLAIMS.replace("FROM orders", "FROM {rows}").replace('"offset"', "`offset`"), rows=table(spark, d, "orders"))
    pairs = owned.groupBy("season", F.col("anime_id").alias("target")).agg(F.count("*").alias("pairs"))
    targets = claims.join(pairs, ["season", "target"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    episodes = spark.sql(f"SELECT season, number, {_AIRED} AS air_date FROM {{e}}", e=e)
    plan = evidence.prefix_evidence(targets, episodes, owned, ["season"])
    return plan.withColumn("missing", F.array_join("missing", ","))


_BEHIND = "SELECT o_orderkey AS season, CAST(o_custkey % 4 + 1 AS INT) AS prefix_end, o_orderkey * 10 + 2 AS owner FROM orders"
_MAPPED = """SELECT season, number, season * 10 + CASE WHEN (episode_id * 7 + o_custkey) % 29 = 0 THEN 3 ELSE 2 END AS anime_id, number - o_custkey % 4 - 1 + CASE WHEN (episode_id + o_custkey) % 37 = 0 THEN 1 ELSE 0 END AS local_number,
  CASE WHEN (episode_id + o_custkey) % 31 = 0 THEN 'special' ELSE 'normal' END AS kind FROM e WHERE (episode_id * 3 + o_custkey) % 43 > 0"""
#: Three candidates a season, of which the second is the owner's; counts and dates fit for some.
_KIN = """SELECT o_orderkey AS season, o_orderkey * 10 + i AS anime_id, CAST(o_orderkey % 5 + 2 - o_custkey % 4 - CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN (o_custkey + i) % 5 = 0 THEN 1 ELSE 0 END AS INT) AS episode_count, (o_custkey + i) % 7 = 0 AS short,
  CASE WHEN (o_custkey + i) % 11 = 0 THEN 'x' ELSE '1996-03-31' END AS start_date, CASE WHEN (o_custkey + i) % 6 = 0 THEN '1999-01-01' ELSE '1996-06-30' END AS end_date, (o_orderkey + i) % 3 > 0 AS related FROM orders"""


@query(
    "suffix_plans",
    f"""WITH {repairs._SEASONS_SQL}, t AS ({_BEHIND}), m AS ({_MAPPED}), x AS (SELECT e.*, {_AIRED} AS aired FROM e), c AS (SELECT * FROM ({_KIN.replace("FROM orders", "FROM orders, (VALUES (1), (2), (3)) v(i)")})),
    a AS (SELECT season, count(*) AS m, min(number) AS lo FROM e GROUP BY 1), s AS (SELECT t.*, CASE WHEN a.lo = 1 AND prefix_end < m THEN prefix_end + 1 END AS ss, CASE WHEN a.lo = 1 AND prefix_end < m THEN m END AS se FROM t JOIN a USING (season)),
    h AS (SELECT s.season, count(*) AS n, count(DISTINCT anime_id) AS k, min(anime_id) AS one, bool_and(kind = 'normal' AND local_number = number - ss + 1) AS step FROM s JOIN m ON m.season = s.season AND number BETWEEN ss AND se GROUP BY 1),
    f AS (SELECT c.* FROM c JOIN s USING (season) JOIN x y ON y.season = s.season AND y.number = ss JOIN x z ON z.season = s.season AND z.number = se
      WHERE c.episode_count = se - ss + 1 AND NOT short AND start_date <> 'x' AND y.aired < '1997' AND abs(date_diff('day', CAST(y.aired AS DATE), DATE '1996-03-31')) <= 180 AND abs(date_diff('day', CAST(z.aired AS DATE), CAST(end_date AS DATE))) <= 180),
    g AS (SELECT season, count(*) FILTER (WHERE related) AS n, min(anime_id) FILTER (WHERE related) AS kin, bool_or(anime_id % 10 = 2) AS own FROM f GROUP BY 1)
    SELECT s.season, ss AS suffix_start, se AS suffix_end, coalesce(h.n, 0) AS n_mapped, CASE WHEN h.n = se - ss + 1 AND h.k = 1 AND step AND EXISTS (SELECT 1 FROM f WHERE f.season = s.season AND f.anime_id = h.one) THEN h.one END AS exact,
    CASE WHEN g.n = 1 THEN kin END AS related, coalesce(own, FALSE) AS owner_fits FROM s LEFT JOIN h ON h.season = s.season LEFT JOIN g ON g.season = s.season""",
)
def suffix_plans(spark: SparkSession, d: str) -> DataFrame:
    e, orders = repairs._seasons(spark, d), table(spark, d, "orders")
    mapped = spark.sql(_MAPPED.replace("FROM e", "FROM {e}"), e=e)
    kin = spark.sql(_KIN.replace("FROM orders", "FROM {rows}"), rows=orders.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))))
    locals_ = F.when(F.col("episode_count") > 0, F.sequence(F.when(F.col("short"), 2).otherwise(1), F.greatest("episode_count", F.lit(2)))).otherwise(F.array().cast("array<int>"))
    locals_ = F.when((F.col("episode_count") == 1) & ~F.col("short"), F.array(F.lit(1))).otherwise(locals_)
    episodes = spark.sql(f"SELECT season, number, {_AIRED} AS air_date FROM {{e}}", e=e)
    return evidence.suffix_evidence(spark.sql(_BEHIND.replace("FROM orders", "FROM {rows}"), rows=orders), episodes, mapped, kin.withColumn("locals", locals_), ["season"])


@query("mapping_coverage", "SELECT o_orderpriority AS value, count(*) AS groups, count(*) AS \"rows\" FROM orders GROUP BY 1")
def mapping_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reads.histogram(table(spark, d, "orders"), F.col("o_orderpriority"))
