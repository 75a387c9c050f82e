"""Further registered queries: the mapping audit, scores, planner gates, transforms, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import planning, scoring

from . import audit
from .catalogue import query, table

_PROVIDER = "CASE {} % 4 WHEN 0 THEN 'kitsu' WHEN 1 THEN 'thetvdb' WHEN 2 THEN 'tmdb' ELSE 'anilist' END"
_SOURCE = "CASE {} % 5 WHEN 0 THEN 'fuzzy' WHEN 1 THEN 'manual' ELSE 'api' END"
#: Mapping tables made of the test tables; the same text serves Spark and DuckDB.
_TITLES = f"""SELECT o_orderkey AS id, o_custkey AS anime_id, {_PROVIDER.format('o_orderkey')} AS provider,
  CASE WHEN o_orderkey % 50 = 0 THEN concat(' ', CAST(o_orderkey AS VARCHAR(20))) WHEN o_orderkey % 51 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_orderkey AS VARCHAR(20)), ':1') ELSE CAST(o_orderkey AS VARCHAR(20)) END AS provider_id,
  {_SOURCE.format('o_orderkey')} AS source, CAST(o_orderkey % 106 - 2 AS INT) AS confidence, o_orderkey % 2 = 0 AS is_primary FROM orders"""
_EPISODES = "SELECT p_partkey AS id, p_partkey % 1500 + 1 AS anime_id, p_size AS number FROM part"
_ITEMS = f"""SELECT p_partkey AS id, p_partkey + 3 AS episode_id, {_PROVIDER.format('p_size')} AS provider, CAST(p_partkey AS VARCHAR(20)) AS provider_id,
  CASE WHEN p_partkey % 9 = 0 THEN 'special' ELSE CAST(p_size AS VARCHAR(20)) END AS provider_episode_number, {_SOURCE.format('p_partkey')} AS source, CAST(p_partkey % 101 AS INT) AS confidence FROM part"""
_SEGMENTS = f"SELECT c_custkey AS anime_id, {_PROVIDER.format('c_custkey')} AS provider, 1 AS ps, 60 AS pe, 1 AS ls, 60 AS le FROM customer"


@query(
    "mapping_audit",
    rf"""WITH t AS ({_TITLES}), e AS ({_EPISODES}), m AS ({_ITEMS}), s AS ({_SEGMENTS}),
    p AS (SELECT m.*, e.anime_id, e.number, CASE WHEN regexp_full_match(provider_episode_number, '[1-9][0-9]*') THEN CAST(provider_episode_number AS INT) END AS given FROM m JOIN e ON e.id = m.episode_id),
    g AS (SELECT anime_id, provider, count(*) AS n, count(*) FILTER (WHERE is_primary) AS p FROM t GROUP BY ALL HAVING count(*) > 1),
    f AS (SELECT 'anime-provider-id-not-canonical' AS code, 'error' AS severity, 'anime' AS kind, id, provider FROM t WHERE trim(provider_id) = '' OR provider_id <> trim(provider_id)
    UNION ALL SELECT 'episode-provider-id-not-canonical', 'error', 'episode', id, provider FROM m WHERE trim(provider_id) = '' OR provider_id <> trim(provider_id)
    UNION ALL SELECT 'multiple-primary-anime-mappings', 'error', 'group', anime_id, provider FROM g WHERE p > 1
    UNION ALL SELECT 'ambiguous-multi-mapping-provider', 'error', 'group', anime_id, provider FROM g WHERE p <> 1
    UNION ALL SELECT 'episode-mapping-without-anime-provider', 'error', 'episode', id, provider FROM p
      WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.anime_id = p.anime_id AND t.provider = p.provider)
      AND NOT EXISTS (SELECT 1 FROM s WHERE s.anime_id = p.anime_id AND s.provider = p.provider AND given BETWEEN ps AND pe AND number BETWEEN ls AND le AND number = ls + given - ps)
    UNION ALL SELECT 'mapping-confidence-out-of-range', 'error', 'anime', id, provider FROM t WHERE confidence < 0 OR confidence > 100
    UNION ALL SELECT 'mapping-confidence-out-of-range', 'error', 'episode', id, provider FROM m WHERE confidence < 0 OR confidence > 100
    UNION ALL SELECT 'overconfident-fuzzy-mapping', 'warning', 'anime', id, provider FROM t WHERE source = 'fuzzy' AND confidence >= 100
    UNION ALL SELECT 'overconfident-fuzzy-mapping', 'warning', 'episode', id, provider FROM m WHERE source = 'fuzzy' AND confidence >= 100
    UNION ALL SELECT 'kitsu-episode-provenance-stronger-than-parent', 'error', 'episode', p.id, p.provider FROM p JOIN t ON t.anime_id = p.anime_id AND t.provider = 'kitsu'
      WHERE p.provider = 'kitsu' AND t.source = 'fuzzy' AND (p.source <> 'fuzzy' OR p.confidence > t.confidence)
    UNION ALL SELECT 'malformed-season-provider-id', 'warning', 'anime', id, provider FROM t WHERE provider IN ('thetvdb', 'tmdb') AND NOT regexp_full_match(provider_id, '[1-9][0-9]*:[1-9][0-9]*')
    UNION ALL SELECT 'legacy-heuristic-source-labelled-api', 'warning', 'anime', id, provider FROM t WHERE provider IN ('thetvdb', 'tmdb') AND source = 'api' AND confidence = 85),
    r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY kind, id, provider) AS i FROM f)
    SELECT code, severity, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i <= 20) AS samples FROM r GROUP BY ALL""",
)
def mapping_audit(spark: SparkSession, d: str) -> DataFrame:
    v = {n: table(spark, d, n) for n in ("orders", "part", "customer")}
    parts = [(_TITLES, "orders"), (_EPISODES, "part"), (_ITEMS, "part"), (_SEGMENTS, "customer")]
    return audit.findings(*[spark.sql(text.replace(f"FROM {name}", "FROM {rows}"), rows=v[name]) for text, name in parts])


@query(
    "batch_scores",
    """WITH b AS (SELECT l_suppkey % 3 + 1 AS target, l_orderkey AS batch, l_linenumber AS number, l_linenumber + CASE WHEN l_orderkey % 6 = 0 THEN 1 ELSE 0 END AS said, l_shipdate::DATE::VARCHAR AS air_date FROM lineitem),
    k AS (SELECT s_suppkey AS target, unnest(range(1, 4)) AS number FROM supplier),
    a AS (SELECT target, batch, count(*) AS n, count(DISTINCT number) AS nd, count(*) FILTER (WHERE number BETWEEN 1 AND CASE WHEN target % 3 = 0 THEN 4 ELSE 3 END) AS fits, count(*) >= 3 AND count(*) FILTER (WHERE said <> number) > count(*) FILTER (WHERE said = number) AS contrary,
      CAST(substr(min(air_date), 1, 4) AS INT) AS y, CASE WHEN target % 3 = 0 THEN 4 END AS c FROM b GROUP BY target, batch),
    s AS (SELECT *, coalesce(c, 3) AS k FROM a)
    SELECT target, batch, CASE WHEN nd < n OR fits < greatest(1, ceil(least(k, n) * 0.75)) OR (c IS NOT NULL AND n / c NOT BETWEEN 0.5 AND 1.75) OR abs(y - 1996) > 1 OR contrary THEN NULL
      ELSE greatest(0, 30 - 4 * abs(n - k)) + CASE WHEN y = 1996 THEN 20 ELSE 8 END + n END AS score FROM s""",
)
def batch_scores(spark: SparkSession, d: str) -> DataFrame:
    lines, suppliers = table(spark, d, "lineitem"), table(spark, d, "supplier")
    title = F.concat(F.lit("Episode "), (F.col("l_linenumber") + F.when(F.col("l_orderkey") % 6 == 0, 1).otherwise(0)).cast("string"), F.lit(": part"))
    batches = lines.select((F.col("l_suppkey") % 3 + 1).alias("target"), F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("number"), title.alias("title"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("air_date"))
    known = suppliers.select(F.col("s_suppkey").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number"), F.lit(None).cast("string").alias("air_date"))
    contexts = suppliers.select(F.col("s_suppkey").alias("target"), F.lit(1996).alias("season_year"), F.when(F.col("s_suppkey") % 3 == 0, 4).alias("episode_count"))
    return scoring.batch_scores(batches, known, contexts, "target", "batch")


@query(
    "season_scores",
    """SELECT o_orderkey, CAST(CASE abs(year(o_orderdate) - 1995) WHEN 0 THEN 60 WHEN 1 THEN 30 ELSE -20 * abs(year(o_orderdate) - 1995) END
       + CASE WHEN o_custkey % 30 = 0 THEN 0 ELSE greatest(0, 40 - 5 * abs(o_custkey % 30 - 12)) END AS INT) AS score FROM orders""",
)
def season_scores(spark: SparkSession, d: str) -> DataFrame:
    score = scoring.season_score(F.year("o_orderdate"), F.lit(1995), F.col("o_custkey") % 30, F.lit(12))
    return table(spark, d, "orders").select("o_orderkey", score.alias("score"))


def _gates() -> list:
    c = F.col
    return [("finished", c("o_orderstatus") == "F"), ("cheap", c("o_totalprice") < 50_000), ("not-urgent", ~c("o_orderpriority").startswith("1"))]


_REASON = "CASE WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_orderpriority NOT LIKE '1%' THEN 'not-urgent' END"


@query(
    "planner_reasons",
    f"""WITH g AS (SELECT *, {_REASON} AS r FROM orders), n AS (SELECT *, count(*) FILTER (WHERE r IS NULL) OVER (PARTITION BY o_custkey) AS k FROM g)
        SELECT coalesce(CASE WHEN r IS NULL AND k > 1 THEN 'multiple-candidates' ELSE r END, 'candidate') AS reason, count(*) AS n FROM n GROUP BY 1""",
)
def planner_reasons(spark: SparkSession, d: str) -> DataFrame:
    return planning.reason_counts(planning.reject_single_use(planning.gated(table(spark, d, "orders"), _gates()), ["o_custkey"], "multiple-candidates"))


@query(
    "planner_passed",
    """SELECT 'finished' AS gate, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n FROM orders
       UNION ALL SELECT 'cheap', count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice >= 50000) FROM orders
       UNION ALL SELECT 'not-urgent', count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice >= 50000 AND o_orderpriority LIKE '1%') FROM orders""",
)
def planner_passed(spark: SparkSession, d: str) -> DataFrame:
    return planning.passed_counts(table(spark, d, "orders"), _gates())


@query(
    "observed_transforms",
    """WITH m AS (SELECT l_orderkey AS k, l_linenumber AS l, CASE WHEN l_partkey % 97 = 0 THEN 99 ELSE l_linenumber + l_orderkey % 5 + CASE WHEN l_partkey % 40 = 0 THEN 1 ELSE 0 END END AS p,
         0 AS z FROM lineitem),
       m2 AS (SELECT *, p IN (99, 10) OR p > 12 OR (p = 4 AND k % 7 = 0) AS f FROM m),
       a AS (SELECT k, min(p - l) AS o, max(p - l) AS o2, min(l) AS lo, max(l) AS hi, count(*) AS n, count(DISTINCT p) AS np, count(DISTINCT l) AS nl, min(l) FILTER (WHERE f) AS f1, min(l) FILTER (WHERE l > 6) AS b1 FROM m2 GROUP BY k),
       r AS (SELECT *, CASE WHEN f1 <= coalesce(b1, f1) THEN 'missing-authoritative-provider-episode' WHEN b1 IS NOT NULL THEN 'invalid-local-episode-number' WHEN nl < n THEN 'duplicate-local-episode-number'
         WHEN np < n THEN 'duplicate-provider-episode-number' WHEN o <> o2 THEN 'non-linear-observed-transform'
         WHEN o + 6 > 9 OR (k % 7 = 0 AND o + 1 <= 4) THEN 'inferred-segment-outside-provider-season' END AS reason FROM a)
       SELECT k, reason, CASE WHEN reason IS NULL THEN o END AS "offset", CASE WHEN reason IS NULL THEN o + 1 END AS "first", CASE WHEN reason IS NULL THEN o + 6 END AS "last",
       CASE WHEN reason IS NULL THEN CASE WHEN lo = 1 AND hi = 6 THEN 'both-boundaries-observed' WHEN lo = 1 THEN 'local-start-observed' WHEN hi = 6 THEN 'local-end-observed' ELSE 'internal-only' END END AS boundary FROM r""",
)
def observed_transforms(spark: SparkSession, d: str) -> DataFrame:
    line, key = F.col("l_linenumber"), F.col("l_orderkey")
    shifted = F.when(F.col("l_partkey") % 97 == 0, 99).otherwise(line + key % 5 + F.when(F.col("l_partkey") % 40 == 0, 1).otherwise(0))
    mapped = table(spark, d, "lineitem").select(key.alias("k"), shifted.alias("episode_id"), line.alias("local_number"), F.lit(6).alias("count"))
    # Seasons of 12 numbers at most; each seventh lacks the number 4, and 10 and 11 lie after a hole.
    numbers = F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: ~((i == 4) & (F.col("o_orderkey") % 7 == 0)) & (i != 10))
    seasons = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(numbers).alias("number"))
    return planning.observed_transform(mapped, seasons.withColumn("episode_id", F.col("number")), ["k"], "count")


@query(
    "dual_relations",
    """WITH r AS (SELECT p_partkey, p_size % 7 + 1 AS s1, p_size % 7 + 4 AS e1, p_partkey % 9 + 1 AS s2, p_partkey % 9 + 4 AS e2 FROM part)
       SELECT p_partkey, CASE WHEN s1 = s2 AND e1 = e2 THEN 'same-inferred-segment' WHEN s1 <= e2 AND s2 <= e1 THEN 'overlapping-inferred-segments' WHEN greatest(s1, s2) - least(e1, e2) > 1 THEN 'disjoint-with-gap'
       WHEN least(s1, s2) = 1 AND greatest(e1, e2) = 8 THEN 'exact-provider-partition' ELSE 'adjacent-provider-subset' END AS relation FROM r""",
)
def dual_relations(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_size") % 7 + 1, F.col("p_partkey") % 9 + 1
    return table(spark, d, "part").select("p_partkey", planning.dual_relation(a, a + 3, b, b + 3, F.sequence(F.lit(1), F.lit(8))).alias("relation"))


@query(
    "due_times",
    """WITH u AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS c, max(ts) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY 1)
       SELECT user_id, epoch_us(CASE WHEN c IS NOT NULL AND (f IS NULL OR c >= f) THEN c + INTERVAL 60 MINUTE WHEN f IS NOT NULL THEN f + INTERVAL 15 MINUTE ELSE TIMESTAMP '2024-01-01' END) AS due_us FROM u""",
)
def due_times(spark: SparkSession, d: str) -> DataFrame:
    last = {n: F.max(F.when(F.col("event_type") == kind, F.col("ts").cast("timestamp"))).alias(n) for n, kind in (("c", "purchase"), ("f", "error"))}
    users = table(spark, d, "events").groupBy("user_id").agg(*last.values())
    due = planning.due_at(F.col("c"), F.col("f"), F.lit(60), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return users.select("user_id", F.unix_micros(due).alias("due_us"))
