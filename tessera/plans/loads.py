"""Registered queries: tables that change as a whole: verified moves, reports, loads that are checked against their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import backfill, language, moves
from tessera.operators.moves import Moves
from tessera.sources import reports, shared, store

from .catalogue import oracle_sql, queries, query, table

#: Mappings of episodes, a row an order. The text serves Spark and DuckDB.
_MAPPINGS = """SELECT o_orderkey AS mapping_id, o_orderkey * 2 AS episode_id, CASE WHEN o_orderkey % 4 < 2 THEN 'tmdb' ELSE 'thetvdb' END AS provider, CASE WHEN o_custkey % 7 = 0 THEN 'manual' ELSE 'fuzzy' END AS source,
  CAST(o_custkey % 101 AS INT) AS confidence FROM orders"""
#: Every tenth row moves to a free place, the one behind it to the place that is left.
_PLANNED = """SELECT mapping_id, episode_id AS from_id, CASE WHEN mapping_id % 20 = 0 THEN episode_id + 1 ELSE episode_id - 2 END AS to_id, provider FROM m WHERE mapping_id % 20 < 2"""


def _mappings(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_MAPPINGS.replace("FROM orders", "FROM {rows}"), rows=table(spark, d, "orders"))


@query(
    "verified_moves",
    f"""WITH m AS ({_MAPPINGS}) SELECT mapping_id, CASE WHEN mapping_id % 20 = 0 THEN episode_id + 1 WHEN mapping_id % 20 = 1 THEN episode_id - 2 ELSE episode_id END AS episode_id, provider,
        CASE WHEN mapping_id % 20 < 2 THEN 'system' ELSE source END AS source, CASE WHEN mapping_id % 20 < 2 AND confidence < 95 THEN 95 ELSE confidence END AS confidence FROM m""",
)
def verified_moves(spark: SparkSession, d: str) -> DataFrame:
    """A store's table after its moves were carried out, audited and published."""
    m, root = _mappings(spark, d), shared.new_folder(spark, "store")
    store.publish(spark, root, store.latest(spark, root), {"mappings": store.stage(m, root, "mappings")})
    planned = spark.sql(_PLANNED.replace("FROM m", "FROM {m}"), m=m)
    changes = {"source": F.lit("system"), "confidence": F.greatest("confidence", F.lit(95))}
    commit = moves.carry_out(spark, root, {"mappings": Moves(planned, "mapping_id", "episode_id", ("provider",), changes)})
    return store.read(spark, root, "mappings", commit)


_FAULTY = """SELECT mapping_id, CASE WHEN mapping_id % 70 = 0 THEN episode_id + 5 ELSE episode_id END AS from_id, CASE WHEN mapping_id % 6 = 0 THEN episode_id + 1 WHEN mapping_id % 6 = 2 THEN 7 ELSE episode_id - 2 END AS to_id,
  CASE WHEN mapping_id % 50 = 0 THEN 'kitsu' ELSE provider END AS provider FROM m WHERE mapping_id % 2 = 0
  UNION ALL SELECT mapping_id, episode_id, episode_id + 1, provider FROM m WHERE mapping_id % 90 = 0
  UNION ALL SELECT -mapping_id, episode_id, episode_id + 1, provider FROM m WHERE mapping_id % 95 = 0"""


@query(
    "refused_moves",
    f"""WITH m AS ({_MAPPINGS}), v AS ({_FAULTY}), t AS (SELECT to_id, provider, count(*) AS movers FROM v GROUP BY ALL), k AS (SELECT mapping_id, count(*) AS times FROM v GROUP BY ALL),
        s AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.mapping_id = m.mapping_id)),
        f AS (SELECT v.*, CASE WHEN times > 1 THEN 'moved-twice' WHEN m.mapping_id IS NULL THEN 'unknown-row' WHEN m.episode_id <> v.from_id OR m.provider <> v.provider THEN 'not-at-origin' WHEN m.source = 'manual' THEN 'blocked' WHEN movers > 1 THEN 'shared-target'
          WHEN EXISTS (SELECT 1 FROM s WHERE s.episode_id = v.to_id AND s.provider = v.provider) THEN 'occupied-target' END AS fault
          FROM v JOIN k USING (mapping_id) JOIN t ON t.to_id = v.to_id AND t.provider = v.provider LEFT JOIN m ON m.mapping_id = v.mapping_id)
        SELECT mapping_id, from_id, to_id, provider, fault FROM f WHERE fault IS NOT NULL""",
)
def refused_moves(spark: SparkSession, d: str) -> DataFrame:
    """Moves that would be refused, and why."""
    m = _mappings(spark, d)
    return moves.move_faults(m, Moves(spark.sql(_FAULTY.replace("FROM m", "FROM {m}"), m=m), "mapping_id", "episode_id", ("provider",), {}, m.where("source = 'manual'")))


@query("audit_report", oracle_sql()["audit_findings"])
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """The findings of an audit, saved as one JSON document and read from it."""
    path = f"{shared.new_folder(spark, 'report')}/mapping-audit.json"
    reports.save_findings(queries()["audit_findings"](spark, d), path)
    return reports.findings(spark, path)


_TITLES = "SELECT o_orderkey AS anime_id, CASE WHEN o_custkey % 3 = 0 THEN ' jp ' WHEN o_custkey % 3 = 1 THEN 'JP' ELSE 'US' END AS country FROM orders"
_EPISODES = "SELECT l_orderkey AS anime_id, CAST(l_linenumber AS INT) AS number, CASE WHEN l_partkey % 5 > 0 THEN substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) END AS air_date FROM lineitem"
_EARLY, _LATE, _CHANGED = "1994-06-30", "1997-06-30", "o_custkey % 10 = 1"
_HAD = {
    "episode_status": """SELECT o_orderkey AS anime_id, CAST(1 AS INT) AS number, 'ja' AS language, 'audio' AS media, 'available' AS status, 'derived-airdate' AS provider, CAST(75 AS INT) AS confidence FROM orders WHERE o_custkey % 4 = 0
      UNION ALL SELECT o_orderkey, CAST(1 AS INT), 'en', 'audio', 'partial', 'other', CAST(80 AS INT) FROM orders WHERE o_custkey % 5 = 0""",
    "evidence": """SELECT o_orderkey AS anime_id, 'ja' AS language, 'audio' AS media, 'community' AS source, 'community_submission' AS evidence_type, 'http://x' AS source_url, 'available' AS value, CAST(o_custkey % 101 AS INT) AS confidence FROM orders WHERE o_custkey % 6 < 3
      UNION ALL SELECT o_orderkey, 'en', 'subtitle', 'provider', 'provider_subtitle', 'urn:episode-language-status:derived-airdate', 'available', CAST(75 AS INT) FROM orders WHERE o_custkey % 7 = 0""",
    "status": "SELECT o_orderkey AS anime_id, 'ja' AS language, 'audio' AS media, 'confirmed' AS status, CAST(99 AS INT) AS confidence, o_custkey % 9 = 0 AS is_manual_override FROM orders WHERE o_custkey % 8 < 4",
}


@query(
    "language_status",
    f"""WITH t AS (SELECT t.*, CASE WHEN {_CHANGED} THEN '{_LATE}' ELSE '{_EARLY}' END AS today, o_custkey FROM ({_TITLES}) t JOIN orders ON o_orderkey = anime_id),
        f AS (SELECT DISTINCT anime_id FROM ({_EPISODES}) JOIN t USING (anime_id) WHERE upper(trim(country)) = 'JP' AND air_date <= today),
        a AS (SELECT anime_id FROM f UNION SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 0), x AS (SELECT * FROM ({_HAD['status']})),
        n AS (SELECT a.anime_id, CASE WHEN f.anime_id IS NOT NULL AND o_custkey % 6 < 3 THEN greatest(75, o_custkey % 101) WHEN f.anime_id IS NOT NULL THEN 75 WHEN o_custkey % 6 < 3 THEN o_custkey % 101 ELSE 0 END AS best FROM a JOIN orders ON o_orderkey = a.anime_id LEFT JOIN f ON f.anime_id = a.anime_id),
        ja AS (SELECT coalesce(x.anime_id, n.anime_id) AS anime_id, 'ja' AS language, 'audio' AS media, CASE WHEN n.anime_id IS NULL OR x.is_manual_override THEN x.status WHEN best >= 90 THEN 'confirmed' WHEN best >= 65 THEN 'likely' WHEN best >= 40 THEN 'possible' ELSE 'unknown' END AS status,
          CASE WHEN n.anime_id IS NULL OR x.is_manual_override THEN x.confidence ELSE best END AS confidence, coalesce(x.is_manual_override, FALSE) AS is_manual_override FROM x FULL JOIN n ON n.anime_id = x.anime_id)
        SELECT * FROM ja UNION ALL SELECT anime_id, 'en', 'subtitle', 'unknown', 0, FALSE FROM a""",
)
def language_status(spark: SparkSession, d: str) -> DataFrame:
    """A pass over all titles, and a later one over those that changed."""
    orders, lines, root = table(spark, d, "orders"), table(spark, d, "lineitem"), shared.new_folder(spark, "languages")
    made = lambda text, name, rows: spark.sql(text.replace(f"FROM {name}", "FROM {rows}"), rows=rows)
    titles, episodes = made(_TITLES, "orders", orders), made(_EPISODES, "lineitem", lines)
    language.start(spark, root, {name: made(text, "orders", orders) for name, text in _HAD.items()})
    language.refresh(spark, root, episodes, titles, _EARLY)
    changed = orders.where(_CHANGED).select(F.col("o_orderkey").alias("anime_id"))
    return language.table(spark, root, "status", language.refresh(spark, root, episodes, titles, _LATE, changed))


_LEGACY = """SELECT o_orderkey AS id, o_custkey % 40 AS anime_id, CASE o_orderkey % 3 WHEN 0 THEN 'tmdb' WHEN 1 THEN 'thetvdb' ELSE 'kitsu' END AS provider, CAST(o_orderkey % 50 AS VARCHAR(20)) AS provider_id, CASE WHEN o_orderkey % 4 > 0 THEN concat('s', CAST(o_orderkey AS VARCHAR(20))) END AS slug,
  o_orderpriority AS url, CASE WHEN o_custkey % 5 = 0 THEN 'manual' ELSE 'fuzzy' END AS source, CAST(o_custkey % 101 AS INT) AS confidence, o_orderkey % 6 = 0 AS is_primary, CAST(o_orderdate AS TIMESTAMP) AS updated_at FROM orders"""
_OLD_ENTITIES = "SELECT DISTINCT provider, provider_id, 'old' AS slug, 'old' AS url FROM m WHERE provider <> 'kitsu' AND id % 50 % 7 = 0"
_OLD_LINKS = "SELECT DISTINCT anime_id, provider, provider_id, 'old' AS source, CAST(1 AS INT) AS confidence, FALSE AS is_primary FROM m WHERE provider = 'tmdb' AND id % 50 % 7 = 0"
_FIRST = "ORDER BY is_primary DESC, updated_at DESC NULLS LAST, id DESC"
_BACKFILL_SQL = f"""WITH m AS ({_LEGACY}), oe AS ({_OLD_ENTITIES}), ol AS ({_OLD_LINKS}), u AS (SELECT * FROM m WHERE provider <> 'kitsu'),
  pe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, provider_id {_FIRST}) AS r FROM u) x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM oe WHERE oe.provider = x.provider AND oe.provider_id = x.provider_id)),
  pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anime_id, provider, provider_id {_FIRST}) AS r FROM u) x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM ol WHERE ol.anime_id = x.anime_id AND ol.provider = x.provider AND ol.provider_id = x.provider_id))"""


def _backfilled(spark: SparkSession, d: str) -> tuple[str, dict[str, backfill.Load]]:
    m, root = spark.sql(_LEGACY.replace("FROM orders", "FROM {rows}"), rows=table(spark, d, "orders")), shared.new_folder(spark, "backfill")
    old = {name: store.stage(spark.sql(text.replace("FROM m", "FROM {m}"), m=m), root, name) for name, text in (("entities", _OLD_ENTITIES), ("links", _OLD_LINKS))}
    store.publish(spark, root, store.latest(spark, root), old)
    return root, backfill.backfill(spark, root, m)


@query("backfilled_links", _BACKFILL_SQL + " SELECT * FROM ol UNION ALL SELECT anime_id, provider, provider_id, source, confidence, is_primary FROM pl")
def backfilled_links(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, _backfilled(spark, d)[0], "links")


@query("backfilled_entities", _BACKFILL_SQL + " SELECT * FROM oe UNION ALL SELECT provider, provider_id, slug, url FROM pe")
def backfilled_entities(spark: SparkSession, d: str) -> DataFrame:
    return store.read(spark, _backfilled(spark, d)[0], "entities")


@query(
    "backfill_counts",
    _BACKFILL_SQL + """, c AS (SELECT (SELECT count(*) FROM u) AS n, (SELECT count(*) FROM (SELECT DISTINCT provider, provider_id FROM u)) AS ke, (SELECT count(*) FROM (SELECT DISTINCT anime_id, provider, provider_id FROM u)) AS kl, (SELECT count(*) FROM pe) AS e, (SELECT count(*) FROM pl) AS l)
      SELECT unnest(['entities', 'entities', 'entities', 'entities', 'entities', 'links', 'links', 'links', 'links', 'links']) AS "table", unnest(['source', 'keys', 'skipped', 'planned', 'inserted', 'source', 'keys', 'skipped', 'planned', 'inserted']) AS measure,
      unnest([n, ke, ke - e, e, e, n, kl, kl - l, l, l]) AS n FROM c""",
)
def backfill_counts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(backfill.report(_backfilled(spark, d)[1]), "table STRING, measure STRING, n BIGINT")
