"""Registered queries: shape of a catalogue, text sources and sinks, JSON updates, decomposed titles, ordered bridges, stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import language, merge, reads, shape
from tessera.operators import relational as rel
from tessera.sources import files, shared

from .catalogue import query, table

_HAS = {"customer": ["c_custkey", "c_name", "c_mktsegment_old"], "orders": ["o_orderkey", "o_custkey"], "invoices": ["i_id"]}
_OLD = ["part", "anime_tags"]


@query(
    "shape_check",
    f"""WITH w AS (SELECT 'table' AS kind, t AS "table", t AS name FROM (SELECT unnest({list(_HAS)}) AS t) UNION ALL SELECT 'column', split_part(x, '.', 1), split_part(x, '.', 2) FROM (SELECT unnest({[f"{t}.{c}" for t, cs in _HAS.items() for c in cs]}) AS x) UNION ALL SELECT 'legacy-table', t, t FROM (SELECT unnest({_OLD}) AS t)),
        i AS (SELECT DISTINCT table_name AS t, column_name AS c FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'part')), h AS (SELECT DISTINCT 'table' AS kind, t AS "table", t AS name FROM i UNION ALL SELECT 'column', t, c FROM i)
        SELECT w.kind, w."table", w.name, CASE WHEN w.kind = 'legacy-table' THEN CASE WHEN h.kind IS NULL THEN 'absent' ELSE 'still-present' END WHEN h.kind IS NULL THEN 'missing' ELSE 'present' END AS state,
          CASE WHEN w.kind = 'legacy-table' THEN h.kind IS NULL ELSE h.kind IS NOT NULL END AS ok FROM w LEFT JOIN h ON h.kind = replace(w.kind, 'legacy-', '') AND h."table" = w."table" AND h.name = w.name
        UNION ALL SELECT h.kind, h."table", h.name, 'extra', TRUE FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE replace(w.kind, 'legacy-', '') = h.kind AND w."table" = h."table" AND w.name = h.name)""",
)
def shape_check(spark: SparkSession, d: str) -> DataFrame:
    """Views of three of the tables against a wanted shape."""
    for t in ("customer", "orders", "part"):
        table(spark, d, t).createOrReplaceTempView(f"shape_check_{t}")
    return shape.shape_report(shape.catalogue(spark, "shape_check_"), shape.wanted_shape(spark, _HAS, _OLD))


@query("id_list", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey > 0 AND (o_orderkey % 7 > 0 OR o_orderkey % 3 > 0)")
def id_list(spark: SparkSession, d: str) -> DataFrame:
    """A list with blanks, words and repeats in it, to which new ids are appended."""
    orders, path = table(spark, d, "orders"), shared.new_folder(spark, "ids")
    key = F.col("o_custkey").cast("string")
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), key)).when(F.col("o_orderkey") % 7 == 1, F.concat(F.lit(" "), key, F.lit("  "))).when(F.col("o_orderkey") % 7 == 2, F.concat(F.lit("-"), key)).otherwise(key)
    orders.select(line.alias("value")).write.text(path)
    files.append_new_ids(spark, path, orders.where("o_orderkey % 7 > 0 OR o_orderkey % 3 > 0").select(F.col("o_custkey").alias("id")))
    return files.id_lines(spark, path)


@query("log_tail", "SELECT event_id, ts_us FROM (SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE event_id % 50 > 0 ORDER BY ts DESC, event_id DESC LIMIT 500)")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last events of a log that was appended to twice and has lines that are too long."""
    path = shared.new_folder(spark, "log")
    events = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.when(F.col("event_id") % 50 == 0, F.repeat(F.lit("x"), 20_000)).alias("note"))
    for part in (0, 1):
        files.append_log(events.where(F.col("event_id") % 2 == part), path)
    return files.log_tail(spark, path, "event_id BIGINT, ts_us BIGINT", "ts_us", 500)


@query("cached_ids", "SELECT o_custkey AS id, max(o_orderkey) * 1000 AS at_ms FROM orders WHERE o_custkey % 5 > 0 GROUP BY 1")
def cached_ids(spark: SparkSession, d: str) -> DataFrame:
    """The latest stamp of each id of a cache, bad lines left out."""
    path, o = shared.new_folder(spark, "cache"), table(spark, d, "orders")
    stamp = F.when(F.col("o_custkey") % 5 == 0, "soon").otherwise((F.col("o_orderkey") * 1000).cast("string"))
    o.select(F.concat_ws("\t", F.col("o_custkey").cast("string"), stamp).alias("value")).write.text(path)
    return files.timed_cache(spark, path).groupBy("id").agg(F.max(F.unix_millis("at")).alias("at_ms"))


_RUNS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'running' ELSE 'done' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '[]' ELSE concat('{\"heartbeatAt\":\"old\",\"leaseToken\":\"', CAST(o_custkey AS VARCHAR(20)), '\"}') END AS metadata FROM orders"


@query(
    "heartbeats",
    f"""SELECT id, status, CASE WHEN status = 'running' AND metadata LIKE '{{%' THEN replace(metadata, '"old"', '"2024-01-01T00:00:00Z"') ELSE metadata END AS metadata FROM ({_RUNS})""",
)
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Running leases get a new heartbeat in their metadata."""
    runs = spark.sql(_RUNS.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {rows}"), rows=table(spark, d, "orders"))
    beat = fn.json_set(F.col("metadata"), ["heartbeatAt"], F.lit("2024-01-01T00:00:00Z"))
    return runs.withColumn("metadata", F.when(F.col("status") == "running", beat).otherwise(F.col("metadata")))


#: Endings of titles, and what is left of them.
_ENDINGS = ((" Café É", " cafe e"), (" ﬁne①½", " fine11 2"), (" ＡＢ１", " ab1"), (" ㎏ ª Å", " kg a a"), (" ño — ñ", " no n"))


@query(
    "decomposed_titles",
    f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) || CASE p_partkey % 5 {' '.join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_ENDINGS))} END AS title FROM part""",
)
def decomposed_titles(spark: SparkSession, d: str) -> DataFrame:
    ending = F.coalesce(*[F.when(F.col("p_partkey") % 5 == i, F.lit(a)) for i, (a, _) in enumerate(_ENDINGS)])
    return table(spark, d, "part").select("p_partkey", fn.comparable_title(F.concat("p_name", ending)).alias("title"))


@query(
    "ordered_bridge",
    """WITH b AS (SELECT l_orderkey, s_name, CASE WHEN l_partkey % 3 > 0 THEN l_linenumber END AS rank FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
       SELECT l_orderkey, string_agg(s_name, '|' ORDER BY rank ASC NULLS LAST, s_name) AS suppliers FROM b GROUP BY 1""",
)
def ordered_bridge(spark: SparkSession, d: str) -> DataFrame:
    bridge = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_linenumber")).alias("rank"))
    own = reads.ordered_children(bridge, table(spark, d, "supplier"), "l_orderkey", "s_suppkey", "rank", "s_name")
    return own.select("l_orderkey", F.array_join("children", "|").alias("suppliers"))


_DATED = "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN ' ' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS air_date FROM orders"


@query("aired", f"SELECT o_orderkey, air_date FROM ({_DATED}) WHERE air_date IS NOT NULL AND trim(air_date) <> '' AND air_date <= '1995-06-30'")
def aired(spark: SparkSession, d: str) -> DataFrame:
    return language.aired(spark.sql(_DATED.replace("FROM orders", "FROM {rows}"), rows=table(spark, d, "orders")), "air_date", "1995-06-30")


@query("related_titles", "SELECT DISTINCT a, b FROM (SELECT l_orderkey AS a, l_suppkey AS b FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey FROM lineitem)")
def related_titles(spark: SparkSession, d: str) -> DataFrame:
    """Relations read in both directions."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b"))
    return rel.both_ways(edges, "a", "b").select("a", "b").distinct()


@query(
    "stamped_rows",
    """WITH t AS (SELECT c_custkey AS k, lower(trim(c_name)) AS name, 1 AS written FROM customer WHERE c_custkey % 3 < 2), s AS (SELECT c_custkey AS k, lower(trim(upper(c_name))) AS name FROM customer WHERE c_custkey % 3 > 0)
       SELECT coalesce(s.k, t.k) AS k, coalesce(s.name, t.name) AS name, CASE WHEN s.k IS NULL THEN written ELSE 9 END AS written FROM t FULL JOIN s ON s.k = t.k""",
)
def stamped_rows(spark: SparkSession, d: str) -> DataFrame:
    """An upsert that stamps what it writes."""
    c = table(spark, d, "customer")
    target = c.where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("k"), fn.normal_name(F.col("c_name")).alias("name"), F.lit(1).alias("written"))
    source = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), fn.normal_name(F.upper("c_name")).alias("name"))
    return merge.stamped(target, source, ["k"], "written", F.lit(9))
