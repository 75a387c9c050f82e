"""Registry of named queries over the test tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import classify, merge, ranges
from tessera.operators import relational as rel
from tessera.streaming import microbatch

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _REGISTRY[name] = (f, sql)
        return f

    return keep


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _REGISTRY.items() if sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "ambiguous_groups",
    """SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_primary,
       string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts
       FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (WHERE l_returnflag = 'R') <> 1""",
)
def ambiguous_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber")
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_primary"), F.array_sort(F.collect_list("l_partkey")).alias("p"))
    return out.where("n > 1 AND n_primary <> 1").select("l_orderkey", "l_linenumber", "n", "n_primary", F.array_join("p", ",").alias("parts"))


@query("orphan_rows", "SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    return rel.without(table(spark, d, "documents"), table(spark, d, "labels"), {"doc_id": "doc_id"}).select("doc_id", "source")


@query("semi_rows", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_rows(spark: SparkSession, d: str) -> DataFrame:
    return rel.having(table(spark, d, "customer"), table(spark, d, "orders").where("o_orderstatus = 'F'"), {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query("scalar_count", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders")
def scalar_count(spark: SparkSession, d: str) -> DataFrame:
    return rel.child_counts(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), {"o_orderkey": "l_orderkey"}, "n_lines")


@query(
    "bridge_dimensions",
    """SELECT r_name, n_name, count(*) AS n_suppliers, count(DISTINCT s_name) AS n_names FROM supplier
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def bridge_dimensions(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_suppliers"), F.countDistinct("s_name").alias("n_names"))


@query(
    "search_any",
    "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%re%' OR p_brand ILIKE '%re%' OR p_type ILIKE '%re%' OR CAST(p_size AS VARCHAR) ILIKE '%re%'",
)
def search_any(spark: SparkSession, d: str) -> DataFrame:
    return rel.search_any(table(spark, d, "part").withColumn("size", F.col("p_size").cast("string")), ["p_name", "p_brand", "p_type", "size"], "re").select("p_partkey", "p_name")


SEGMENTS = [("A", 1, 4, 1, 4), ("R", 3, 7, 1, 5), ("N", 1, 7, 2, 8)]
_SEGMENTS_SQL = "(VALUES " + ", ".join(map(str, SEGMENTS)) + ") s(flag, ps, pe, ls, le)"


def _segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, "l_returnflag STRING, ps INT, pe INT, ls INT, le INT")


@query(
    "affine_range_anti",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM {_SEGMENTS_SQL}
        WHERE flag = l_returnflag AND l_linenumber BETWEEN ps AND pe AND l_suppkey % 7 + 1 BETWEEN ls AND le AND l_suppkey % 7 + 1 = ls + l_linenumber - ps)""",
)
def affine_range_anti(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", (F.col("l_suppkey") % 7 + 1).alias("local"))
    return ranges.outside_segments(points, _segments(spark), ["l_returnflag"], "l_linenumber", "local").select("l_orderkey", "l_linenumber", "l_suppkey")


@query(
    "point_in_range",
    f"""SELECT l_returnflag, l_linenumber, ls + l_linenumber - ps AS local, count(*) AS n FROM lineitem JOIN {_SEGMENTS_SQL}
        ON flag = l_returnflag AND l_linenumber BETWEEN ps AND pe GROUP BY ALL""",
)
def point_in_range(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber")
    return ranges.map_points(points, _segments(spark), ["l_returnflag"], "l_linenumber").groupBy("l_returnflag", "l_linenumber", "local").agg(F.count("*").alias("n"))


@query(
    "distinct_on_priority",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderpriority, o_orderdate DESC, o_orderkey",
)
def distinct_on_priority(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("o_orderpriority"), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return rel.distinct_on(table(spark, d, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey", "o_orderpriority")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").cast("long").alias("score"))


_SCORED_SQL = "s AS (SELECT l_orderkey, l_suppkey, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY ALL)"


@query(
    "clear_winner",
    f"""WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey))
        SELECT l_orderkey, l_suppkey, score FROM r WHERE n = 1 AND (next IS NULL OR score - next >= 10)""",
)
def clear_winner(spark: SparkSession, d: str) -> DataFrame:
    return rel.clear_winner(_scored(spark, d), ["l_orderkey"], "score", [F.col("l_suppkey")], 10)


@query(
    "clear_winner_above",
    f"""WITH {_SCORED_SQL}, r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey))
        SELECT l_orderkey, l_suppkey, score FROM r WHERE n = 1 AND score >= 45 AND (next IS NULL OR next < 45 OR score - next >= 10)""",
)
def clear_winner_above(spark: SparkSession, d: str) -> DataFrame:
    return rel.clear_winner(_scored(spark, d), ["l_orderkey"], "score", [F.col("l_suppkey")], 10, 45)


@query(
    "top_candidates",
    f"""WITH {_SCORED_SQL} SELECT l_orderkey, l_suppkey, score, CAST(n AS INTEGER) AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_suppkey) AS n FROM s) WHERE n <= 3""",
)
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rel.top_k(_scored(spark, d), ["l_orderkey"], [F.col("score").desc(), F.col("l_suppkey")], 3)


@query(
    "islands",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
       g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM r)
       SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last,
       CASE WHEN min(l_linenumber) = max(l_linenumber) THEN CAST(min(l_linenumber) AS VARCHAR) ELSE min(l_linenumber) || '-' || max(l_linenumber) END AS label
       FROM g GROUP BY l_orderkey, k""",
)
def islands(spark: SparkSession, d: str) -> DataFrame:
    return ranges.islands(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query(
    "coverage_gap",
    """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS x, l_linenumber + l_orderkey % 3 * 10 + CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 2 THEN 1 ELSE 0 END AS p
         FROM lineitem),
       a AS (SELECT k, count(*) AS n, count(DISTINCT x) AS nl, count(DISTINCT p) AS np, min(x) AS lo, max(x) AS hi, min(p) AS plo, max(p) AS phi, min(p - x) AS o1, max(p - x) AS o2 FROM r GROUP BY k),
       b AS (SELECT *, CASE WHEN nl < n THEN 'duplicate-local-number' WHEN np < n THEN 'duplicate-provider-number' END AS fault,
         hi - lo + 1 = nl AND phi - plo + 1 = np AND o1 = o2 AS line FROM a)
       SELECT k AS l_orderkey, fault, CASE WHEN fault IS NULL THEN 7 - nl END AS n_missing, CASE WHEN fault IS NULL THEN line END AS linear,
       CASE WHEN fault IS NOT NULL THEN NULL WHEN nl = 7 THEN 'complete' WHEN NOT line THEN 'internal-or-nonlinear' WHEN lo > 1 AND hi < 7 THEN 'both-ends' WHEN lo > 1 THEN 'leading' ELSE 'trailing' END AS gap,
       CASE WHEN fault IS NULL AND line THEN o1 END AS "offset" FROM b""",
)
def coverage_gap(spark: SparkSession, d: str) -> DataFrame:
    shift = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") > 2), 1).otherwise(0)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") + F.col("l_orderkey") % 3 * 10 + shift).alias("p"))
    return ranges.coverage(rows, ["l_orderkey"], "l_linenumber", "p", F.lit(7))


@query(
    "overlap_reject",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate AS s, o_orderdate + INTERVAL 7 DAY AS e FROM orders)
       SELECT o_custkey, o_orderkey FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.o_custkey = b.o_custkey AND a.o_orderpriority <> b.o_orderpriority AND a.s <= b.e AND b.s <= a.e)""",
)
def overlap_reject(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("e"))
    return ranges.without_overlap(rows, ["o_custkey"], "o_orderpriority", "s", "e").select("o_custkey", "o_orderkey")


@query(
    "segment_faults",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linenumber - 1 AS ps, CASE WHEN l_partkey % 11 = 0 THEN l_quantity + 0.5 ELSE l_quantity END AS pe,
       l_suppkey % 4 AS ls, l_suppkey % 9 AS le FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN pe <> floor(pe) THEN 'non-integer' WHEN ps <= 0 OR ls <= 0 THEN 'non-positive-start'
       WHEN pe < ps THEN 'reversed-provider-range' WHEN le < ls THEN 'reversed-local-range' WHEN pe - ps <> le - ls THEN 'unequal-span' END AS fault FROM s""",
)
def segment_faults(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    end = c("l_quantity").cast("double") + F.when(c("l_partkey") % 11 == 0, 0.5).otherwise(0)
    fault = ranges.segment_fault(c("l_linenumber") - 1, end, c("l_suppkey") % 4, c("l_suppkey") % 9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", fault.alias("fault"))


@query(
    "segment_mapping",
    """WITH s AS (SELECT p_partkey, p_size AS n, p_partkey % 20 AS ps, p_partkey % 20 + 10 AS pe, p_partkey % 7 AS ls, p_partkey % 7 + 10 AS le FROM part)
       SELECT p_partkey, CASE WHEN ps > 0 AND ls > 0 AND n BETWEEN ps AND pe THEN ls + n - ps END AS local, CASE WHEN ps > 0 AND ls > 0 AND n BETWEEN ls AND le THEN ps + n - ls END AS provider,
       ps <= le AND ls <= pe AS meet FROM s""",
)
def segment_mapping(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    segment = (k % 20, k % 20 + 10, k % 7, k % 7 + 10)
    ps, pe, ls, le = segment
    return table(spark, d, "part").select("p_partkey", ranges.to_local(n, *segment).alias("local"), ranges.to_provider(n, *segment).alias("provider"), ranges.ranges_meet(ps, pe, ls, le).alias("meet"))


@query(
    "ownership_classes",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, CASE WHEN l_partkey % 50 = 0 THEN 'x' WHEN l_returnflag = 'A' THEN 'o' WHEN l_returnflag = 'R' THEN 'w' ELSE 'u' END AS who FROM lineitem),
       s AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey, who ORDER BY n) AS run FROM r),
       a AS (SELECT l_orderkey, count(*) FILTER (WHERE who = 'x') AS nx, count(DISTINCT run) FILTER (WHERE who = 'o') AS ro, count(DISTINCT run) FILTER (WHERE who = 'w') AS rw,
         min(n) FILTER (WHERE who = 'o') AS lo, max(n) FILTER (WHERE who = 'o') AS ho, min(n) FILTER (WHERE who = 'w') AS lw, max(n) FILTER (WHERE who = 'w') AS hw FROM s GROUP BY 1)
       SELECT l_orderkey, CASE WHEN nx > 0 THEN 'other-anime-involved' WHEN ro = 0 AND rw = 0 THEN 'unmapped-only' WHEN rw = 0 THEN 'orphan-only' WHEN ro = 0 THEN 'owner-only'
         WHEN ro = 1 AND rw = 1 AND hw + 1 = lo THEN 'owner-then-orphan-adjacent' WHEN ro = 1 AND rw = 1 AND ho + 1 = lw THEN 'orphan-then-owner-adjacent'
         WHEN ro = 1 AND rw = 1 THEN 'owner-orphan-with-gap' ELSE 'fragmented-between-owner-and-orphan' END AS ownership FROM a""",
)
def ownership_classes(spark: SparkSession, d: str) -> DataFrame:
    who = F.when(F.col("l_partkey") % 50 == 0, "X").when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", who.alias("who"))
    return classify.ownership(rows, ["l_orderkey"], "l_linenumber", "who", F.lit("A"), F.lit("R"))


@query(
    "count_mismatch",
    """WITH a AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS k, CASE WHEN l_orderkey % 10 > 0 THEN max(l_linenumber) END AS m FROM lineitem GROUP BY 1)
       SELECT l_orderkey, CASE WHEN n = k THEN NULL WHEN m IS NULL THEN 'local-mismatch-metadata-missing' WHEN m <> n THEN 'local-mismatch-metadata-differs'
       WHEN k < n THEN 'local-short-metadata-exact' ELSE 'local-long-metadata-exact' END AS mismatch FROM a""",
)
def count_mismatch(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("k"), F.max("l_linenumber").alias("m"))
    return a.select("l_orderkey", classify.count_mismatch(F.col("n"), F.col("k"), F.when(F.col("l_orderkey") % 10 > 0, F.col("m"))).alias("mismatch"))


@query(
    "missing_numbers",
    """WITH n AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS x FROM lineitem GROUP BY 1)
       SELECT l_orderkey, array_to_string(list_filter(range(1, 8), lambda i: NOT list_contains(x, i)), ',') AS missing FROM n""",
)
def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("x"))
    return a.select("l_orderkey", F.array_join(rel.missing_numbers(F.col("x"), F.lit(7)), ",").alias("missing"))


_TITLE_SQL = """n AS (SELECT p_partkey, p_brand, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS a FROM part),
  p AS (SELECT p_partkey, a, lag(a) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM n),
  t AS (SELECT *, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb,
    list_distinct(list_transform(range(1, greatest(length(a) - 1, 2)), lambda i: substr(a, i, 3))) AS ga,
    list_distinct(list_transform(range(1, greatest(length(b) - 1, 2)), lambda i: substr(b, i, 3))) AS gb FROM p)"""


@query(
    "title_similarity",
    f"""WITH {_TITLE_SQL} SELECT p_partkey, round(CASE WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0 WHEN a = b THEN 1 ELSE
        greatest(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb))) END, 6) AS similarity FROM t""",
)
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").withColumn("a", fn.comparable_title(F.col("p_name"), ascii_only=True))
    pairs = named.withColumn("b", F.lag("a").over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return pairs.select("p_partkey", F.round(fn.title_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(
    "slugify",
    r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(p_name || ' / ' || p_brand)), '[^A-Za-z0-9_ \t\n\r-]', '', 'g'), '[ \t\n\r_]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""",
)
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.slugify(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query(
    "explicit_numbers",
    r"""SELECT conv_id, turn, role, CASE WHEN n > 0 THEN n END AS number FROM (SELECT conv_id, turn, role, text, TRY_CAST(coalesce(
        nullif(regexp_extract(t, '(?i)\b(?:episode|ep|session|act|case|chapter)\s*#?\s*(\d{1,4})\b', 1), ''), nullif(regexp_extract(t, '#\s*(\d{1,4})\b', 1), '')) AS INTEGER) AS n
        FROM (SELECT *, 'Session #' || turn || ': ' || text AS t FROM conversations))""",
)
def explicit_numbers(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat(F.lit("Session #"), F.col("turn").cast("string"), F.lit(": "), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", fn.explicit_number(title).alias("number"))


@query(
    "url_parts",
    """SELECT page_id, nullif(lower(regexp_extract(url, '^(?i:https?)://([^/?#]+)', 1)), '') AS host,
       CASE WHEN regexp_matches(url, '^(?i:https?)://[^/?#]+') THEN regexp_extract(url, '^(?i:https?)://[^/?#]+([^?#]*)', 1) END AS path FROM pages""",
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    host, path = fn.url_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path"))


@query(
    "json_fields",
    "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1",
)
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").try_cast("int").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_EVIDENCE_SQL = """e AS (SELECT user_id, greatest(0, least(100, CAST(floor(value + 0.5) AS INTEGER))) AS c, event_type AS source,
  CASE event_type WHEN 'error' THEN 'missing' WHEN 'view' THEN 'partial' WHEN 'signup' THEN 'no_dub' ELSE 'available' END AS v FROM events)"""


@query(
    "evidence_resolution",
    f"""WITH {_EVIDENCE_SQL}, k AS (SELECT *, c >= 75 AND v IN ('missing', 'no_dub') AS neg, c >= 75 AND v = 'partial' AS part FROM e),
        m AS (SELECT user_id, coalesce(max(c) FILTER (WHERE neg), -1) AS n, coalesce(max(c) FILTER (WHERE part), -1) AS p, coalesce(max(c) FILTER (WHERE NOT neg AND NOT part), -1) AS q FROM k GROUP BY 1)
        SELECT user_id, CASE WHEN n >= 75 AND n >= p AND n >= q THEN 'not_available' WHEN p >= 75 AND p >= q THEN 'partial' WHEN q < 0 THEN 'unknown'
          WHEN q >= 90 THEN 'confirmed' WHEN q >= 65 THEN 'likely' WHEN q >= 40 THEN 'possible' ELSE 'unknown' END AS status,
        CASE WHEN n >= 75 AND n >= p AND n >= q THEN n WHEN p >= 75 AND p >= q THEN p WHEN q < 0 THEN 0 ELSE q END AS score FROM m""",
)
def evidence_resolution(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    value = F.when(kind == "error", "missing").when(kind == "view", "partial").when(kind == "signup", "no_dub").otherwise("available")
    return classify.resolve_evidence(table(spark, d, "events").withColumn("says", value), ["user_id"], "event_type", "says", "value")


@query(
    "status_fold",
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'missing' WHEN 'view' THEN 'partial' WHEN 'click' THEN 'available' END AS v FROM events),
       f AS (SELECT user_id, coalesce(bool_or(v = 'available'), FALSE) AS a, coalesce(bool_or(v = 'partial'), FALSE) AS p, coalesce(bool_or(v = 'missing'), FALSE) AS m FROM e GROUP BY 1)
       SELECT user_id, CASE WHEN a AND NOT p AND NOT m THEN 'available' WHEN (a OR p) AND m THEN 'partial' WHEN p THEN 'partial' WHEN m THEN 'not_available' END AS status FROM f""",
)
def status_fold(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    value = F.when(kind == "error", "missing").when(kind == "view", "partial").when(kind == "click", "available")
    return table(spark, d, "events").withColumn("v", value).groupBy("user_id").agg(classify.fold_status("v").alias("status"))


@query(
    "latest_ttl",
    """WITH n AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events), l AS (SELECT user_id, max(ts) AS ts FROM events, n WHERE ts <= now GROUP BY 1)
       SELECT user_id, epoch_us(ts) AS at_us FROM l, n WHERE ts > now - INTERVAL 7 DAY""",
)
def latest_ttl(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    now = F.lit(events.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0])
    return microbatch.latest_alive(events, ["user_id"], "ts", now, F.expr("INTERVAL 7 DAYS")).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


_WINDOWS_SQL = """o AS (SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS batch, event_type = 'error' AND
  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w >= 0.25 * count(*) OVER w AS over FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("ts"), F.col("event_id")]
    batch = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1) / 4)
    return microbatch.failure_windows(table(spark, d, "events").withColumn("batch", batch), ["user_id"], order, F.col("event_type") == "error")


@query("failure_window", f"WITH {_WINDOWS_SQL} SELECT event_id, batch, over FROM o")
def failure_window(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).select("event_id", "batch", "over")


@query(
    "back_offs",
    f"""WITH RECURSIVE {_WINDOWS_SQL}, b(user_id, batch) AS (SELECT user_id, min(batch) FROM o WHERE over GROUP BY 1
        UNION ALL SELECT b.user_id, (SELECT min(o.batch) FROM o WHERE over AND o.user_id = b.user_id AND o.batch >= b.batch + 10) FROM b WHERE b.batch IS NOT NULL)
        SELECT user_id, batch FROM b WHERE batch IS NOT NULL""",
)
def back_offs(spark: SparkSession, d: str) -> DataFrame:
    return microbatch.back_offs(_windows(spark, d), ["user_id"], "batch")


@query(
    "stat_cube",
    """SELECT 'flag' AS dim, l_returnflag AS value, count(*) AS n, count(DISTINCT l_orderkey) AS groups FROM lineitem GROUP BY ALL
       UNION ALL SELECT 'status', l_linestatus, count(*), count(DISTINCT l_orderkey) FROM lineitem GROUP BY ALL
       UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), count(*), count(DISTINCT l_orderkey) FROM lineitem GROUP BY ALL""",
)
def stat_cube(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    dims = F.array(*[F.struct(F.lit(n).alias("dim"), v.cast("string").alias("value")) for n, v in (("flag", c("l_returnflag")), ("status", c("l_linestatus")), ("line", c("l_linenumber")))])
    return table(spark, d, "lineitem").select("l_orderkey", F.inline(dims)).groupBy("dim", "value").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("groups"))


@query(
    "audit_findings",
    """WITH f AS (SELECT 'blank_name' AS code, 'error' AS severity, count(*) FILTER (WHERE trim(c_name) = '' OR c_name <> trim(c_name)) AS n FROM customer
       UNION ALL SELECT 'negative_balance', 'warning', count(*) FILTER (WHERE c_acctbal < 0) FROM customer
       UNION ALL SELECT 'negative_balance', 'warning', count(*) FILTER (WHERE s_acctbal < 0) FROM supplier
       UNION ALL SELECT 'orphan_order', 'error', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
       UNION ALL SELECT 'discount_range', 'error', count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 1) FROM lineitem)
       SELECT code, severity, CAST(sum(n) AS BIGINT) AS n, sum(n) = 0 AS ok FROM f GROUP BY ALL""",
)
def audit_findings(spark: SparkSession, d: str) -> DataFrame:
    customer, supplier, orders, lines = (table(spark, d, t) for t in ("customer", "supplier", "orders", "lineitem"))

    def finding(code: str, severity: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")

    found = [
        finding("blank_name", "error", customer.where("trim(c_name) = '' OR c_name <> trim(c_name)")), finding("negative_balance", "warning", customer.where("c_acctbal < 0")),
        finding("negative_balance", "warning", supplier.where("s_acctbal < 0")), finding("orphan_order", "error", rel.without(orders, lines, {"o_orderkey": "l_orderkey"})),
        finding("discount_range", "error", lines.where("NOT l_discount BETWEEN 0 AND 1")),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("code", "severity").agg(F.sum("n").alias("n"), (F.sum("n") == 0).alias("ok"))


@query(
    "nested_document",
    """SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS order_keys
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def nested_document(spark: SparkSession, d: str) -> DataFrame:
    children = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), rel.ordered_text(F.col("o_orderkey"), F.col("o_orderkey")).alias("k"))
    return table(spark, d, "customer").select("c_custkey").join(children, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("k", F.lit("")).alias("order_keys"))


@query(
    "review_queue",
    "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50",
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    waiting = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    return waiting.orderBy("o_orderpriority", F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority", "o_orderstatus")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A target of orders and a source that overlaps it, with a changed status, confidence and some nulls."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 97).alias("conf"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("note"))
    source = o.where("o_orderkey % 3 < 2").select("o_orderkey", F.lit("N").alias("status"), (F.col("o_orderkey") % 89).alias("conf"), F.lit("new").alias("note"))
    return o.where("o_orderkey % 3 > 0"), source


_HALVES_SQL = """t AS (SELECT o_orderkey, o_orderstatus AS status, o_orderkey % 97 AS conf, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS note FROM orders WHERE o_orderkey % 3 > 0),
  s AS (SELECT o_orderkey, 'N' AS status, o_orderkey % 89 AS conf, 'new' AS note FROM orders WHERE o_orderkey % 3 < 2)"""


@query(
    "upsert_provenance",
    f"""WITH {_HALVES_SQL} SELECT o_orderkey, CASE WHEN t.status IS NULL OR (t.status <> 'F' AND s.status IS NOT NULL) THEN s.status ELSE t.status END AS status,
        greatest(t.conf, s.conf) AS conf, CASE WHEN t.status IS NULL OR (t.status <> 'F' AND s.status IS NOT NULL) THEN s.note ELSE t.note END AS note FROM t FULL JOIN s USING (o_orderkey)""",
)
def upsert_provenance(spark: SparkSession, d: str) -> DataFrame:
    return merge.keep_provenance(*_halves(spark, d), ["o_orderkey"], "status", "conf", ("F",))


@query(
    "upsert_fill",
    f"""WITH {_HALVES_SQL} SELECT o_orderkey, coalesce(t.status, s.status) AS status, coalesce(t.conf, s.conf) AS conf, coalesce(t.note, s.note) AS note FROM t FULL JOIN s USING (o_orderkey)""",
)
def upsert_fill(spark: SparkSession, d: str) -> DataFrame:
    return merge.fill_nulls(*_halves(spark, d), ["o_orderkey"])


@query("upsert_overwrite", f"WITH {_HALVES_SQL} SELECT * FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)")
def upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return merge.overwrite(*_halves(spark, d), ["o_orderkey"])


@query("insert_absent", f"WITH {_HALVES_SQL} SELECT * FROM t UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE s.o_orderkey = t.o_orderkey)")
def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    return merge.insert_absent(*_halves(spark, d), ["o_orderkey"])


@query("replace_groups", f"WITH {_HALVES_SQL} SELECT * FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conf = t.conf)")
def replace_groups(spark: SparkSession, d: str) -> DataFrame:
    return merge.replace_groups(*_halves(spark, d), ["conf"])
