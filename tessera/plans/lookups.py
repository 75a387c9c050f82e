"""Registered queries: reads, folds, matching, scalar functions and upserts over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import classify, matching, merge, planning, reads, scoring
from tessera.operators import relational as rel
from tessera.streaming import microbatch

from .catalogue import query, table
from .repairs import _made


@query("listed_rows", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 100")
def listed_rows(spark: SparkSession, d: str) -> DataFrame:
    return reads.listed(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], "5000")


@query("point_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return reads.lookup(table(spark, d, "customer"), "c_custkey", 42).select("c_custkey", "c_name")


@query("child_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def child_rows(spark: SparkSession, d: str) -> DataFrame:
    return reads.filtered(table(spark, d, "orders"), {"o_custkey": 7, "o_orderstatus": None}).select("o_orderkey", "o_totalprice")


@query("optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    return reads.filtered(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_custkey": None}).select("o_orderkey")


@query(
    "fan_out",
    """SELECT n_nationkey, coalesce((SELECT string_agg(c_custkey || ':' || c_name, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') AS customers,
       coalesce((SELECT string_agg(s_suppkey || ':' || s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers FROM nation""",
)
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    out = reads.fan_out(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", {"customers": (c, "c_nationkey", ["c_custkey"]), "suppliers": (s, "s_nationkey", ["s_suppkey"])})
    text = lambda name, key, label: F.array_join(F.transform(name, lambda x: F.concat_ws(":", x[key].cast("string"), x[label])), ",").alias(name)
    return out.select("n_nationkey", text("customers", "c_custkey", "c_name"), text("suppliers", "s_suppkey", "s_name"))


@query("offset_histogram", 'SELECT l_suppkey - l_linenumber AS value, count(*) AS groups, CAST(sum(l_quantity) AS BIGINT) AS "rows" FROM lineitem GROUP BY 1')
def offset_histogram(spark: SparkSession, d: str) -> DataFrame:
    return reads.histogram(table(spark, d, "lineitem"), F.col("l_suppkey") - F.col("l_linenumber"), F.col("l_quantity"))


@query(
    "null_coverage",
    """SELECT 'text' AS "column", count(*) FILTER (WHERE text <> '') AS given, count(*) FILTER (WHERE text IS NULL OR text = '') AS missing FROM documents
       UNION ALL SELECT 'source', count(*) FILTER (WHERE source <> ''), count(*) FILTER (WHERE source IS NULL OR source = '') FROM documents
       UNION ALL SELECT 'n_chars', count(n_chars), count(*) - count(n_chars) FROM documents""",
)
def null_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reads.null_coverage(table(spark, d, "documents"), ["text", "source", "n_chars"])


@query(
    "severity_rollup",
    """WITH f AS (SELECT event_type AS code, CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'warning' END AS severity, count(*) FILTER (WHERE value > 99) AS n FROM events GROUP BY 1)
       SELECT severity, count(DISTINCT code) AS codes, CAST(sum(n) AS BIGINT) AS "rows", count(*) FILTER (WHERE n > 0) AS failing FROM f GROUP BY 1""",
)
def severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("code").isin("error", "purchase"), "error").otherwise("warning")
    found = table(spark, d, "events").groupBy(F.col("event_type").alias("code")).agg(F.count_if(F.col("value") > 99).alias("n")).withColumn("severity", severity)
    return reads.severity_rollup(found)


_TAGS = """SELECT p_size AS owner, p_partkey AS position, concat(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END) AS name,
  CASE WHEN p_partkey % 4 = 0 THEN p_type END AS category, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 100 END AS score, p_partkey % 7 = 0 AS spoiler FROM part"""


@query(
    "folded_repeats",
    f"""WITH t AS (SELECT *, trim(name) AS n FROM ({_TAGS})) SELECT owner, arg_min(n, position) AS name, arg_min(category, position) FILTER (WHERE category IS NOT NULL) AS category, bool_or(spoiler) AS spoiler, min(score) AS score
        FROM t WHERE n <> '' GROUP BY owner, lower(n)""",
)
def folded_repeats(spark: SparkSession, d: str) -> DataFrame:
    return reads.fold_repeats(_made(spark, d, _TAGS, "part"), ["owner"], "name", "position", ["category"], ["spoiler"], ["score"])


@query("unambiguous_numbers", "SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber > 0 GROUP BY ALL HAVING count(DISTINCT l_partkey) = 1")
def unambiguous_numbers(spark: SparkSession, d: str) -> DataFrame:
    return reads.unambiguous(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_partkey")


_NAMES_SQL = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(
    "similar_titles",
    f"""WITH x AS (SELECT p_partkey AS id, p_size % 2 AS side, {_NAMES_SQL.format("concat(p_name, ' ', p_partkey // 40)")} AS t FROM part),
    g AS (SELECT *, list_distinct(string_split(t, ' ')) AS ts, list_distinct(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3))) AS gs FROM x),
    u AS (SELECT id, side, unnest(gs) AS e FROM g), p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM u a JOIN u b ON a.side = 0 AND b.side = 1 AND a.e = b.e),
    s AS (SELECT p.a, p.b, CASE WHEN x.t = y.t THEN 1 ELSE greatest(len(list_intersect(x.ts, y.ts)) / len(list_distinct(list_concat(x.ts, y.ts))), 2.0 * len(list_intersect(x.gs, y.gs)) / (len(x.gs) + len(y.gs))) END AS v FROM p JOIN g x ON x.id = p.a JOIN g y ON y.id = p.b)
    SELECT a, b, round(v, 6) AS similarity FROM s WHERE v >= 0.9""",
)
def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    title = fn.comparable_title(F.concat_ws(" ", F.col("p_name"), F.floor(F.col("p_partkey") / 40).cast("string")), ascii_only=True)
    named = table(spark, d, "part").select("p_partkey", "p_size", title.alias("title"))
    left, right = (named.where(F.col("p_size") % 2 == side).select(F.col("p_partkey").alias(key), "title") for side, key in ((0, "a"), (1, "b")))
    return matching.similar_titles(left, right, 0.9).withColumn("similarity", F.round("similarity", 6))


_MAPPINGS = """SELECT o_custkey AS anime_id, o_orderkey AS id, o_orderkey % 11 = 0 AS is_primary, CASE o_orderkey % 6 WHEN 0 THEN 'manual' WHEN 1 THEN 'system' WHEN 2 THEN 'api' WHEN 3 THEN 'import' WHEN 4 THEN 'fuzzy' ELSE 'other' END AS source,
  o_orderkey % 9 * 10 AS confidence, o_orderdate AS updated_at FROM orders"""


@query(
    "preferred_mappings",
    f"""SELECT DISTINCT ON (anime_id) anime_id, id, source FROM ({_MAPPINGS}) ORDER BY anime_id, is_primary DESC,
        CASE source WHEN 'manual' THEN 5 WHEN 'system' THEN 4 WHEN 'api' THEN 3 WHEN 'import' THEN 3 WHEN 'fuzzy' THEN 1 ELSE 0 END DESC, confidence DESC, updated_at DESC NULLS LAST, id DESC""",
)
def preferred_mappings(spark: SparkSession, d: str) -> DataFrame:
    return matching.preferred(_made(spark, d, _MAPPINGS, "orders"), ["anime_id"]).select("anime_id", "id", "source")


@query("best_scores", "SELECT DISTINCT ON (l_suppkey) l_suppkey, l_orderkey, l_quantity FROM (SELECT l_suppkey, l_orderkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) ORDER BY l_suppkey, l_quantity DESC, l_orderkey")
def best_scores(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_per_candidate(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_orderkey").select("l_suppkey", "l_orderkey", "l_quantity")


_CANDIDATES = """SELECT l_orderkey AS anime_id, l_linenumber AS nth, l_partkey AS candidate, CASE l_partkey % 15 WHEN 0 THEN NULL WHEN 1 THEN 'malformed' WHEN 2 THEN 'not-found' WHEN 3 THEN 'fetch-failed' ELSE 'ok' END AS status,
  l_suppkey % 2 * 0.6 + 0.3 AS similarity, concat(CAST(1990 + l_orderkey % 10 AS VARCHAR(20)), '-04-01') AS start_date, CAST(NULL AS INT) AS season_year, CAST(l_orderkey % 30 AS INT) AS episode_count,
  CASE WHEN l_partkey % 4 > 0 THEN concat(CAST(1990 + (l_orderkey + l_linenumber * 4) % 10 + l_partkey % 3 * 8 - 8 AS VARCHAR(20)), '-04-01') END AS show_aired,
  CASE WHEN l_partkey % 3 = 0 THEN concat(CAST(1990 + l_orderkey % 10 AS VARCHAR(20)), CASE WHEN l_partkey % 2 = 0 THEN '-04-01' ELSE '-07-01' END) END AS season_aired,
  CAST(l_orderkey % 30 + l_partkey % 5 * 12 AS INT) AS show_count, CAST(CASE WHEN l_partkey % 7 > 2 THEN l_orderkey % 30 + l_partkey % 4 END AS INT) AS season_count FROM lineitem"""
_MATCHED_SQL = f"""c AS ({_CANDIDATES}), y AS (SELECT *, status IS NOT DISTINCT FROM 'ok' AS ok, similarity >= 0.72 AS t, least(abs(CAST(substr(show_aired, 1, 4) AS INT) - CAST(substr(start_date, 1, 4) AS INT)), abs(CAST(substr(season_aired, 1, 4) AS INT) - CAST(substr(start_date, 1, 4) AS INT))) AS yd,
    abs(CASE WHEN season_count > 0 THEN season_count END - CASE WHEN episode_count > 0 THEN episode_count END) AS sd, abs(CASE WHEN show_count > 0 THEN show_count END - CASE WHEN episode_count > 0 THEN episode_count END) AS hd,
    coalesce(season_aired = start_date, FALSE) AS sx, coalesce(show_aired = start_date, FALSE) AS hx FROM c),
  v AS (SELECT *, CASE WHEN ok AND t AND (sx OR hx OR coalesce(yd <= 1 AND sd <= 2, FALSE)) THEN 'strong-match' WHEN ok AND NOT t AND (yd IS NULL OR yd > 2) THEN 'mismatch' WHEN ok AND t AND (coalesce(yd <= 1, FALSE) OR coalesce(sd <= 2, FALSE)) THEN 'likely-match' ELSE 'indeterminate' END AS match,
    CASE WHEN ok AND t AND sx AND sd = 0 THEN 'season' WHEN ok AND t AND hx AND hd = 0 THEN 'show' END AS scope,
    CASE WHEN ok AND NOT t AND yd >= 10 THEN 'title-contradiction-with-substantially-wrong-year' WHEN ok AND NOT t AND least(sd, hd) >= 20 THEN 'title-contradiction-with-substantially-wrong-count' END AS wrong FROM y),
  w AS (SELECT *, CASE WHEN scope IS NOT NULL THEN 'verified-keep' WHEN wrong IS NOT NULL THEN 'verified-retire' ELSE 'not-repair-safe' END AS repair, CASE WHEN scope IS NULL THEN coalesce(wrong, CASE WHEN status IS NULL THEN 'missing-provider-evidence' WHEN status = 'malformed' THEN 'malformed-provider-id'
    WHEN status = 'not-found' THEN 'provider-entity-not-found' WHEN status = 'fetch-failed' THEN 'provider-fetch-failed' ELSE 'no-verified-identity-proof-and-no-explicit-contradiction' END) END AS block FROM v)"""


@query("match_classes", f"WITH {_MATCHED_SQL} SELECT anime_id, nth, candidate, match, repair, scope, block FROM w")
def match_classes(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_class(_made(spark, d, _CANDIDATES, "lineitem")).select("anime_id", "nth", "candidate", "match", "repair", "scope", "block")


@query(
    "group_verdicts",
    f"""WITH {_MATCHED_SQL}, g AS (SELECT anime_id, count(*) AS n, count(*) FILTER (WHERE match = 'strong-match') AS s, count(*) FILTER (WHERE repair = 'verified-keep') AS k, count(*) FILTER (WHERE repair = 'verified-retire') AS r FROM w GROUP BY 1)
        SELECT anime_id, n, CASE WHEN s = 1 THEN 'exactly-one-strong-match' WHEN s > 1 THEN 'multiple-strong-match' ELSE 'no-strong-match' END AS verdict, n >= 2 AND k = 1 AND r = n - 1 AS repair_safe FROM g""",
)
def group_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return matching.group_verdict(matching.match_class(_made(spark, d, _CANDIDATES, "lineitem")), ["anime_id"])


@query(
    "base_titles",
    r"""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 8 WHEN 0 THEN ' Season 2' WHEN 1 THEN ' 3rd season' WHEN 2 THEN ' Second Season' WHEN 3 THEN ' III' WHEN 4 THEN ' 7 ' WHEN 5 THEN ' part 2 II' ELSE '' END AS t FROM part),
    a AS (SELECT *, regexp_replace(t, '\s+(season|part|series|cour)\s*\d+\s*$', '', 'i') AS a FROM t), b AS (SELECT *, regexp_replace(a, '\s+\d+(st|nd|rd|th)\s+(season|series|cour)\s*$', '', 'i') AS b FROM a),
    c AS (SELECT *, regexp_replace(b, '\s+(second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+(season|series|cour)\s*$', '', 'i') AS c FROM b), d AS (SELECT *, regexp_replace(c, '\s+(II|III|IV|VI{0,3}|IX)\s*$', '', 'i') AS d FROM c),
    e AS (SELECT *, trim(regexp_replace(d, '\s+\d+\s*$', '')) AS e FROM d) SELECT p_partkey, CASE WHEN e <> t AND length(e) >= 3 THEN e END AS base FROM e""",
)
def base_titles(spark: SparkSession, d: str) -> DataFrame:
    suffixes = [" Season 2", " 3rd season", " Second Season", " III", " 7 ", " part 2 II", "", ""]
    title = F.concat("p_name", F.element_at(F.array(*map(F.lit, suffixes)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", fn.base_title(title).alias("base"))


@query(
    "distinct_titles",
    """WITH x AS (SELECT p_partkey, unnest([p_brand, ' ' || upper(p_brand), p_name, '', lower(p_name), NULL]) AS t, unnest(range(6)) AS i FROM part), y AS (SELECT p_partkey, arg_min(trim(t), i) AS t, min(i) AS i FROM x WHERE trim(t) <> '' GROUP BY p_partkey, lower(trim(t)))
       SELECT p_partkey, string_agg(t, '|' ORDER BY i) AS titles FROM y GROUP BY 1""",
)
def distinct_titles(spark: SparkSession, d: str) -> DataFrame:
    titles = F.array("p_brand", F.concat(F.lit(" "), F.upper("p_brand")), "p_name", F.lit(""), F.lower("p_name"), F.lit(None).cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(matching.distinct_titles(titles), "|").alias("titles"))


_SLUGS = "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat(lower(p_brand), '-', CAST(p_partkey - CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -3 END AS VARCHAR(20))) WHEN p_partkey % 50 = 1 THEN ' ' ELSE lower(p_brand) END AS slug FROM part"
_TAKEN = "SELECT lower(p_brand) AS slug FROM part WHERE p_size = 50 AND p_partkey % 3 = 0 UNION ALL SELECT concat(lower(p_brand), '-', CAST(p_partkey AS VARCHAR(20))) FROM part WHERE p_partkey % 11 = 0"


@query(
    "unique_slugs",
    f"""WITH s AS (SELECT p_partkey AS k, CASE WHEN trim(slug) = '' THEN CAST(p_partkey AS VARCHAR) ELSE slug END AS c FROM ({_SLUGS})), t AS (SELECT DISTINCT slug FROM ({_TAKEN})),
       a AS (SELECT *, c IN (SELECT slug FROM t) OR k > min(k) OVER (PARTITION BY c) AS lost FROM s), b AS (SELECT a.k, a.c, a.lost OR EXISTS (SELECT 1 FROM a q WHERE q.lost AND q.k < a.k AND q.c || '-' || q.k = a.c) AS lost FROM a),
       d AS (SELECT k, c, lost, c || '-' || k AS two, c || '-' || k IN (SELECT slug FROM t) OR EXISTS (SELECT 1 FROM s q WHERE q.c = b.c || '-' || b.k AND q.k < b.k) AS again FROM b)
       SELECT k AS p_partkey, CASE WHEN NOT lost THEN c WHEN NOT again THEN two ELSE two || '-9' END AS slug FROM d""",
)
def unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    rows, taken = (spark.sql(text.replace("FROM part", "FROM {rows}"), rows=table(spark, d, "part")) for text in (_SLUGS, _TAKEN))
    return matching.unique_slugs(rows, "slug", "p_partkey", taken, "9")


@query(
    "scalar_functions",
    r"""WITH e AS (SELECT event_id, user_id, event_type, value, CASE event_id % 6 WHEN 0 THEN event_id || ':' || user_id || ':x' WHEN 1 THEN '12.0' WHEN 2 THEN '-3' WHEN 3 THEN ' ' WHEN 4 THEN event_id || ':0' ELSE CAST(event_id AS VARCHAR) END AS raw FROM events)
       SELECT event_id, CASE WHEN try_cast(raw AS DOUBLE) > 0 AND try_cast(raw AS DOUBLE) = floor(try_cast(raw AS DOUBLE)) THEN CAST(try_cast(raw AS DOUBLE) AS BIGINT) END AS id, nullif(lower(trim(raw)), '') AS code,
       CASE WHEN event_id % 6 = 0 AND event_id > 0 AND user_id > 0 THEN event_id END AS show, CASE WHEN event_type = 'error' THEN 'X-429' ELSE event_type END AS message,
       CASE WHEN event_type = 'error' THEN 'rate-limit' WHEN event_type = 'view' THEN 'transient' ELSE 'other' END AS failure, CASE event_type WHEN 'click' THEN 'RELEASING' WHEN 'view' THEN 'FINISHED' END AS status,
       CASE WHEN event_type = 'signup' THEN 100 WHEN event_type = 'view' THEN 90 WHEN event_type = 'click' THEN 75 WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 50 ELSE 20 END ELSE 20 END AS confidence FROM e""",
)
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    raw = F.element_at(F.array(F.concat_ws(":", c("event_id").cast("string"), c("user_id").cast("string"), F.lit("x")), F.lit("12.0"), F.lit("-3"), F.lit(" "), F.concat(c("event_id").cast("string"), F.lit(":0")), c("event_id").cast("string")), (c("event_id") % 6 + 1).cast("int"))
    message = F.when(c("event_type") == "error", "X-429").otherwise(c("event_type"))
    kinds = {"signup": ("manual", "manual_verified"), "view": ("provider", "provider_audio"), "click": ("provider", "voice_cast"), "purchase": ("community", "community_submission")}
    source, kind = (F.coalesce(*[F.when(c("event_type") == k, v[i]) for k, v in kinds.items()], F.lit("other")) for i in (0, 1))
    rows = table(spark, d, "events").withColumn("raw", raw)
    return rows.select(
        "event_id", fn.positive_id(c("raw")).alias("id"), fn.language_code(c("raw")).alias("code"), fn.composite_prefix(c("raw"))[0].alias("show"), message.alias("message"),
        fn.error_class(F.when(c("event_type") == "view", "Fetch failed: status 503").otherwise(message)).alias("failure"), fn.recoded(F.when(c("event_type") == "click", "CURRENT").when(c("event_type") == "view", "FINISHED"), fn.STATUSES).alias("status"),
        fn.default_confidence(source, kind, c("event_id") % 2 == 0).alias("confidence"),
    )


@query(
    "url_segments",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(?i:https?)://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '|') AS segments,
        TRY_CAST(nullif(regexp_extract(path, '/(\d+)', 1), '') AS BIGINT) AS number FROM u""",
)
def url_segments(spark: SparkSession, d: str) -> DataFrame:
    path = fn.url_parts(F.col("url"))[1]
    number = fn.anime_id(F.regexp_replace(F.coalesce(path, F.lit("")), r"/(?=\d)", "/anime/"))
    return table(spark, d, "pages").select("page_id", F.coalesce(F.array_join(fn.path_segments(path), "|"), F.lit("")).alias("segments"), number.alias("number"))


@query(
    "run_progress",
    """WITH r AS (SELECT o_orderkey, o_custkey % 120 AS done, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 100 END AS total, o_orderkey % 50 AS seconds FROM orders),
       p AS (SELECT *, CASE WHEN seconds > 0 THEN CAST(done AS DOUBLE) / (seconds * 1000) * 60000 ELSE 0 END AS rate, CASE WHEN done < total THEN total - done ELSE 0 END AS remaining FROM r)
       SELECT o_orderkey, remaining, CASE WHEN total = 0 THEN 0 WHEN done > total THEN 100 ELSE CAST(floor(100.0 * done / total + 0.5) AS INT) END AS percent, rate AS per_minute, CASE WHEN rate > 0 THEN CAST(ceil(remaining / rate * 60) AS BIGINT) END AS eta_seconds FROM p""",
)
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", *reads.progress(F.col("o_custkey") % 120, F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(100), F.col("o_orderkey") % 50))


@query("derived_languages", "SELECT c_custkey, 'ja' AS code, 'audio' AS media FROM customer WHERE c_nationkey % 4 = 0")
def derived_languages(spark: SparkSession, d: str) -> DataFrame:
    country = F.when(F.col("c_nationkey") % 4 == 0, " jp").when(F.col("c_nationkey") % 4 == 1, "US")
    return table(spark, d, "customer").select("c_custkey", F.inline(fn.derived_languages(country)))


_STATES = """t AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderkey % 97 AS conf, o_orderkey % 10 = 0 AS by_hand FROM orders WHERE o_orderkey % 3 > 0),
  s AS (SELECT o_orderkey AS k, 'N' AS status, o_orderkey % 89 AS conf, FALSE AS by_hand FROM orders WHERE o_orderkey % 3 < 2)"""


@query(
    "upsert_override",
    f"WITH {_STATES} SELECT k, CASE WHEN s.k IS NULL OR t.by_hand THEN t.status ELSE s.status END AS status, CASE WHEN s.k IS NULL OR t.by_hand THEN t.conf ELSE s.conf END AS conf, CASE WHEN s.k IS NULL OR t.by_hand THEN t.by_hand ELSE s.by_hand END AS by_hand FROM t FULL JOIN s USING (k)",
)
def upsert_override(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    target = o.where("k % 3 > 0").select("k", F.col("o_orderstatus").alias("status"), (F.col("k") % 97).alias("conf"), (F.col("k") % 10 == 0).alias("by_hand"))
    source = o.where("k % 3 < 2").select("k", F.lit("N").alias("status"), (F.col("k") % 89).alias("conf"), F.lit(False).alias("by_hand"))
    return merge.unless_overridden(target, source, ["k"], "by_hand")


@query(
    "filled_titles",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 7 = 0 THEN p_type WHEN p_partkey % 2 = 0 THEN ' ' END AS title FROM part""",
)
def filled_titles(spark: SparkSession, d: str) -> DataFrame:
    part, k = table(spark, d, "part"), F.col("p_partkey")
    target = part.select("p_partkey", F.when(k % 3 == 0, F.col("p_name")).when(k % 2 == 0, " ").alias("title"))
    sources = [part.where(k % n == 0).select("p_partkey", F.col(c).alias("title")) for n, c in ((5, "p_brand"), (7, "p_type"))]
    return merge.fill_from(target, sources, ["p_partkey"], "title")


@query(
    "resolved_children",
    """WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey END AS external, CASE WHEN l_partkey % 2 = 0 THEN ' SUPPLIER#' || l_suppkey ELSE 'nobody' END AS name, l_partkey FROM lineitem),
       s AS (SELECT s_suppkey + 1000 AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey END AS external, 'Supplier#' || s_suppkey AS name FROM supplier)
       SELECT c.*, coalesce((SELECT min(id) FROM s WHERE s.external = c.external), (SELECT min(id) FROM s WHERE lower(trim(s.name)) = lower(trim(c.name)))) AS id FROM c""",
)
def resolved_children(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("s_suppkey")
    children = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(p % 3 == 0, F.col("l_suppkey")).alias("external"), F.when(p % 2 == 0, F.concat(F.lit(" SUPPLIER#"), F.col("l_suppkey").cast("string"))).otherwise("nobody").alias("name"), "l_partkey")
    dimension = table(spark, d, "supplier").select((s + 1000).alias("id"), F.when(s % 4 > 0, s).alias("external"), F.concat(F.lit("Supplier#"), s.cast("string")).alias("name"))
    return merge.resolved(children, dimension, "external", "name")


@query(
    "linked_relations",
    """WITH e AS (SELECT DISTINCT l_orderkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 1), n AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem), k AS (SELECT c_custkey AS id FROM customer)
       SELECT a, b FROM e UNION ALL SELECT a, b FROM n WHERE a IN (SELECT id FROM k) AND b IN (SELECT id FROM k) AND NOT EXISTS (SELECT 1 FROM e WHERE e.a = n.a AND e.b = n.b)""",
)
def linked_relations(spark: SparkSession, d: str) -> DataFrame:
    lines, nodes = table(spark, d, "lineitem"), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    edges = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return merge.linked(edges, lines.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")), nodes, ("a", "b"), "id")


@query(
    "guarded_rejects",
    "SELECT o_orderkey, o_custkey % 3 AS owner FROM orders WHERE o_custkey % 3 <> o_custkey % 2",
)
def guarded_rejects(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    target, source = (o.select("o_orderkey", (F.col("o_custkey") % n).alias("owner")) for n in (2, 3))
    return merge.guarded(target, source, ["o_orderkey"], "owner")[1]


@query(
    "promoted_rows",
    "SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) ELSE o_orderstatus = 'F' END AS is_primary FROM orders",
)
def promoted_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("is_primary"))
    chosen = rows.where("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return merge.promote(rows, ["o_custkey"], "is_primary", chosen, "o_orderkey")


@query("every_and_some", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every, bool_or(o_orderstatus = 'F') AS some, least(85, min(o_orderkey % 100)) AS confidence FROM orders GROUP BY 1")
def every_and_some(spark: SparkSession, d: str) -> DataFrame:
    a = [F.bool_and(F.col("o_totalprice") > 1000).alias("every"), F.bool_or(F.col("o_orderstatus") == "F").alias("some"), F.least(F.lit(85), F.min(F.col("o_orderkey") % 100)).alias("confidence")]
    return table(spark, d, "orders").groupBy("o_custkey").agg(*a)


@query("ambiguous_members", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def ambiguous_members(spark: SparkSession, d: str) -> DataFrame:
    lines, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    several = lines.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rel.having(lines, several, {k: k for k in keys}).select(*keys, "l_partkey")


@query("silent_runs", "SELECT user_id, max(ts) < (SELECT max(ts) - INTERVAL 30 MINUTE FROM events) AS silent FROM events GROUP BY 1")
def silent_runs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    last = events.agg(F.max("ts")).first()[0]
    return events.groupBy("user_id").agg((F.max("ts") < F.lit(last) - F.expr("INTERVAL 30 MINUTES")).alias("silent"))


@query("audio_status", "SELECT event_id, CASE event_type WHEN 'error' THEN 'missing' WHEN 'purchase' THEN 'available' WHEN 'view' THEN 'available' END AS action FROM events")
def audio_status(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select("event_id", classify.dub_action(kind != "error", kind.isin("purchase", "view")).alias("action"))


@query(
    "date_functions",
    """WITH o AS (SELECT o_orderkey, o_custkey, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS d, CASE WHEN o_custkey % 6 > 0 THEN year(o_orderdate) END AS y, CASE WHEN o_custkey % 4 > 0 THEN month(o_orderdate) END AS m, CASE WHEN o_custkey % 3 > 0 THEN day(o_orderdate) END AS n FROM orders),
       x AS (SELECT *, CASE o_custkey % 5 WHEN 0 THEN '1996-02-30' WHEN 1 THEN ' ' || d || ' ' WHEN 2 THEN 'soon' WHEN 3 THEN '0001-01-01T00:00:00Z' ELSE d END AS t FROM o)
       SELECT o_orderkey, CASE WHEN y IS NOT NULL THEN lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(coalesce(m, 1) AS VARCHAR), 2, '0') || '-' || lpad(CAST(coalesce(n, 1) AS VARCHAR), 2, '0') END AS partial,
       CASE WHEN o_custkey % 5 IN (1, 4) THEN d END AS strict, CASE WHEN o_custkey % 5 IN (1, 4) THEN abs(date_diff('day', CAST(d AS DATE), DATE '1995-06-17')) END AS apart,
       CASE WHEN o_custkey % 5 = 0 THEN 1996 WHEN o_custkey % 5 = 4 THEN CAST(substr(d, 1, 4) AS INT) WHEN o_custkey % 5 = 1 AND substr(d, 1, 3) >= '190' THEN NULL END AS year,
       CASE WHEN o_custkey % 5 IN (1, 4) AND d < '1995-06-17' THEN d ELSE '1995-06-17' END AS earliest, CASE WHEN o_custkey % 5 <> 3 THEN t END AS given FROM x""",
)
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    c, k = F.col, F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(k % 5 == 0, "1996-02-30").when(k % 5 == 1, F.concat(F.lit(" "), day, F.lit(" "))).when(k % 5 == 2, "soon").when(k % 5 == 3, fn.UNSET).otherwise(day)
    rows = table(spark, d, "orders").withColumn("t", text)
    parts = [F.when(k % n > 0, f("o_orderdate")) for n, f in ((6, F.year), (4, F.month), (3, F.day))]
    return rows.select(
        "o_orderkey", fn.partial_date(*parts).alias("partial"), F.date_format(fn.strict_date(c("t")), "yyyy-MM-dd").alias("strict"), fn.days_apart(fn.strict_date(c("t")), F.to_date(F.lit("1995-06-17"))).alias("apart"),
        fn.year_of(c("t")).alias("year"), fn.earliest_date(F.array(c("t"), F.lit("1995-06-17"), F.lit("x"))).alias("earliest"), fn.set_time(c("t")).alias("given"),
    )


@query("json_lists", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand || '|' || p_type END AS texts FROM part""")
def json_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 4 == 0, "{bad").otherwise(F.concat(F.lit('["'), F.col("p_brand"), F.lit('", 1, null, "'), F.col("p_type"), F.lit('", {"a": 2}]')))
    return table(spark, d, "part").withColumn("j", text).select("p_partkey", F.array_join(fn.json_strings(F.col("j")), "|").alias("texts"))


@query(
    "extra_numbers",
    "SELECT l_orderkey, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n > 4), '') AS extra, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS signature FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem) GROUP BY 1",
)
def extra_numbers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("x"))
    return a.select("l_orderkey", F.array_join(rel.extra_numbers(F.col("x"), F.lit(4)), ",").alias("extra"), F.array_join("x", ",").alias("signature"))


@query("safe_progress", "SELECT coalesce(min(event_id) FILTER (WHERE event_type = 'error') - 1, max(event_id)) AS safe FROM events")
def safe_progress(spark: SparkSession, d: str) -> DataFrame:
    return microbatch.safe_progress(table(spark, d, "events"), "event_id", F.col("event_type") == "error")


@query(
    "stale_leases",
    """WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'done' ELSE 'running' END AS status, CASE WHEN event_id % 3 > 0 THEN ts END AS h, ts - INTERVAL 1 HOUR AS s FROM events)
       SELECT event_id FROM r, n WHERE status = 'running' AND coalesce(h, s) < now - INTERVAL 5 MINUTE""",
)
def stale_leases(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    runs = events.select("event_id", F.when(F.col("event_type") == "error", "done").otherwise("running").alias("status"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("heartbeat_at"), (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("started_at"))
    return planning.stale_leases(runs, now).select("event_id")


@query(
    "candidate_scores",
    """WITH c AS (SELECT o_orderkey, o_custkey % 9 AS hit, o_custkey % 11 / 10.0 AS sim, year(o_orderdate) AS y, o_orderkey % 30 AS n, CASE WHEN o_orderkey % 4 > 0 THEN 12 END AS e FROM orders)
       SELECT o_orderkey, CASE WHEN hit = 0 THEN 1000 WHEN hit = 1 THEN -1 WHEN sim < 0.5 OR abs(y - 1995) > 1 OR (n > 0 AND e IS NOT NULL AND n / 12 NOT BETWEEN 0.75 AND 1.35) THEN -1
       ELSE CASE abs(y - 1995) WHEN 0 THEN 30 ELSE 8 END + CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN n > 0 AND n = e THEN 15 WHEN n > 0 AND abs(n - e) <= 2 THEN 5 ELSE 0 END + CAST(floor(sim * 35 + 0.5) AS INT) END AS score FROM c""",
)
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mapped = F.when(c % 9 == 0, F.array(F.lit("8"), F.lit("9"))).when(c % 9 == 1, F.array(F.lit("7"))).otherwise(F.array().cast("array<string>"))
    score = scoring.candidate_score(mapped, F.lit(False), F.lit("8"), c % 11 / 10.0, F.year("o_orderdate"), F.lit(1995), F.when(k % 2 == 0, "Fall").otherwise("SPRING"), F.lit("FALL"), k % 30, F.when(k % 4 > 0, 12))
    return table(spark, d, "orders").select("o_orderkey", score.alias("score"))
