"""Which titles, candidates and mappings belong together."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import grams, tokens, year_of
from tessera.sources.shared import staged

from .classify import first_reason
from .relational import dealt, distinct_on

#: Thresholds of the ambiguous-mapping rules, source priorities, and the names of classes, verdicts and reasons.
TITLE, YEARS, COUNTS, RETIRE_YEARS, RETIRE_COUNTS = 0.72, 1, 2, 10, 20
PRIORITY = {"manual": 5, "system": 4, "api": 3, "import": 3, "fuzzy": 1}
MATCHES = ("strong-match", "mismatch", "likely-match", "indeterminate")
BLOCKED = ("missing-provider-evidence", "malformed-provider-id", "provider-entity-not-found", "provider-fetch-failed", "no-verified-identity-proof-and-no-explicit-contradiction")
RETIRED = ("title-contradiction-with-substantially-wrong-year", "title-contradiction-with-substantially-wrong-count")
VERDICTS = ("exactly-one-strong-match", "multiple-strong-match", "no-strong-match")


#: How many of the most frequent tokens and grams have their frequencies broadcast (some 30 bytes each; others count as
#: rare), how many parts a signature takes together at most, and the most signatures of a title that takes more than one.
BROADCAST_PARTS, TOGETHER, SIGNATURES = 200_000, 4, 64


def _shared(n: Column, share: Column) -> Column:
    """How many of its ``n`` parts a title has in common with any that is similar, at least."""
    return F.greatest(F.ceil(n * share - 1e-9), F.lit(1)).cast("int")


def _taken(n: Column, share: Column) -> Column:
    """How many parts a signature of a title of ``n`` parts takes together: TOGETHER, or less where these would be too many signatures."""
    must = _shared(n, share)
    fits = {k: max(d for d in range(SIGNATURES) if comb(d + k, k) <= SIGNATURES) for k in range(2, TOGETHER + 1)}
    return F.coalesce(*[F.when((must >= k) & (n - must <= d), k) for k, d in sorted(fits.items(), reverse=True)], F.lit(1))


def _rarest(titles: DataFrame, least: float) -> DataFrame:
    """(id, kind, l, r, n, b0, b1, spare, taken, xs): of ``titles`` (id, title, l, r) how many tokens and grams they have, the bits
    that stand for these, and the rarest, as ``_signed`` takes them."""
    c = F.col
    hashed = lambda kind, xs: F.transform(xs, lambda x: F.xxhash64(F.lit(kind), x)).alias("xs")
    parts = F.array(*[F.struct(F.lit(kind).alias("kind"), hashed(kind, of(c("title")))) for kind, of in (("t", tokens), ("g", grams))])
    apart = titles.select("id", "l", "r", F.inline(parts)).select("*", F.explode("xs").alias("x")).drop("xs")
    often = staged(apart.groupBy("x").agg(F.count("*").alias("often")).orderBy(c("often").desc(), "x").limit(BROADCAST_PARTS), "often")
    ranked = apart.join(F.broadcast(often), "x", "left").groupBy("id", "kind", "l", "r").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "x"))).alias("xs"))
    # Of n parts at least this many are shared: least x n of tokens (Jaccard), least / (2 - least) x n of grams (Dice).
    share, n = F.when(c("kind") == "t", least).otherwise(least / (2 - least)), c("n")
    sizes = F.sequence(_shared(n, share), F.floor(n / share + 1e-9).cast("int"))
    taken = F.array_distinct(F.transform(sizes, lambda s: F.least(_taken(n, share), _taken(s, share))))
    bits = [F.expr(f"aggregate(filter(xs, x -> (x & 64) = {64 * i}), 0L, (b, x) -> b | shiftleft(1L, CAST(x & 63 AS INT)))").alias(f"b{i}") for i in (0, 1)]
    sized = ranked.withColumn("xs", c("xs.x")).withColumn("n", F.size("xs"))
    return staged(sized.select("id", "kind", "l", "r", "n", *bits, (n - _shared(n, share)).alias("spare"), taken.alias("taken"), F.slice("xs", 1, n - _shared(n, share) + TOGETHER).alias("xs")), "rare")


def _signed(rare: DataFrame) -> DataFrame:
    """``rare`` (n, spare, taken, xs ...) with a row for each signature ``sig`` of ``xs``, a title's rarest parts, from the rarest on.

    Of n parts ``spare`` may be missing in a similar title. Of the spare + k rarest then k are shared at least, and one choice of
    k is a signature of both. Two titles meet by the lesser of the numbers that either takes: ``taken`` are all that occur.
    """
    c, most = F.col, range(2, TOGETHER + 1)
    chosen = [(k, d, [*at, *[None] * (TOGETHER - k)]) for k in most for d in range(SIGNATURES) if comb(d + k, k) <= SIGNATURES for at in combinations(range(d + k), k)]
    choices = rare.sparkSession.createDataFrame(chosen, "k INT, spare INT, at ARRAY<INT>")
    each = rare.select("*", F.explode("taken").alias("k")).drop("taken")
    alone = each.where("k = 1").select("*", F.explode(F.slice("xs", 1, c("spare") + 1)).alias("sig"))
    several = each.join(F.broadcast(choices), ["k", "spare"])
    sig = reduce(Column.bitwiseXOR, [F.coalesce(F.get("xs", F.get("at", F.lit(i))), F.lit(0)) for i in range(TOGETHER)])
    return alone.drop("xs", "k", "spare").unionByName(several.withColumn("sig", sig).drop("xs", "k", "spare", "at"))


def similar_titles(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) for all pairs of ``left`` (a, title) and ``right`` (b, title) that are similar by ``least`` (above 0) or more.

    Titles are comparable ones, an id may have several; the best pair counts. Each different title is taken apart once,
    into hashes of its tokens and of its grams. Similar titles share several of their rarest parts and meet by a signature, which
    takes some of these together: single parts are shared by ever more titles of a larger table, several at once hardly are.
    Pairs that meet are told apart by their sizes and by 128 bits that stand for their parts; what passes is judged by the texts.
    """
    c = F.col
    texts = reduce(DataFrame.unionByName, [df.where("title <> ''").select("title", F.lit(i == 0).alias("l"), F.lit(i == 1).alias("r")) for i, df in enumerate((left, right))])
    titles = staged(texts.groupBy("title").agg(F.max("l").alias("l"), F.max("r").alias("r")).withColumn("id", F.monotonically_increasing_id()), "titles")
    rare = _rarest(titles, least)
    signed = [_signed(rare.where(side).drop("l", "r")).withColumnsRenamed({x: f"{x}{end}" for x in ("id", "kind", "n", "b0", "b1")}) for side, end in (("l", "a"), ("r", "b"))]
    # Sets of such different sizes can't be as similar, nor sets that differ in so many parts.
    share = F.when(c("kinda") == "t", least).otherwise(least / (2 - least))
    near = F.least("na", "nb") >= F.greatest("na", "nb") * share - 1e-9
    differ = reduce(Column.__add__, [F.bit_count(c(f"{b}a").bitwiseXOR(c(f"{b}b"))) for b in ("b0", "b1")])
    few = differ <= (c("na") + c("nb")) * F.when(c("kinda") == "t", (1 - least) / (1 + least)).otherwise(1 - least) + 1e-9
    pairs = signed[0].join(dealt(signed[1]), "sig").where((c("kinda") == c("kindb")) & near & few & (c("ida") != c("idb"))).select("ida", "idb").distinct()
    for side, end in (("l", "a"), ("r", "b")):
        pairs = pairs.join(dealt(titles.where(side).select(c("id").alias(f"id{end}"), c("title").alias(f"text{end}"))), f"id{end}")
    told = pairs.select("ida", "idb", *[of(c(f"text{end}")).alias(f"{kind}{end}") for kind, of in (("t", tokens), ("g", grams)) for end in "ab"])
    told = told.select("ida", "idb", *[F.size(F.array_intersect(f"{k}a", f"{k}b")).alias(k) for k in "tg"], *[(F.size(f"{k}a") + F.size(f"{k}b")).alias(f"{k}s") for k in "tg"])
    judged = told.select("ida", "idb", F.greatest(c("t") / (c("ts") - c("t")), 2.0 * c("g") / c("gs")).alias("similarity")).where(c("similarity") >= least)
    same = titles.where("l AND r").select(c("id").alias("ida"), c("id").alias("idb"), F.lit(1.0).alias("similarity")).where(c("similarity") >= least)
    named = [df.where("title <> ''").join(dealt(titles.select("id", "title")), "title").select(c("id").alias(f"id{key}"), key).distinct() for df, key in ((left, "a"), (right, "b"))]
    return judged.unionByName(same).join(dealt(named[1]), "idb").join(dealt(named[0]), "ida").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def best_per_candidate(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """The row of the greatest score of each candidate; of equal ones that with the least ``tie``."""
    return distinct_on(rows, key, [F.col(score).desc(), F.col(tie)])


def preferred(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The preferred mapping of each group: primary, then by source, confidence, time and id (is_primary, source, confidence, updated_at, id)."""
    priority = F.coalesce(*[F.when(F.col("source") == s, n) for s, n in PRIORITY.items()], F.lit(0))
    return distinct_on(rows, keys, [F.col("is_primary").desc(), priority.desc(), F.col("confidence").desc(), F.col("updated_at").desc_nulls_last(), F.col("id").desc()])


def match_class(rows: DataFrame) -> DataFrame:
    """``rows`` with match, repair, scope and block: how a candidate mapping fits, and whether it may be kept or retired.

    Columns: status (of the provider's evidence: ok, malformed, not-found, fetch-failed; null for none), similarity (best
    over titles), start_date, season_year, episode_count of the own title; show_aired, season_aired, show_count,
    season_count of the candidate. Dates are texts. Evidence of the show and of the season is never mixed for a keep.
    """
    c = F.col
    ok = c("status").eqNullSafe("ok")
    title = F.coalesce(c("similarity") >= TITLE, F.lit(False))
    start = F.nullif(F.trim("start_date"), F.lit(""))
    year = F.coalesce(year_of(c("start_date")), c("season_year"))
    years = F.least(*[F.abs(year_of(c(x)) - year) for x in ("show_aired", "season_aired")])
    count = F.when(c("episode_count") > 0, c("episode_count"))
    apart = {x: F.abs(F.when(c(f"{x}_count") > 0, c(f"{x}_count")) - count) for x in ("season", "show")}
    exact = {x: F.coalesce(c(f"{x}_aired") == start, F.lit(False)) for x in ("season", "show")}
    near_year, near_count = F.coalesce(years <= YEARS, F.lit(False)), F.coalesce(apart["season"] <= COUNTS, F.lit(False))
    match = first_reason(*zip(MATCHES, (
        ok & title & (exact["season"] | exact["show"] | near_year & near_count), ok & ~title & F.coalesce(years > 2, F.lit(True)), ok & title & (near_year | near_count), F.lit(True),
    ), strict=True))
    scope = first_reason(*[(x, ok & title & exact[x] & F.coalesce(apart[x] == 0, F.lit(False))) for x in ("season", "show")])
    wrong = first_reason(*zip(RETIRED, (ok & ~title & (years >= RETIRE_YEARS), ok & ~title & (F.least(apart["season"], apart["show"]) >= RETIRE_COUNTS)), strict=True))
    why = first_reason(*zip(BLOCKED, (c("status").isNull(), c("status") == "malformed", c("status") == "not-found", c("status") == "fetch-failed", F.lit(True)), strict=True))
    repair = F.when(scope.isNotNull(), "verified-keep").when(wrong.isNotNull(), "verified-retire").otherwise("not-repair-safe")
    return rows.withColumns({"match": match, "repair": repair, "scope": scope, "block": F.when(scope.isNull(), F.coalesce(wrong, why))})


def group_verdict(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, verdict, repair_safe): of ``match_class`` rows. Safe: one to keep, all others to retire, two at least."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    a = rows.groupBy(*keys).agg(F.count("*").alias("n"), n("match", MATCHES[0]).alias("strong"), n("repair", "verified-keep").alias("keep"), n("repair", "verified-retire").alias("retire"))
    verdict = first_reason(*zip(VERDICTS, (F.col("strong") == 1, F.col("strong") > 1, F.lit(True)), strict=True))
    return a.select(*keys, "n", verdict.alias("verdict"), ((F.col("n") >= 2) & (F.col("keep") == 1) & (F.col("retire") == F.col("n") - 1)).alias("repair_safe"))


def ambiguity_report(candidates: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """(measure, value, n): how many groups have each verdict and how many are safe to repair, and how many candidates have
    each class and each repair status.

    ``candidates`` as ``match_class`` takes them; groups without a row in ``identities`` (key) are left out. A group is
    all candidates of a title, of whichever provider.
    """
    judged = match_class(candidates.join(identities.select(key).distinct(), key, "left_semi"))
    verdicts = group_verdict(judged, [key]).select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in (("verdict", F.col("verdict")), ("repair-safe", F.col("repair_safe").cast("string")))])))
    classes = judged.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(v).alias("value")) for m, v in (("class", "match"), ("repair", "repair"))])))
    return verdicts.unionByName(classes).groupBy("measure", "value").agg(F.count("*").alias("n"))


def distinct_titles(titles: Column) -> Column:
    """The array's titles, trimmed, without blank ones and without repeats in other letter case; the first spelling stays."""
    clean = F.filter(F.transform(titles, lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(clean, F.array().cast("array<string>"), lambda got, t: F.when(F.exists(got, lambda g: F.lower(g) == F.lower(t)), got).otherwise(F.concat(got, F.array(t))))


def unique_slugs(rows: DataFrame, slug: str, key: str, taken: DataFrame, stamp: str) -> DataFrame:
    """``rows`` with a slug of their own, as if they came one by one in order of their whole-number key: the slug (the key
    for a blank one); if ``taken`` (slug) or a row before has it, with the key behind it; if that is taken too, with
    ``stamp`` behind both.

    A row before may have got its slug with its key behind it. That row's slug and key are the two parts of this one, so
    each such chain is a join for each ``-number`` at the slugs' ends, of which the longest slug decides how many.
    """
    c = F.col
    base = F.when(F.coalesce(F.trim(slug), F.lit("")) == "", c(key).cast("string")).otherwise(c(slug))
    own = rows.withColumn("_one", base)
    held = taken.select(c(slug).alias("_held")).distinct()
    ids = own.select("_one", c(key).alias("_id"))
    first = ids.groupBy("_one").agg(F.min("_id").alias("_first"))
    ids = ids.join(first, "_one").join(held, c("_one") == c("_held"), "left")
    # Lost for sure: taken, or a smaller key asks for it too. Then by chains, from their shortest slug on.
    parts = r"^(.+)-(\d+)$"
    before, number = F.regexp_extract("_one", parts, 1), F.regexp_extract("_one", parts, 2).try_cast("long")
    lost = ids.select("_one", "_id", before.alias("_p"), number.alias("_n"), (c("_held").isNotNull() | (c("_id") > c("_first"))).alias("_lost"))
    ends = lost.agg(F.max(F.length(F.regexp_extract("_one", r"((?:-\d+)*)$", 1)) - F.length(F.replace(F.regexp_extract("_one", r"((?:-\d+)*)$", 1), F.lit("-")))).alias("n")).first()["n"] or 0
    for _ in range(ends):
        losers = lost.where("_lost").select(c("_one").alias("_q"), c("_id").alias("_m")).distinct()
        joined = lost.join(losers, (c("_p") == c("_q")) & (c("_n") == c("_m")) & (c("_m") < c("_id")), "left")
        lost = joined.select("_one", "_id", "_p", "_n", (c("_lost") | c("_q").isNotNull()).alias("_lost"))
    two = F.concat_ws("-", "_one", c("_id").cast("string"))
    losing = lost.where("_lost").select("_one", "_id", two.alias("_two"))
    asked = first.select(c("_one").alias("_two"), c("_first").alias("_other"))
    second = losing.join(asked, "_two", "left").join(held, c("_two") == c("_held"), "left")
    given = second.select("_one", "_id", F.when(c("_held").isNull() & (c("_other").isNull() | (c("_other") > c("_id"))), c("_two")).otherwise(F.concat_ws("-", "_two", F.lit(stamp))).alias("_given")).distinct()
    out = own.withColumn("_id", c(key)).join(given, ["_one", "_id"], "left")
    return out.withColumn(slug, F.coalesce("_given", "_one")).select(*rows.columns)
