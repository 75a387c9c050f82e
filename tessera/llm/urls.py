"""URL filter by a character language-model ratio.

Two smoothed variable-order Markov models (contexts of 0 to 3 characters, Witten-Bell interpolation) give the
likelihood of a URL among accepted and among rejected ones. Their difference, divided by the length, is held
against a threshold calibrated between seeded hosts and hosts under allow rules. A host's URLs are scored by models
that have not seen the host, and a host counts once, however many URLs it has. The counts come from every URL,
through Spark; the models are dense tables over a fixed alphabet, so what is broadcast has a fixed size
(FOLDS x ALPHABET ** 4 numbers).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rules (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Words that commonly mark spam, gambling, adult, pharmacy and tracking hosts, as seeds of the rejected class.
SEEDS = ("ads", "adserver", "adult", "bets", "betting", "bonus", "casino", "cheap", "click", "coupon", "dating", "escort", "free", "gambling", "jackpot", "loan", "lottery", "pharma", "pills", "poker", "porn", "promo", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx")
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789.-/"
ORDER = 3
SIZE = len(SYMBOLS) + 1  # one more for any other character; 40
#: Hosts are dealt into so many folds; each is scored by models of the others.
FOLDS = 4


def parts(url: Column) -> tuple[Column, Column]:
    """host and path as the rules use them; both empty for null and for a URL without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def evidence(url: Column) -> Column:
    """What the models read: host, path and query, lower-cased where the host is; empty without a host."""
    rest = F.regexp_extract(url, r"(?s)://([^/?#]*[^#]*)", 1)
    host, path = parts(url)
    query = F.regexp_extract(rest, r"(?s)^[^?]*(\?.*)$", 1)
    return F.when(host == "", "").otherwise(F.concat(host, path, query))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def codes(text: str) -> np.ndarray:
    """Symbol numbers of a URL, with ORDER separators in front so that the first characters have a context too."""
    raw = np.frombuffer(("/" * ORDER + text).encode("ascii", "replace"), dtype=np.uint8)
    return _TABLE[raw]


_TABLE = np.full(256, SIZE - 1, dtype=np.int64)
for _i, _c in enumerate(SYMBOLS):
    _TABLE[ord(_c)] = _i
    _TABLE[ord(_c.upper())] = _i


def grams(text: str) -> np.ndarray:
    """The gram number of each character after its ORDER predecessors."""
    c = codes(text)
    return ((c[:-3] * SIZE + c[1:-2]) * SIZE + c[2:-1]) * SIZE + c[3:]


def gram_counts(urls: DataFrame) -> DataFrame:
    """(fold, rejected, gram, n) over all rows of ``urls`` (text, site, rejected); n: sites with the gram. Each task sends a site's gram once a batch."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (site, flag), own in f.groupby(["site", "rejected"]):
                yield pd.DataFrame({"site": site, "rejected": bool(flag), "gram": np.unique(np.concatenate([grams(t) for t in own["text"]]))})

    found = urls.where("text IS NOT NULL").mapInPandas(count, "site long, rejected boolean, gram long").distinct()
    return found.groupBy(fold_of(F.col("site")).alias("fold"), "rejected", "gram").agg(F.count("*").alias("n"))


def fold_of(site: Column) -> Column:
    return F.pmod(site, F.lit(FOLDS)).cast("int")


def log_model(n: np.ndarray) -> np.ndarray:
    """log P(character | up to three before), from counts of four-grams, by Witten-Bell interpolation."""
    counts = n.reshape((SIZE,) * (ORDER + 1)).astype(np.float64)
    p = np.full(SIZE, 1.0 / SIZE)
    for order in range(ORDER + 1):
        c = counts.sum(axis=tuple(range(ORDER - order))) if order < ORDER else counts
        total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = (c + kinds * p) / np.maximum(total + kinds, 1) + (total == 0) * p
    return np.log(p).astype(np.float32).ravel()


def fit(urls: DataFrame, seeds: tuple[str, ...] = SEEDS) -> np.ndarray:
    """By fold, the table log P(accepted) - log P(rejected) by gram, from the other folds' sites and the seed words.

    ``urls``: text, site, rejected.
    """
    counts = staged(gram_counts(urls), "url-grams")
    own = np.zeros((FOLDS, 2, SIZE ** (ORDER + 1)), dtype=np.int64)
    for k in range(FOLDS):
        found = counts.where(F.col("fold") == k).toPandas()  # at most 2 x SIZE ** 4 rows, whatever the input
        own[k, found["rejected"].to_numpy(dtype=int), found["gram"].to_numpy(dtype=int)] = found["n"]
    whole = own.sum(axis=0)
    for word in seeds:
        np.add.at(whole[1], grams(word), 1)
    return np.stack([log_model(whole[0] - own[k, 0]) - log_model(whole[1] - own[k, 1]) for k in range(FOLDS)])


def score(urls: DataFrame, tables: np.ndarray) -> DataFrame:
    """Adds ``ratio`` to (text, site): the mean log-likelihood difference per character (0 for null or empty)."""
    shared = urls.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("double")
    def ratio(texts: pd.Series, folds: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series([float(own[k][grams(t)].mean()) if t else 0.0 for t, k in zip(texts, folds, strict=True)])

    return urls.withColumn("ratio", ratio(F.coalesce(F.col("text"), F.lit("")), fold_of(F.col("site"))))


def threshold(bad: np.ndarray, good: np.ndarray, at: np.ndarray) -> float:
    """The cut with the least sum of error shares, nearest to zero: ``bad`` and ``good`` hosts by ratio ``at`` (ascending).

    A class without hosts says nothing: the cut is zero, where both models are equally likely.
    """
    if not bad.sum() or not good.sum():
        return 0.0
    cuts = np.concatenate([at[:1] - 1, (at[1:] + at[:-1]) / 2, at[-1:] + 1, [0.0]])
    below = np.searchsorted(at, cuts)
    caught, lost = np.append(0, bad.cumsum())[below], np.append(0, good.cumsum())[below]
    error = (1 - caught / bad.sum()) + lost / good.sum()
    best = cuts[error <= error.min() + 1e-12]
    return float(best[np.abs(best).argmin()])


def is_seed(text: Column, seeds: tuple[str, ...] = SEEDS) -> Column:
    """Does a part of the URL, between other characters than letters and digits, equal a seed word?"""
    return F.coalesce(text.rlike(rf"(?i)(^|[^a-z0-9])({'|'.join(seeds)})([^a-z0-9]|$)"), F.lit(False))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio for every row of ``pages``.

    The models are trained on and score host, path and query; rejected URLs are those with a seed word as a part of
    any of these, and the models generalise to URLs like them. The threshold parts seeded hosts from unseeded ones
    under allow rules, each host by its mean ratio; any share of the other URLs may be blocked. Null and malformed
    URLs have ratio 0 and are allowed, as are all where no URL is seeded or all are. Rows that repeat are judged alike; an
    empty table gives no rows. Only page_id and url are read, whatever else the table has.
    """
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"), evidence(F.col("url")).alias("text")).withColumn("site", F.xxhash64("host"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = seen.where("host <> ''").select("host", "site", "text", is_seed(F.col("text"), seeds).alias("rejected"), (verdict == "allow").alias("vouched"))
    tables = fit(known.select("text", "site", "rejected"), seeds)
    per_host = score(known, tables).groupBy("host", "rejected").agg(F.avg("ratio").alias("any"), F.avg(F.when(F.col("vouched"), F.col("ratio"))).alias("vouched"))
    level = F.round(F.when(F.col("rejected"), F.col("any")).otherwise(F.col("vouched")), 3)
    levels = per_host.groupBy(level.alias("at")).agg(F.count_if("rejected").alias("bad"), F.count_if(~F.col("rejected")).alias("good")).toPandas()  # as many as there are thousandths
    both, levels = levels["bad"].sum() and levels["good"].sum(), levels.dropna().sort_values("at")
    limit = threshold(*(levels[c].to_numpy() for c in ("bad", "good", "at"))) if both else float("-inf")
    judged = score(seen, tables).withColumns({"rule": name, "ruled": verdict})
    own = F.when((F.col("ratio") < F.lit(limit)) & (F.col("host") != ""), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "ratio")


def ruled(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (null without a rule) for every row: the part of ``judge`` that SQL can say too."""
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return seen.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))


RULES_SQL = r"""
WITH r(h, p, v) AS (VALUES {rules}), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, f.rule, f.verdict FROM s
LEFT JOIN LATERAL (
  SELECT h || p AS rule, v AS verdict FROM r WHERE (s.host = h OR s.host LIKE '%.' || h) AND starts_with(s.path, p) ORDER BY length(h || p) DESC LIMIT 1
) f ON TRUE
""".format(rules=", ".join(map(str, RULES)))


def op7_url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio of every row; nulls, ties, repeats and empty tables: as ``judge`` says."""
    return judge(pages)
