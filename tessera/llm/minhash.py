"""Near duplicates by MinHash: banded candidates, sequential Bayesian pruning, exact verification.

A set of word shingles has HASHES minima. Sets that agree on all minima of one band are candidates; at a similarity of
0.8 a pair agrees on no band with a chance of 5e-8. Minima of candidates are compared batch by batch. After each batch
a pair is given up if, by the minima that agreed so far, the posterior chance that it is as similar as asked is below
MISS (uniform prior; a band that is known to agree only raises it). Survivors are verified on their words.

Equal sets are one class and are compared once; classes of a bucket are linked through its least member and what that
leaves apart, as the n-gram join does: no bucket's members are paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .njoin import Search, classes_by, mix, prepared

WORDS, NUMERATOR, DENOMINATOR = 4, 80, 100
#: Minima of a set, minima of a band, minima compared at a time.
HASHES, BAND, BATCH = 128, 4, 16
#: Chance of giving up a pair that is as similar as asked, after any batch.
MISS = 1e-9

_U = np.uint64


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each minimum, the second odd: h is taken to (h ^ first) * second."""
    n = np.arange(2 * HASHES, dtype=np.uint64) + _U(1)
    mixed = mix(n * _U(0x9E3779B97F4A7C15))
    return mixed[:HASHES], mixed[HASHES:] | _U(1)


def minima(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """HASHES minima of each document's hashes, ordered by document; all ones for a document without any."""
    out = np.full((n_docs, HASHES), np.iinfo(np.uint64).max, dtype=np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for i, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
            x = (h ^ a) * b
            out[doc[first], i] = np.minimum.reduceat(x ^ (x >> _U(32)), first)
    return out


def short(minimum: np.ndarray) -> np.ndarray:
    """32 bits of each minimum: two that differ agree in these with a chance of 2e-10."""
    return (mix(minimum) >> _U(33)).astype(np.int32)


def buckets(m: np.ndarray) -> np.ndarray:
    """A number for each band of each row of minima, band by band: rows with equal ones agree on that band."""
    found = []
    for b in range(HASHES // BAND):
        key = np.full(len(m), b + 1, dtype=np.uint64)
        for i in range(BAND):
            key = mix(key * _U(0x94D049BB133111EB) + m[:, b * BAND + i])
        found.append(key)
    return np.concatenate(found)


@cache
def least_matches(num: int, den: int, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal minima with which a pair is not given up.

    With m of n minima equal and a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1); its chance to be
    num / den or more is the chance that a binomial variable of n + 1 trials is at most m.
    """
    t = num / den
    least = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # The terms of the binomial distribution by ratios, from their logarithms.
        k = np.arange(n + 2)
        steps = np.concatenate([[0.0], np.cumsum(np.log((n + 1 - k[:-1]) / (k[:-1] + 1)))])
        with np.errstate(divide="ignore", invalid="ignore"):
            at_most = np.cumsum(np.exp(steps + k * np.log(t) + (n + 1 - k) * np.log1p(-t))) if t < 1 else (k > n).astype(float)
        least.append(int(np.argmax(at_most[: n + 1] >= miss)) if t < 1 else n)
    return tuple(least)


def may_be_similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows of two matrices of minima survive all batches; a pair that is given up is compared no further."""
    alive = np.arange(max(len(a), len(b)))
    a, b = np.broadcast_to(a, (len(alive), HASHES)), np.broadcast_to(b, (len(alive), HASHES))
    equal = np.zeros(len(alive), dtype=np.int64)
    for i, least in enumerate(least_matches(num, den)):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= least]
    mask = np.zeros(len(equal), dtype=bool)
    mask[alive] = True
    return mask


def _banded(num: int, den: int) -> Search:
    def marks(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, own = minima(doc, h, n_docs), np.unique(doc)
        return np.tile(own, HASHES // BAND), buckets(m[own]), short(m)

    def sketches(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
        return short(minima(doc, h, n_docs))

    def near(pairs: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f.loc[may_be_similar(np.stack(f["s_a"]), np.stack(f["s_b"]), num, den), ["a", "b"]]

        return pairs.select("a", "s_a", "b", "s_b").mapInPandas(run, "a long, b long")

    def close(s: np.ndarray, n: int, rest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return may_be_similar(s[None, :], rest, num, den)

    return Search(lambda docs, k, seed: prepared(docs, k, seed, marks), near, sketches, close)


def near_classes(docs: DataFrame, k: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row per input row: doc_id, body, n_shingles, component_id, class_id, as ``njoin.similar_classes`` has them.

    Two documents link when ``den * intersection >= num * union`` of their distinct k-word shingles (words lie between
    ASCII white space, A-Z are lower-cased; a text with fewer than k words is one shingle). component_id is the least
    doc_id that links lead to, the document's own included. Null and word-free texts have no shingles, link with nothing
    and are their own component. Rows that repeat a doc_id have equal results if their texts are equal. Null doc_ids take
    part and never name a component unless all of its ids are null. Only doc_id and text are read, whatever other columns
    are called; an empty table gives an empty result.

    A pair exactly as similar as asked (at 0.8) has no band in common with a chance of 5e-8; below a similarity of 0.8 the
    chance is larger, so ``num / den`` of 0.7 or more is asked for.
    """
    if 10 * num < 7 * den:
        raise ValueError("bands of four minima miss pairs with a similarity below 0.7")
    return classes_by(_banded(num, den), docs, k, num, den)


#: The links by all pairs that share a shingle.
OP11_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, pairs.y FROM reach JOIN pairs ON reach.r = pairs.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.r) AS component_id, s.doc_id = min(r.r) AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""


def op11_minhash_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row: four-word shingles, similarity 0.8.

    Nulls, empty texts, ties, repeated rows and empty tables: as ``near_classes`` says; kept is null for a null doc_id with
    a null component_id.
    """
    found = near_classes(docs)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
