"""MinHash near duplicates against all pairs, the pruning table against the posterior itself, hot buckets and hard rows."""

import random

import numpy as np
import pytest

from tessera.llm import minhash, njoin

from .test_operators import DOC, EXTRA, brute_components, hard_rows, words

ID = "doc_id BIGINT, text STRING"


def classes(found):
    return {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()}


@pytest.mark.parametrize(("k", "num"), [(4, 80), (5, 80), (2, 95)])
def test_every_link_is_found(spark, k, num):
    rng, rows = random.Random(k), []
    for _ in range(40):
        w = words(rng, rng.choice([1, 3, 5, 12, 40, 150, 400])).split()
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    assert classes(minhash.near_classes(spark.createDataFrame(rows, ID), k, num, 100)) == brute_components(rows, k, num, 100)


def test_pairs_at_the_limit_itself(spark):
    """90 common shingles of 100 and 90 + x: links at 80 of 100 exactly, none just below."""
    rows = []
    for g in range(200):
        own = [f"a{g}w{i}" for i in range(93)]  # 90 shingles of four words
        for tail in (20, 21) if g % 2 else (10, 11):
            rows.append((len(rows), " ".join(own + [f"t{g}x{tail}y{i}" for i in range(tail)])))
        rows.append((len(rows), " ".join(own + [f"u{g}y{i}" for i in range(2 if g % 2 else 12)])))
    assert classes(minhash.near_classes(spark.createDataFrame(rows, ID))) == brute_components(rows, 4, 80, 100)


def test_fewest_matches_follow_the_posterior():
    x = (np.arange(1_000_000) + 0.5) / 1_000_000
    for miss in (1e-2, 1e-5):
        for i, least in enumerate(minhash.least_matches(80, 100, miss)):
            n = (i + 1) * minhash.BATCH

            def chance(m, n=n):
                density = x**m * (1 - x) ** (n - m)
                return density[x >= 0.8].sum() / density.sum()

            assert chance(least) >= miss * 0.999 and (least == 0 or chance(least - 1) < miss * 1.001)
    assert minhash.least_matches(100, 100) == tuple(range(16, 129, 16))


def test_pruning_keeps_similar_sets_and_drops_unlike_ones():
    rng = np.random.default_rng(3)
    for common, survive in ((0.85, True), (0.3, False)):
        equal = rng.random((20_000, minhash.HASHES)) < common
        a, b = np.zeros(equal.shape, dtype=np.int32), np.where(equal, 0, 1).astype(np.int32)
        assert (minhash.may_be_similar(a, b, 80, 100) == survive).mean() > 0.999


def test_large_buckets_are_searched_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(njoin, "SMALL", 3)
    monkeypatch.setattr(njoin, "BLOCK_SHINGLES", 600)
    rng, rows = random.Random(8), []
    base = words(rng, 90).split()
    for _ in range(12):  # families that share most of their text, so that buckets are hot
        family = base[:70] + words(rng, 30).split()
        for _ in range(3):
            own = list(family)
            own[rng.randrange(70, 100)] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    assert classes(minhash.near_classes(spark.createDataFrame(rows, ID))) == brute_components(rows, 4, 80, 100)


def test_hard_rows(spark):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in hard_rows()], DOC + EXTRA)
    found = minhash.op11_minhash_dedup(docs).collect()
    want = brute_components([r[:2] for r in hard_rows() if r[0] is not None], 4, 80, 100)
    assert len(found) == len(hard_rows())
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found if r["doc_id"] is not None)
    assert minhash.op11_minhash_dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="similarity"):
        minhash.near_classes(docs, 4, 50, 100)
