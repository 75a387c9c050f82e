"""Exact groups come from chunk recipes, whatever the chunks' short names are worth."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact

from .test_operators import LOWER, words

DOCS = "doc_id BIGINT, text STRING, row INT"


def rows():
    rng = random.Random(6)
    parts = [words(rng, 700) + ". " for _ in range(6)]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(60)]
    texts += [t.upper() for t in texts[:20]] + [None, "", None, "x", "X", "é" * 9000, "É" * 9000]
    out = [(i, t, 1) for i, t in enumerate(texts)]
    return [*out, out[3], (None, texts[0], 1), (None, "alone", 1), (None, "alone", 1)]


@pytest.mark.parametrize("weak", [None, 2, 1])
def test_groups_equal_plain_comparison(spark, monkeypatch, weak):
    if weak:  # all chunks share two names, or one: only the verified contents tell them apart
        monkeypatch.setattr(exact, "fingerprint", lambda c: F.pmod(F.xxhash64(c), F.lit(weak)))
    groups = {}
    for d, t, _ in rows():
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    found = exact.exact_groups(spark.createDataFrame(rows(), DOCS)).collect()
    key = lambda d: (d is not None, d or 0)
    want = sorted((key(d), key(max(ids, key=key)), len(ids)) for ids in groups.values() for d in ids)
    assert sorted((key(r["doc_id"]), key(r["keep_id"]), r["group_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_order_of_chunks_matters(spark):
    a, b = ("".join(random.Random(i).choices("abcdefgh ", k=1100)) + "." for i in (1, 2))
    found = exact.exact_groups(spark.createDataFrame([(1, a + b, 0), (2, b + a, 0), (3, a + b, 0)], DOCS)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["n_chunks"]) for r in found} == {1: (3, 2), 2: (2, 2), 3: (3, 2)}


def test_the_store_holds_each_chunk_once(spark):
    store = exact.chunk_store(exact.chunked(spark.createDataFrame([(i, "same text", 0) for i in range(50)] + [(99, "other", 0)], DOCS))).collect()
    assert sorted((r["n_refs"], len(r["contents"])) for r in store) == [(1, 1), (50, 1)]
