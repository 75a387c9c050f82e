"""The label model: synthetic voters of known worth, and held-out documents with and without it."""

import zlib

import numpy as np
import pytest

from tessera.llm import quality, toxicity

DATA = "/root/testdata/sf0.01"


def synthetic(n=6000, copies=2, seed=3):
    """One good voter, three fair ones, and copies of one poor voter."""
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.2
    voters = [np.where(rng.random(n) < np.where(y, hit, miss), toxicity.TOXIC, toxicity.SILENT) for hit, miss in ((0.8, 0.01), (0.6, 0.05), (0.6, 0.05), (0.6, 0.05))]
    poor = rng.random(n) < np.where(y, 0.5, 0.3)
    voters += [np.where(rng.random(n) < 0.02, ~poor, poor).astype(int) * 2 - 1 for _ in range(copies)]
    voters = [np.where(v > 0, toxicity.TOXIC, toxicity.SILENT) for v in voters]
    return np.stack(voters, axis=1).astype(np.int8), y


def test_copies_of_a_poor_voter_are_seen_as_such():
    votes, y = synthetic(copies=2)
    model, alone = (toxicity.label_model(votes, 0.2, np.arange(6) < 4, dependent=d) for d in (True, False))
    right = lambda m: ((m.posterior(votes) >= 0.5) == y).mean()
    majority = ((votes == 1).sum(1) >= 3) == y
    assert (model.parent[4] == 5) != (model.parent[5] == 4) and set(model.parent[:4]) == {-1}
    assert right(model) > 0.96 and right(model) >= right(alone) and right(model) > majority.mean() + 0.03


def test_the_model_finds_what_votes_are_worth():
    votes, y = synthetic(copies=1)
    chance = toxicity.label_model(votes, 0.2, dependent=False).chance
    for v, (hit, miss) in enumerate(((0.8, 0.01), (0.6, 0.05), (0.6, 0.05), (0.6, 0.05), (0.5, 0.3))):
        assert chance[1, v, 0, 2] == pytest.approx(hit, abs=0.08) and chance[0, v, 0, 2] == pytest.approx(miss, abs=0.04)


def test_without_the_label_model_held_out_documents_are_misjudged(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.training_rows(docs, labels, "toxic").toPandas()
    voters = toxicity.make_voters(toxicity.mine(spark.createDataFrame(rows)))
    votes_of = lambda texts: np.array([voters.votes(*[voters.hits(t or "")[i] for i in (0, 2)]) for t in texts])
    held = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").toPandas()
    held = held[[zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]]]
    votes, y = votes_of(held["text"]), held["toxic"].to_numpy() == 1
    model = toxicity.label_model(votes_of(rows["text"]), float(rows["y"].mean()), voters.trusted())
    right = ((model.posterior(votes) >= 0.5) == y).mean()
    any_vote = ((votes == toxicity.TOXIC).any(axis=1) == y).mean()
    majority = (((votes == toxicity.TOXIC).sum(1) > (votes == toxicity.CLEAN).sum(1)) == y).mean()
    assert right > 0.93 and right > any_vote + 0.05 and right > majority


def test_training_rows_are_bounded_though_an_id_repeats(spark):
    docs = spark.createDataFrame([(i % 3 + 1, f"text {i}") for i in range(300)] + [(None, "x")], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1)], "doc_id BIGINT, toxic INT")
    got = quality.training_rows(docs, labels, "toxic").collect()
    assert len(got) <= 2 and all(r["y"] == 1 for r in got)
    assert quality.training_rows(docs, labels, "toxic", 1).count() == 1
