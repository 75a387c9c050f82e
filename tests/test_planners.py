"""Golden rows for scores, gates, transforms, leases."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import planning, scoring


def batch(numbers, year=2024):
    return [(1, 1, n, f"Part {i}", f"{year}-01-{(n - 1) % 28 + 1:02d}" if n else None) for i, n in enumerate(numbers)]


@pytest.mark.parametrize(("rows", "count", "known", "good"), [
    (batch(range(1, 13)), 12, 12, True), (batch(range(1, 13), 2020), 12, 12, False), (batch(range(1, 25)), 12, 12, False), (batch(range(13, 25)), 12, 12, False),
    (batch([*range(1, 12), 11]), 12, 12, False), (batch(range(1, 13)), None, 4, True), (batch([None, 1, 2]), None, 0, False), (batch(range(1, 4)), None, 0, True),
])
def test_batch_scores(spark, rows, count, known, good):
    batches = spark.createDataFrame(rows, "target INT, batch INT, number INT, title STRING, air_date STRING")
    own = spark.createDataFrame([(1, n, f"2024-01-{n:02d}") for n in range(1, known + 1)], "target INT, number INT, air_date STRING")
    contexts = spark.createDataFrame([(1, 2024, count)], "target INT, season_year INT, episode_count INT")
    score = scoring.batch_scores(batches, own, contexts, "target", "batch").first()["score"]
    assert (score is not None) == good
    if good and count == 12:
        assert score == 30 + 20 + 8 * 12 + 12


@pytest.mark.parametrize(("ids", "similarity", "year", "n", "want"), [
    (["8"], 0.1, 1990, 1, 1000), (["1123"], 1.0, 2004, 52, -1), ([], 0.4, 2004, 52, -1), ([], 1.0, 2001, 52, -1), ([], 1.0, 2004, 10, -1), ([], 1.0, 2004, 52, 100),
    (None, 0.5, 2005, 50, 8 + 20 + 5 + 18), ([], None, 2004, 52, -1), ([], 1.0, None, None, 55),
])
def test_candidate_score(spark, ids, similarity, year, n, want):
    row = spark.createDataFrame([(ids, similarity, year, n)], "ids ARRAY<STRING>, s DOUBLE, y INT, n INT")
    score = scoring.candidate_score(F.col("ids"), F.lit(False), F.lit("8"), F.col("s"), F.col("y"), F.lit(2004), F.lit("fall"), F.lit("FALL"), F.col("n"), F.lit(52))
    assert row.select(score).first()[0] == want


@pytest.mark.parametrize(("pairs", "season", "reason", "offset", "boundary"), [
    ([(13, 1), (18, 6), (24, 12)], range(1, 25), None, 12, "both-boundaries-observed"), ([(15, 3), (20, 8)], range(1, 25), None, 12, "internal-only"),
    ([(13, 1), (19, 6)], range(1, 25), "non-linear-observed-transform", None, None), ([(20, 1)], range(1, 25), "inferred-segment-outside-provider-season", None, None),
    ([(13, 1)], [*range(1, 20), *range(21, 30)], "inferred-segment-outside-provider-season", None, None), ([(13, 1), (99, 2)], range(1, 25), "missing-authoritative-provider-episode", None, None),
    ([(13, 13), (99, 14)], range(1, 25), "invalid-local-episode-number", None, None), ([(13, 1), (14, 1)], range(1, 25), "duplicate-local-episode-number", None, None),
    ([(13, 1), (13, 2)], range(1, 25), "duplicate-provider-episode-number", None, None), ([(13, 1)], [13, 13], "duplicate-provider-episode-number", None, None),
])
def test_observed_transform(spark, pairs, season, reason, offset, boundary):
    mapped = spark.createDataFrame([(1, p, x, 12) for p, x in pairs], "k INT, episode_id INT, local_number INT, n INT")
    episodes = spark.createDataFrame([(1, n, n) for n in season], "k INT, episode_id INT, number INT")
    row = planning.observed_transform(mapped, episodes, ["k"], "n").first()
    assert (row["reason"], row["offset"], row["boundary"]) == (reason, offset, boundary)


@pytest.mark.parametrize(("ranges", "numbers", "want"), [
    ((1, 12, 13, 24), range(1, 25), "exact-provider-partition"), ((1, 13, 13, 24), range(1, 25), "overlapping-inferred-segments"), ((1, 4, 5, 8), range(1, 24), "adjacent-provider-subset"),
    ((1, 4, 6, 8), range(1, 9), "disjoint-with-gap"), ((1, 4, 1, 4), range(1, 5), "same-inferred-segment"), ((1, 4, 5, 8), [1, 2, 3, 4, 5, 6, 7, 9], "adjacent-provider-subset"),
])
def test_dual_relation(spark, ranges, numbers, want):
    own = F.array(*[F.lit(n) for n in numbers])
    assert spark.range(1).select(planning.dual_relation(*[F.lit(x) for x in ranges], own)).first()[0] == want


def test_leases(spark):
    rows = spark.createDataFrame([(1, "running", None, "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:58:00", "2024-01-01 00:00:00"), (3, "done", None, "2024-01-01 00:00:00")], "id INT, status STRING, h STRING, s STRING")
    runs = rows.select("id", "status", F.to_timestamp("h").alias("heartbeat_at"), F.to_timestamp("s").alias("started_at"))
    assert [r["id"] for r in planning.stale_leases(runs, F.to_timestamp(F.lit("2024-01-01 01:00:00"))).collect()] == [1]


def test_empty_tables_have_no_candidates(spark):
    rows = spark.createDataFrame([], "k INT, a BOOLEAN")
    gates = [("a", F.col("a"))]
    assert planning.reason_counts(planning.gated(rows, gates)).count() == 0
    assert [tuple(r) for r in planning.passed_counts(rows, gates).collect()] == [("a", 0)]
