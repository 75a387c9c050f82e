"""Steps that once failed on larger tables: no side of a row a group or an episode goes through the driver."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import title_similarity
from tessera.operators import classify, language, matching, planning
from tessera.plans import collisions, jobs, planners, repairs  # noqa: F401  (they add their queries to the catalogue)
from tessera.plans.catalogue import queries
from tessera.sources import shared, store
from tessera.streaming import live

DATA = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["transfer_plans", "suffix_plans", "observed_transforms", "merged_transform_job", "ownership_repair_job"])
def test_nothing_is_broadcast(spark, name):
    assert "Broadcast" not in planned(queries()[name](spark, DATA))


def test_keys_share_the_state_of_their_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 2)
    spark.range(60).selectExpr("id AS k", "TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, 0, id) AS at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k BIGINT, at TIMESTAMP").parquet(str(tmp_path / "in"))
    with live.keyed_state(spark):
        query = live.in_flight(stream, ["k"], "at", 120).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= 6  # a bucket's text and its timer (both ways)


@pytest.mark.parametrize("name", ["slug_repairs", "collision_segment_job"])
def test_addresses_are_taken_apart_once(spark, name):
    assert "regexp_extract" not in planned(queries()[name](spark, DATA))  # they lie in a table by then


def test_own_numbers_are_counted_in_one_exchange(spark):
    plan = planned(queries()["whole_season_plans"](spark, DATA))
    assert "count(distinct" not in plan and "Broadcast" not in plan


def numbered(spark, n):
    return spark.range(n).selectExpr("id", "concat('new hot ring ', 10000 + id * 7919 % 90000) AS title", "true AS l", "true AS r")


def test_titles_hardly_meet_more_often_in_larger_tables(spark):
    def meetings(n):
        alike = matching._signed(matching._rarest(numbered(spark, n), 0.9)).groupBy("kind", "sig").count()
        return alike.selectExpr("sum(count * count)").first()[0] / n

    assert meetings(8000) < 2 * meetings(2000)  # single parts: four times as often


@pytest.mark.parametrize("least", [0.4, 0.75, 0.9])
def test_similar_titles_are_all_found(spark, least):
    pick = random.Random(5)

    def made():
        words = [pick.choice(["a", "bo", "ring", "new", "hot", "season", "of the", "x" * 30]) for _ in range(pick.choice([1, 1, 2, 3, 5, 12]))]
        return " ".join([*words, str(pick.randrange(40))][pick.randrange(2) :]) or "z"

    sides = [[(i // 2 * 2, made()) for i in range(160)] for _ in "ab"]
    sides[1][:40] = [(i, t[: len(t) - i % 3] or t) for i, t in sides[0][:40]]
    left, right = (spark.createDataFrame(rows, f"{key} INT, title STRING").withColumn("title", F.trim("title")) for rows, key in zip(sides, "ab", strict=True))
    got = {(r["a"], r["b"]): r["similarity"] for r in matching.similar_titles(left, right, least).collect()}
    every = left.crossJoin(right.withColumnRenamed("title", "other")).where("title <> '' AND other <> ''").select("a", "b", title_similarity(F.col("title"), F.col("other")).alias("v"))
    want = {(r["a"], r["b"]): r["v"] for r in every.groupBy("a", "b").agg(F.max("v").alias("v")).where(F.col("v") >= least).collect()}
    assert got == want and len(want) > 20


def test_a_language_pass_holds_few_sorts_at_a_time(spark):
    before = {name: spark.createDataFrame([(1, *[None] * (schema.count(",")))], schema) for name, schema in language.TABLES.items()}
    episodes = spark.createDataFrame([(1, 1, "2024-01-01")], "anime_id BIGINT, number INT, air_date STRING")
    after = language.language_pass(before, episodes, spark.createDataFrame([(1, "JP")], "anime_id BIGINT, country STRING"), "2024-06-30")
    assert all(planned(df).count("Join ") <= 3 for df in after.values())
    assert {r["confidence"] for r in after["status"].where("language IS NOT NULL").collect()} == {75, 0}


def test_a_part_of_a_store_is_dealt_out_to_several_tasks(spark, tmp_path):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).selectExpr("sha2(CAST(id AS STRING), 256) AS x", "1 AS part")
        places = store.stage_parts(rows, f"file://{tmp_path}", "t", "part", [1])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len([f for f in os.listdir(f"{tmp_path}/{places['t/1'][0]}") if f.endswith("parquet")]) > 1


@pytest.mark.parametrize("name", ["dual_plans", "dual_segment_job", "season_ownership_job"])
def test_rows_of_seasons_are_dealt_to_all_tasks(spark, name):
    assert planned(queries()[name](spark, DATA)).count("REPARTITION_BY_NUM") >= 1  # not put together by their bytes


def test_plans_come_from_all_tasks(spark):
    rows = queries()["dual_plans"](spark, DATA).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_runs_are_found_without_sorting(spark):
    pick = random.Random(3)
    seasons = {s: [(pick.choice([None, 0, -1, *range(1, 7)]), pick.choice([None, 10, 10, 20, 20, 20] + [30] * (s % 9 == 0))) for _ in range(pick.randrange(1, 8))] for s in range(400)}
    seasons |= {400 + k: [(n + k % 3, 10 if (n <= k % 4 + 1) == (k % 2 > 0) else 20) for n in range(1, 6) if n != k % 11] for k in range(60)}

    def runs(numbers):
        return sum(n - 1 not in numbers for n in numbers)

    def plain(rows):
        rows = [(n, o) for n, o in rows if n is not None and n > 0]
        o, w = ({n for n, x in rows if x == who} for who in (10, 20))
        if not rows:
            return None
        if any(x == 30 for _, x in rows):
            return "other-anime-involved"
        if not o or not w:
            return "owner-only" if w else "orphan-only" if o else "unmapped-only"
        if runs(o) > 1 or runs(w) > 1:
            return "fragmented-between-owner-and-orphan"
        return "owner-then-orphan-adjacent" if max(w) + 1 == min(o) else "orphan-then-owner-adjacent" if max(o) + 1 == min(w) else "owner-orphan-with-gap"

    df = classify.ownership(spark.createDataFrame([(s, *r) for s, rows in seasons.items() for r in rows], "s INT, n INT, o INT"), ["s"], "n", "o", F.lit(10), F.lit(20))
    want = {s: kind for s, rows in seasons.items() if (kind := plain(rows))}
    assert {r["s"]: r["ownership"] for r in df.collect()} == want and len(set(want.values())) == 8
    assert "Window" not in planned(df)


def exchanged(spark):
    """Names of the files that exchanges have on disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_exchanges_go_once_a_table_is_staged(spark):
    before, asked = exchanged(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    made = shared.staged(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "made")
    until = time.time() + 10  # they are removed behind the writer's back
    while exchanged(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not exchanged(spark) - before and made.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == asked


def test_a_job_leaves_no_exchanges_but_its_last(spark):
    before = exchanged(spark)
    job = queries()["ownership_repair_job"](spark, DATA)
    until = time.time() + 10
    while exchanged(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not exchanged(spark) - before and planned(job).count("Exchange") == 1  # the counts; all else is written


def test_episodes_of_dealt_seasons_stay_where_they_lie(spark):
    e, titled = repairs._seasons(spark, DATA, season="season"), repairs._seasons(spark, DATA, target=repairs._TARGET)
    with shared._set(spark, shared._AS_THEY_LIE):
        moved = [line for df in (repairs._whole_plans(e, e, e), repairs._transfers(e, e, titled)) for line in planned(df).splitlines() if "ENSURE_REQUIREMENTS" in line]
    assert len(moved) == 5 and not any("episode_id" in line or "number" in line for line in moved)  # pairs by target, owner and season; moves, and counts of them


def test_a_step_is_asked_for_what_no_step_before_rejects(spark):
    seen = []

    def step(reason, least):
        def judged(rows):
            seen.append(sorted(r["id"] for r in rows.collect()))
            return rows.withColumn("reason", F.when(F.col("id") < least, reason))

        return judged

    rows = planning.gated_in_turn(spark.range(6), step("a", 2), step("b", 1), step("c", 5))
    assert sorted(str(r["reason"]) for r in rows.collect()) == ["None", "a", "a", "c", "c", "c"] and seen == [list(range(6)), [2, 3, 4, 5], [2, 3, 4, 5]]
