"""Streams with keyed state give what their batch forms give, whatever the micro-batches and restarts; state stays bounded."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import live, microbatch

T0 = datetime(2024, 1, 1)


def fed(spark, folder, batches, schema, make, mode="append", restart=False):
    """What ``make(stream)`` gives out over the batches, one file each; with ``restart`` a new stream is started for each batch."""
    src, out = str(folder / "in"), None
    for rows in [batches] if not restart else [[b] for b in batches]:
        for b in rows:
            spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        out = live.run_to_end(make(stream), str(folder / "out"), str(folder / "cp"), mode)
    return out


@pytest.mark.parametrize(("parts", "restart"), [(1, False), (6, False), (4, True)])
def test_back_offs_whatever_the_batches(spark, tmp_path, parts, restart):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), i, i // 4, rng.random() < 0.2) for i in range(400)]
    schema = "k INT, i INT, batch BIGINT, failed BOOLEAN"
    cuts = sorted(rng.sample(range(1, 400), parts - 1))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 400], strict=True)]
    got = fed(spark, tmp_path, batches, schema, lambda s: live.live_back_offs(s, ["k"], ["i"], "batch", "failed"), restart=restart)
    seen = microbatch.failure_windows(spark.createDataFrame(rows, schema), ["k"], [F.col("i")], F.col("failed"))
    want = microbatch.back_offs(seen, ["k"], "batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 3


def test_latest_signs(spark, tmp_path):
    rng, now = random.Random(3), T0 + timedelta(days=10)
    rows = [(rng.randrange(6), T0 + timedelta(hours=rng.randrange(300))) for _ in range(60)] + [(7, T0)]
    schema = "k INT, at TIMESTAMP"
    got = fed(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], schema, lambda s: live.live_latest(s, ["k"], "at", 7 * 86400, F.lit(now)), "update")
    want = microbatch.latest_alive(spark.createDataFrame(rows, schema), ["k"], "at", F.lit(now), F.expr("INTERVAL 7 DAYS"))
    latest = got.groupBy("k").agg(F.max("at").alias("at"))
    assert sorted(map(tuple, latest.collect())) == sorted(map(tuple, want.select("k", F.unix_micros("at")).collect())) and want.count() == 6


@pytest.mark.parametrize("restart", [False, True])
def test_requests_in_flight(spark, tmp_path, restart):
    """Flights of a key lie an hour apart; their repeats come within a minute, in the same batches as the next flights, in
    other batches and after restarts."""
    rng, rows = random.Random(5), []
    for key in range(8):
        for flight in range(4):
            start = T0 + timedelta(hours=flight, seconds=key)
            rows += [(key, flight, start + timedelta(seconds=s)) for s in [0, *rng.sample(range(1, 60), rng.randrange(4))]]
    rows.sort(key=lambda r: r[2])
    schema = "k INT, flight INT, at TIMESTAMP"
    batches = [rows[a : a + 9] for a in range(0, len(rows), 9)]
    got = fed(spark, tmp_path, batches, schema, lambda s: live.in_flight(s, ["k"], "at", 120), restart=restart)
    want = live.flights(spark.createDataFrame(rows, schema), ["k"], "at", 120)
    assert sorted((r["k"], r["flight"]) for r in got.collect()) == sorted((r["k"], r["flight"]) for r in want.collect()) == [(k, f) for k in range(8) for f in range(4)]


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    schema = "k INT, at TIMESTAMP"
    for day in range(4):
        spark.createDataFrame([(100 * day + i, T0 + timedelta(days=day, seconds=i)) for i in range(50)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with live.keyed_state(spark):
        query = live.in_flight(stream, ["k"], "at", 120).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= 300  # each key's start and timer (both ways): never those of all four days
    rows = [(1, T0 + timedelta(seconds=s)) for s in range(0, 600, 50)] + [(None, T0), (None, T0 + timedelta(seconds=119))]
    begun = live.flights(spark.createDataFrame(rows, schema), ["k"], "at", 120).collect()
    assert sorted((r["at"] - T0).seconds for r in begun if r["k"]) == [0, 150, 300, 450] and len(begun) == 5


def test_late_and_null_rows(spark, tmp_path):
    rows = [[(1, T0), (None, T0)], [(2, T0 + timedelta(hours=1))], [(3, T0), (None, T0 + timedelta(hours=1))], []]
    got = fed(spark, tmp_path, [b for b in rows if b], "k INT, at TIMESTAMP", lambda s: live.in_flight(s, ["k"], "at", 120))
    # 3 came behind the watermark: Spark may drop it
    assert sorted((r["k"] or 0, r["at"].hour) for r in got.collect() if r["k"] != 3) == [(0, 0), (0, 1), (1, 0), (2, 1)]
