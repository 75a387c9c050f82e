"""The language status pass and the verified backfill: what changes, what is left alone, what is refused."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import backfill, language
from tessera.sources import store

EPISODES, TITLES = "anime_id BIGINT, number INT, air_date STRING", "anime_id BIGINT, country STRING"


def tables(spark, **rows):
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in language.TABLES.items()}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_pass_derives_removes_and_respects_what_was_set_by_hand(spark):
    own = "urn:episode-language-status:derived-airdate"
    before = tables(
        spark,
        episode_status=[(1, 9, "ja", "audio", "available", "derived-airdate", 75), (2, 1, "ja", "audio", "missing", "x", 80), (3, 1, "en", "subtitle", "available", "derived-airdate", 75)],
        evidence=[(1, "ja", "audio", "provider", "provider_audio", own, "available", 75), (3, "en", "subtitle", "provider", "provider_subtitle", own, "available", 75), (1, "ja", "audio", "community", "community_submission", "u", "no_dub", 99), (2, "ja", "audio", "official_site", "official_announcement", "v", "unavailable", 90)],
        status=[(1, "ja", "audio", "likely", 75, False), (2, "ja", "audio", "partial", 33, True), (3, "en", "subtitle", "likely", 75, False), (9, "ja", "audio", "likely", 75, False)],
    )
    episodes = spark.createDataFrame([(1, 1, "2024-01-01"), (1, 2, "2025-01-01"), (2, 1, "2024-01-01"), (2, 2, None), (4, 1, " "), (5, 1, "2024-01-01")], EPISODES)
    titles = spark.createDataFrame([(1, "jp "), (2, "JP"), (4, "JP"), (5, "US"), (5, None)], TITLES)
    after = language.language_pass(before, episodes, titles, "2024-06-30")
    assert rows(after["episode_status"]) == [(1, 1, "ja", "audio", "available", "derived-airdate", 75), (2, 1, "ja", "audio", "available", "derived-airdate", 75), (2, 1, "ja", "audio", "missing", "x", 80)]
    assert rows(after["status"]) == sorted([
        (1, "ja", "audio", "confirmed", 99, False), (1, "en", "subtitle", "unknown", 0, False), (2, "ja", "audio", "partial", 33, True), (2, "en", "subtitle", "unknown", 0, False),
        (3, "ja", "audio", "unknown", 0, False), (3, "en", "subtitle", "unknown", 0, False), (9, "ja", "audio", "likely", 75, False),
    ], key=str)
    assert [r[:3] for r in rows(after["evidence"])] == [(1, "ja", "audio"), (1, "ja", "audio"), (2, "ja", "audio"), (2, "ja", "audio")]
    empty = tables(spark)
    assert all(not rows(t) for t in language.language_pass(empty, episodes.limit(0), titles.limit(0), "2024-06-30").values())


@pytest.mark.parametrize(("statuses", "want"), [
    ([("available", 60), ("available", 90)], ("available", 90)), ([("available", 60), ("missing", 250)], ("partial", 100)), ([("missing", None)], ("not_available", 0)), ([("unknown", 90)], None), ([("partial", -5)], ("partial", 0)),
])
def test_episode_evidence(spark, statuses, want):
    df = spark.createDataFrame([(1, 1, " JA", "audio", s, None, c) for s, c in statuses], language.TABLES["episode_status"])
    found = language.episode_evidence(df).collect()
    assert [(r["language"], r["source"], r["evidence_type"], r["value"], r["confidence"]) for r in found] == ([("ja", "manual", "manual_verified", *want)] if want else [])


def test_an_update_touches_the_parts_of_what_changed_only(spark, tmp_path):
    root, ids = f"file://{tmp_path}/s", list(range(40))
    episodes = spark.createDataFrame([(i, 1, "2024-01-01") for i in ids], EPISODES)
    titles = spark.createDataFrame([(i, "JP") for i in ids], TITLES)
    language.start(spark, root, tables(spark))
    first = language.refresh(spark, root, episodes, titles, "2024-06-30")
    assert language.table(spark, root, "status").count() == 80
    changed = spark.createDataFrame([(3,), (4,)], "anime_id BIGINT")
    second = language.refresh(spark, root, episodes.where("anime_id <> 3"), titles, "2024-06-30", changed)
    parts = {f"{t}/{p}" for t in language.TABLES for p in language.parts_of(changed)}
    assert {n for n in first.tables | second.tables if first.tables.get(n) != second.tables.get(n)} <= parts
    assert {r["anime_id"] for r in language.table(spark, root, "episode_status", second).collect()} == set(ids) - {3}
    assert language.table(spark, root, "status", first).where("confidence = 75").count() == 40
    assert language.table(spark, root, "status", second).where("confidence = 75").count() == 39
    written = {f for place in set(second.tables.values()) - set(first.tables.values()) for f in os.listdir(f"{tmp_path}/s/{place[0]}") if f.endswith("parquet")}
    assert 0 < len(written) <= len(parts) * 4


MAPPING = "id INT, anime_id INT, provider STRING, provider_id STRING, slug STRING, url STRING, source STRING, confidence INT, is_primary BOOLEAN, updated_at TIMESTAMP"
ENTITY, LINK = "provider STRING, provider_id STRING, slug STRING, url STRING", "anime_id INT, provider STRING, provider_id STRING, source STRING, confidence INT"


@pytest.fixture
def filled(spark, tmp_path):
    root = f"file://{tmp_path}/b"
    old = {"entities": spark.createDataFrame([("tmdb", "1", "old", None)], ENTITY), "links": spark.createDataFrame([(7, "tmdb", "1", "old", 1)], LINK)}
    store.publish(spark, root, store.latest(spark, root), {name: store.stage(df, root, name) for name, df in old.items()})
    rows = [(1, 7, "tmdb", "1"), (2, 8, "tmdb", "1"), (3, 8, "thetvdb", "5"), (4, 8, "thetvdb", "5"), (5, 9, "kitsu", "1"), (6, None, "tmdb", "6"), (7, 9, "tmdb", None)]
    return root, spark.createDataFrame([(*r, f"s{r[0]}", None, "fuzzy", 50, r[0] == 3, None) for r in rows], MAPPING)


def test_backfill_counts_and_rows(spark, filled):
    root, mappings = filled
    dry = backfill.backfill(spark, root, mappings, apply=False)
    assert store.latest(spark, root).number == 1 and dry["links"] == backfill.Load(6, 3, 1, 2, 0)
    done = backfill.backfill(spark, root, mappings)
    assert done == {"entities": backfill.Load(6, 3, 1, 2, 2), "links": backfill.Load(6, 3, 1, 2, 2)}
    assert rows(store.read(spark, root, "entities")) == [("thetvdb", "5", "s3", None), ("tmdb", "1", "old", None), ("tmdb", "6", "s6", None)]
    assert rows(store.read(spark, root, "links")) == [(7, "tmdb", "1", "old", 1), (8, "thetvdb", "5", "fuzzy", 50), (8, "tmdb", "1", "fuzzy", 50)]
    again = backfill.backfill(spark, root, mappings)
    assert again["links"] == backfill.Load(6, 3, 3, 0, 0) and store.read(spark, root, "links").count() == 3


@pytest.mark.parametrize("tamper", [
    lambda df: df.where("provider_id <> '5'"), lambda df: df.unionByName(df), lambda df: df.withColumn("slug", F.lit("x")) if "slug" in df.columns else df.withColumn("confidence", F.lit(1)),
    lambda df: df.unionByName(df.limit(1).withColumn("provider_id", F.lit("99"))),
])
def test_a_load_that_was_tampered_with_is_refused(spark, filled, monkeypatch, tamper):
    root, mappings = filled
    before, own = {n: rows(store.read(spark, root, n)) for n in ("entities", "links")}, store.stage
    monkeypatch.setattr(store, "stage", lambda df, *more: own(tamper(df), *more))
    with pytest.raises(store.Refused):
        backfill.backfill(spark, root, mappings)
    assert store.latest(spark, root).number == 1 and {n: rows(store.read(spark, root, n)) for n in before} == before


def test_content_difference_tells_nulls_and_columns_apart(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "x", None)], "k INT, p STRING, q STRING")
    b = spark.createDataFrame([(1, "x", None), (2, "x", None)], "k INT, p STRING, q STRING")
    assert sorted(map(tuple, backfill.content_difference(a, b, ["k"]).collect())) == [(1, -1), (1, 1)]
    assert backfill.content_difference(a, a.select("q", "p", "k"), ["k"]).isEmpty()
    with pytest.raises(ValueError, match="columns"):
        backfill.content_difference(a, b.drop("q"), ["k"])
