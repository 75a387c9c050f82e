"""Slug resolution and the facts that planner jobs look up, on rows with known answers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import facts, repair, slugs
from tessera.plans import collisions  # noqa: F401  (adds its queries to the catalogue)
from tessera.plans.catalogue import oracle_sql

ROW = "mapping_id INT, anime_id INT, provider STRING, url STRING, provider_id STRING, season STRING, number STRING, source STRING, confidence INT"


def mapping(i, anime=1, url="https://thetvdb.com/series/my-show/episodes/{}", episode=10, number=1, season="1", source="fuzzy", confidence=80):
    return (i, anime, "thetvdb", url.format(episode), str(episode), season, str(number), source, confidence)


@pytest.mark.parametrize(("url", "show"), [
    ("https://thetvdb.com/series/my-show/episodes/10", "my-show"), ("http://WWW.TheTVDB.com//series/a%20b+c/episodes/10/?x=1#y", "a b+c"), ("https://thetvdb.com:443/series/77/episodes/10", "77"), ("https://thetvdb.com/series/my-show/episodes/11", None),
    ("https://nothetvdb.com/series/my-show/episodes/10", None), ("https://thetvdb.com/series/my-show/episodes/10/extra", None), ("https://thetvdb.com/series/%20/episodes/10", None), ("https://thetvdb.com/series/%zz/episodes/10", None), (None, None), ("", None),
    ("https://thetvdb.com/seasons/my-show/episodes/10", None),
])
def test_evidence_of_an_address(spark, url, show):
    row = (1, 1, "thetvdb", url, "10", "1", "3", "fuzzy", 80)
    found = slugs.slug_evidence(spark.createDataFrame([row], ROW)).first()
    assert found["show"] == show and (found["e"], found["n"]) == ((10, 3) if show else (None, None)) and found["show_id"] == (77 if show == "77" else None)


SERIES = [("My-Show", 5), ("other", 6)]
EPISODES = [(5, 1, 10, 1), (5, 1, 11, 2), (6, 1, 20, 1)]


@pytest.mark.parametrize(("rows", "reason", "identity"), [
    ([mapping(1), mapping(2, episode=11, number=2, url="https://thetvdb.com/series/MY-SHOW/episodes/{}")], None, "5:1"), ([mapping(1), mapping(2, episode=11, number=2, url="https://thetvdb.com/series/5/episodes/{}")], None, "5:1"),
    ([mapping(1), mapping(2, episode=11, number=2, url="https://thetvdb.com/series/8/episodes/{}")], "tvdb-episode-verification-failed", "5:1"), ([mapping(1, number=2)], "tvdb-episode-verification-failed", "5:1"),
    ([mapping(1, url="https://thetvdb.com/series/none/episodes/{}")], "tvdb-slug-not-found", None), ([mapping(1), mapping(2, episode=20, url="https://thetvdb.com/series/other/episodes/{}")], "conflicting-provider-identity", None),
    ([mapping(1), mapping(2, season="2")], "conflicting-provider-identity", None), ([mapping(1), mapping(2, source="manual")], "conflicting-provider-identity", None), ([mapping(1, url="https://thetvdb.com/series/5/episodes/{}")], "conflicting-provider-identity", None),
    ([mapping(1, confidence=90)], "conflicting-provider-identity", None),
])
def test_slug_groups(spark, rows, reason, identity):
    groups, evidence = slugs.slug_groups(spark.createDataFrame(rows, ROW))
    plans = slugs.resolved_slugs(groups, evidence, spark.createDataFrame(SERIES, "slug STRING, series_id INT"), spark.createDataFrame(EPISODES, "series_id INT, season INT, episode_id INT, number INT"))
    got = plans.first()
    assert plans.count() == 1 and (got["reason"], got["provider_id"], got["n"]) == (reason, identity, len(rows))
    assert (got["url"] is not None) == (reason is None) and (reason or got["url"].lower() == "https://thetvdb.com/series/my-show/seasons/official/1")


def test_identities_that_two_groups_claim_go_to_none(spark):
    plans = spark.createDataFrame([(1, None, "5:1"), (2, None, "6:1"), (3, None, "6:1"), (4, None, "7:1"), (5, "x", "8:1"), (6, None, "8:1"), (7, "x", None)], "anime_id INT, reason STRING, provider_id STRING")
    existing = spark.createDataFrame([("thetvdb", "5:1"), ("tmdb", "7:1")], "provider STRING, provider_id STRING")
    got = {r["anime_id"]: r["reason"] for r in slugs.without_collisions(plans, existing).collect()}
    assert got == {1: slugs.COLLISION, 2: slugs.COLLISION, 3: slugs.COLLISION, 4: None, 5: "x", 6: None, 7: "x"}


def test_facts_of_a_collision(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    groups = make([(1, "p", "a"), (1, "p", "b"), (1, "p", "c"), (9, "q", "a")], "anime_id INT, provider STRING, provider_id STRING")
    associations = make([(1, 2, "p", "a"), (2, 2, "p", "b"), (3, 3, "p", "b"), (4, 1, "p", "c")], "association_id INT, anime_id INT, provider STRING, provider_id STRING")
    mapped = make([(1, "p", 10), (1, "q", 99), (2, "p", 10), (2, "p", 12)], "anime_id INT, provider STRING, episode_id INT")
    seasons = make([("p", "a", 10), ("p", "a", 11)], "provider STRING, provider_id STRING, episode_id INT")
    found = facts.collision_facts(groups, associations, make([(1,), (1,)], "association_id INT"), make([(2, "p", "a")], "anime_id INT, provider STRING, provider_id STRING"), mapped, seasons, make([(1,)], "anime_id INT"))
    got = {(r["anime_id"], r["provider_id"]): r.asDict() for r in found.collect()}
    a = got[(1, "a")]
    assert (a["n_owners"], a["n_others"], a["owner"], a["associated"], a["provider_associated"], a["owner_segments"], a["parent"], a["target_outside"], a["owner_outside"], a["described"]) == (1, 1, 2, False, True, 2, 2, 0, 1, True)
    assert (got[(1, "b")]["n_owners"], got[(1, "b")]["owner"]) == (2, None) and (got[(1, "c")]["associated"], got[(1, "c")]["n_others"]) == (True, 0)
    assert (got[(9, "a")]["n_owners"], got[(9, "a")]["described"], got[(9, "a")]["parent"]) == (0, False, None) and len(got) == 4


def test_other_episodes_are_looked_up_in_scope_only(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    named = "anime_id INT, provider STRING, provider_id STRING"
    groups = make([(1, "p", "a"), (1, "p", "a"), (3, "p", "b"), (None, "p", "a")], named)
    owners, episodes = make([(1, 2, "p", "a"), (2, 2, "p", "b")], f"association_id INT, {named}"), make([("p", "a", 10), ("p", "b", 11)], "provider STRING, provider_id STRING, episode_id INT")
    mapped = make([(1, "p", 10), (1, "p", 11), (1, "q", 12), (2, "p", 10), (3, "p", 10)], "anime_id INT, provider STRING, episode_id INT")
    found = {scope: facts.collision_facts(groups, owners, make([], "association_id INT"), make([], named), mapped, episodes, make([], "anime_id INT"), scope and F.expr(scope)) for scope in ("provider_id = 'a'", "anime_id = 9", False)}
    got = {scope: sorted((str(r["anime_id"]), r["provider_id"], r["target_outside"], r["owner_outside"]) for r in df.collect()) for scope, df in found.items() if scope}
    assert got == {"provider_id = 'a'": [("1", "a", 1, 0), ("1", "a", 1, 0), ("3", "b", 0, 0), ("None", "a", 0, 0)], "anime_id = 9": [("1", "a", 0, 0), ("1", "a", 0, 0), ("3", "b", 0, 0), ("None", "a", 0, 0)]}
    assert found[False].count() == 4 and "target_outside" not in found[False].columns


def test_overlaps_are_looked_for_among_survivors(spark):
    rows = [(1, 1, None, 1, 5), (2, 1, None, 4, 9), (3, 1, "missing-provider-entity", 9, 20), (4, 1, None, 10, 12), (5, 2, None, 1, 5)]
    got = repair.overlapping(spark.createDataFrame(rows, "owner INT, identity INT, reason STRING, ps INT, pe INT"), "owner", ["identity"])
    assert {r["owner"]: r["reason"] for r in got.collect()} == {1: repair.OVERLAP, 2: repair.OVERLAP, 3: "missing-provider-entity", 4: None, 5: None}


@pytest.mark.parametrize(("name", "reasons"), [
    ("ownership_repair_job", 30), ("season_airdate_reasons", 19), ("dual_segment_job", 11), ("collision_segment_job", 8),
])
def test_the_jobs_tables_have_rows_for_every_gate(name, reasons):
    duck = duckdb.connect()
    for t in "orders lineitem customer part supplier".split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    assert len(duck.execute(oracle_sql()[name]).fetchall()) == reasons
