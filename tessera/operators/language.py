"""The language status pass: from air dates and episode statuses to evidence, from evidence to one status a title.

Three tables, in parts by title, change together as one commit of a store. A pass over some titles reads and writes the
parts that hold them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clamp_confidence
from tessera.sources import store
from tessera.sources.shared import staged

from .classify import fold_status, resolve_evidence
from .merge import unless_overridden

#: The provider of statuses that air dates imply, their confidence, and the (language, media) that a pass goes through.
DERIVED, DERIVED_CONFIDENCE = "derived-airdate", 75
SHAPES = (("ja", "audio"), ("en", "subtitle"))
KEYS = ["anime_id", "language", "media"]
PARTS = 64
TABLES = {
    "episode_status": "anime_id BIGINT, number INT, language STRING, media STRING, status STRING, provider STRING, confidence INT",
    "evidence": "anime_id BIGINT, language STRING, media STRING, source STRING, evidence_type STRING, source_url STRING, value STRING, confidence INT",
    "status": "anime_id BIGINT, language STRING, media STRING, status STRING, confidence INT, is_manual_override BOOLEAN",
}


def aired(episodes: DataFrame, date: str, today: str) -> DataFrame:
    """Episodes with an air date up to today; ISO dates are compared as texts, null and blank ones are no dates."""
    return episodes.where(F.col(date).isNotNull() & (F.trim(date) != "") & (F.col(date) <= F.lit(today)))


def derived_statuses(episodes: DataFrame, titles: DataFrame, today: str) -> DataFrame:
    """Episode statuses that air dates imply: aired episodes of titles from Japan have Japanese audio.

    ``episodes``: anime_id, number, air_date; ``titles``: anime_id, country.
    """
    ours = titles.where(F.upper(F.trim("country")) == "JP").select("anime_id")
    rows = aired(episodes, "air_date", today).join(ours, "anime_id", "left_semi")
    language, media = SHAPES[0]
    return rows.select(
        "anime_id", F.col("number").cast("int").alias("number"), *[F.lit(v).alias(n) for n, v in (("language", language), ("media", media), ("status", "available"), ("provider", DERIVED))], F.lit(DERIVED_CONFIDENCE).alias("confidence")
    )


def evidence_source(provider: Column) -> Column:
    return F.when(provider == "manual", "manual").otherwise("provider")


def evidence_type(provider: Column, media: Column) -> Column:
    return F.when(provider == "manual", "manual_verified").when(media == "audio", "provider_audio").otherwise("provider_subtitle")


def evidence_url(provider: Column, url: Column | None = None) -> Column:
    own = F.concat(F.lit("urn:episode-language-status:"), provider)
    return own if url is None else F.coalesce(url, own)


def episode_evidence(statuses: DataFrame) -> DataFrame:
    """One row of evidence for each title, language, media and provider of episode statuses: the statuses folded to one
    value, the greatest confidence clamped. Without an available, partial or missing episode there is none."""
    provider = F.coalesce(F.nullif(F.trim("provider"), F.lit("")), F.lit("manual"))
    folded = statuses.withColumns({"language": F.lower(F.trim("language")), "provider": provider}).groupBy(*KEYS, "provider").agg(
        fold_status("status").alias("value"), clamp_confidence(F.greatest(F.lit(0), F.max(clamp_confidence(F.col("confidence"))))).alias("confidence")
    )
    p = F.col("provider")
    return folded.where("value IS NOT NULL").select(*KEYS, evidence_source(p).alias("source"), evidence_type(p, F.col("media")).alias("evidence_type"), evidence_url(p).alias("source_url"), "value", "confidence")


def language_pass(tables: dict[str, DataFrame], episodes: DataFrame, titles: DataFrame, today: str, only: DataFrame | None = None) -> dict[str, DataFrame]:
    """The three tables after a pass over all titles, or over those of ``only`` (anime_id).

    What air dates implied before is taken away and derived anew. Titles that had such statuses, or have them now, get the
    derived evidence of each shape replaced (or removed), and their status of each shape resolved from all of its evidence:
    unknown at 0 where there is none. A status that was set by hand stays as it is.
    """
    old, evidence, status = (tables[name] for name in TABLES)
    fresh = derived_statuses(episodes, titles, today)
    gone = old.where(F.col("provider") == DERIVED)
    if only is not None:
        fresh, gone = (df.join(only, "anime_id", "left_semi") for df in (fresh, gone))
    # Written once: else one stage would make all of them anew for each use, and a task would hold the sorts of all at a time.
    fresh = staged(fresh, "fresh")
    affected = staged(fresh.select("anime_id").unionByName(gone.select("anime_id")).distinct(), "affected")
    shapes = F.array(*[F.struct(F.lit(x).alias("language"), F.lit(y).alias("media")) for x, y in SHAPES])
    groups = affected.select("anime_id", F.inline(shapes))
    stays = old.where(~F.col("provider").eqNullSafe(DERIVED))
    if only is not None:
        stays = stays.unionByName(old.where(F.col("provider") == DERIVED).join(only, "anime_id", "left_anti"))
    new_status = stays.unionByName(fresh)
    ours = (F.col("source") == "provider") & (F.col("evidence_type") == evidence_type(F.lit(DERIVED), F.col("media"))) & (F.col("source_url") == evidence_url(F.lit(DERIVED)))
    replaced = evidence.withColumn("_ours", F.coalesce(ours, F.lit(False)))
    kept = replaced.join(groups.withColumn("_ours", F.lit(True)), [*KEYS, "_ours"], "left_anti").select(*evidence.columns)
    new_evidence = staged(kept.unionByName(episode_evidence(fresh)), "evidence")
    resolved = resolve_evidence(new_evidence.join(groups, KEYS, "left_semi"), KEYS, "source", "value", "confidence")
    says = groups.join(resolved, KEYS, "left").select(*KEYS, F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("score", F.lit(0)).cast("int").alias("confidence"), F.lit(False).alias("is_manual_override"))
    return {"episode_status": new_status, "evidence": new_evidence, "status": unless_overridden(status, says, KEYS, "is_manual_override")}


def _part(id_: str) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(PARTS)).cast("int")


def parts_of(ids: DataFrame) -> list[int]:
    """The parts that hold the titles, PARTS at most."""
    return sorted(r[0] for r in ids.select(_part("anime_id")).distinct().collect())


def start(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> store.Commit:
    """A store with the given tables, in parts."""
    staged: dict = {}
    for name, df in tables.items():
        staged |= store.stage_parts(df.withColumn("part", _part("anime_id")), root, name, "part", list(range(PARTS)))
    return store.publish(spark, root, store.latest(spark, root), staged)


def refresh(spark: SparkSession, root: str, episodes: DataFrame, titles: DataFrame, today: str, changed: DataFrame | None = None) -> store.Commit:
    """Run the pass over a store's tables and publish all three as one commit; with ``changed`` (anime_id) over these titles,
    whose parts alone are read and written."""
    commit, parts, only = store.latest(spark, root), list(range(PARTS)), None
    if changed is not None:
        only = changed.select(F.col("anime_id").cast("bigint").alias("anime_id")).distinct()
        parts = parts_of(only)
        episodes, titles = (df.join(only, "anime_id", "left_semi") for df in (episodes, titles))
    before = {name: store.read_parts(spark, root, name, schema, commit, parts) for name, schema in TABLES.items()}
    staged: dict = {}
    for name, df in language_pass(before, episodes, titles, today, only).items():
        staged |= store.stage_parts(df.withColumn("part", _part("anime_id")), root, name, "part", parts)
    return store.publish(spark, root, commit, staged)


def table(spark: SparkSession, root: str, name: str, commit: store.Commit | None = None) -> DataFrame:
    return store.read_parts(spark, root, name, TABLES[name], commit or store.latest(spark, root))
