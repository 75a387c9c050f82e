"""The ten findings on mapping tables, in one table of tagged rows: a count and the first samples of each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import outside_segments
from tessera.operators.relational import without

SAMPLES = 20
#: Codes and severities of the findings.
SEVERITY = {
    "anime-provider-id-not-canonical": "error", "episode-provider-id-not-canonical": "error", "multiple-primary-anime-mappings": "error",
    "ambiguous-multi-mapping-provider": "error", "episode-mapping-without-anime-provider": "error", "mapping-confidence-out-of-range": "error",
    "overconfident-fuzzy-mapping": "warning", "kitsu-episode-provenance-stronger-than-parent": "error", "malformed-season-provider-id": "warning",
    "legacy-heuristic-source-labelled-api": "warning",
}
SEASONAL = ("thetvdb", "tmdb")


def _tagged(rows: DataFrame, kind: str, codes: dict[str, Column]) -> DataFrame:
    """(code, kind, id, tag): each row once for every condition that holds; one pass over ``rows`` for all of them."""
    found = F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds in codes.items()]))
    return rows.select(F.explode(found).alias("code"), F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"), F.col("provider").alias("tag"))


def findings(titles: DataFrame, episodes: DataFrame, items: DataFrame, segments: DataFrame) -> DataFrame:
    """code, severity, n, samples (the ids of the first 20 by kind, id and provider; a group's id is its title).

    ``titles``: mappings (id, anime_id, provider, provider_id, source, confidence, is_primary); ``episodes``: episodes (id,
    anime_id, number); ``items``: episode mappings (id, episode_id, provider, provider_id, provider_episode_number, source,
    confidence); ``segments``: (anime_id, provider, ps, pe, ls, le). Codes without rows are left out. Nulls violate nothing.
    """
    raw, conf, fuzzy = F.col("provider_id"), F.col("confidence"), F.col("source") == "fuzzy"
    untidy = (F.trim(raw) == "") | (raw != F.trim(raw))
    both = {"mapping-confidence-out-of-range": ~conf.between(0, 100), "overconfident-fuzzy-mapping": fuzzy & (conf >= 100)}
    seasonal = F.col("provider").isin(*SEASONAL)
    of_titles = _tagged(titles, "anime", {
        "anime-provider-id-not-canonical": untidy, **both, "malformed-season-provider-id": seasonal & ~raw.rlike(r"\A[1-9][0-9]*:[1-9][0-9]*\z"),
        "legacy-heuristic-source-labelled-api": seasonal & (F.col("source") == "api") & (conf == 85),
    })
    of_items = _tagged(items, "episode", {"episode-provider-id-not-canonical": untidy, **both})
    groups = titles.groupBy(F.col("anime_id").alias("id"), "provider").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("p"))
    of_groups = _tagged(groups.where("n > 1"), "group", {"multiple-primary-anime-mappings": F.col("p") > 1, "ambiguous-multi-mapping-provider": F.col("p") != 1})
    parent = episodes.select(F.col("id").alias("episode_id"), "anime_id", "number")
    placed = items.join(parent, "episode_id").withColumn("given", F.when(F.col("provider_episode_number").rlike(r"\A[1-9][0-9]*\z"), F.col("provider_episode_number").try_cast("int")))
    alone = without(placed, titles, {"anime_id": "anime_id", "provider": "provider"})
    orphans = _tagged(outside_segments(alone, segments, ["anime_id", "provider"], "given", "number"), "episode", {"episode-mapping-without-anime-provider": F.lit(True)})
    weak = titles.where(fuzzy & (F.col("provider") == "kitsu")).select("anime_id", F.col("confidence").alias("_most"))
    strong = placed.where("provider = 'kitsu'").join(weak, "anime_id").where((F.col("source") != "fuzzy") | (conf > F.col("_most")))
    rows = reduce(DataFrame.unionByName, [of_titles, of_items, of_groups, orphans, _tagged(strong, "episode", {"kitsu-episode-provenance-stronger-than-parent": F.lit(True)})])
    first = F.row_number().over(Window.partitionBy("code").orderBy("kind", "id", "tag"))
    top = rows.withColumn("_rank", first).where(F.col("_rank") <= SAMPLES)  # cut off before the exchange: 20 rows a code and task
    samples = top.groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "id"))), lambda s: s["id"].cast("string")), ",").alias("samples"))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return rows.groupBy("code").agg(F.count("*").alias("n")).join(samples, "code").select("code", severity[F.col("code")].alias("severity"), "n", "samples")
