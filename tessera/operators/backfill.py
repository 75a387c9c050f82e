"""Loads into new tables that are planned, counted and compared with their source before anyone sees them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import store

from .moves import bag_difference
from .relational import distinct_on

#: The providers whose mappings are carried over.
PROVIDERS = ("thetvdb", "tmdb")
ENTITY, LINK = ["provider", "provider_id"], ["anime_id", "provider", "provider_id"]


@dataclass(frozen=True)
class Load:
    """Counts of a load: rows of the source, distinct keys, those that were there, planned and inserted ones."""

    source: int
    keys: int
    skipped: int
    planned: int
    inserted: int


def planned_rows(source: DataFrame, loaded: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows to insert: of each key that isn't loaded yet the first row in a total order. A null in a key is no key."""
    usable = source.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    return distinct_on(usable, keys, order).join(loaded.select(*keys), keys, "left_anti")


def content_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): rows of ``right`` that aren't in ``left`` (n above 0) or the other way round, told apart by key and content.

    One exchange of keys and 64 bits a row, whatever the width of the tables; both must have the same columns.
    """
    names = sorted(left.columns)
    if names != sorted(right.columns):
        raise ValueError(f"other columns: {sorted(set(names) ^ set(right.columns))}")
    known = [F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in names]).alias("_content")]
    return bag_difference(left.select(*keys, *known), right.select(*keys, *known), [*keys, "_content"]).select(*keys, "n")


def verified_load(spark: SparkSession, root: str, name: str, planned: DataFrame, keys: list[str], commit: store.Commit) -> tuple[tuple[str, str], int]:
    """Write a store's table with planned rows added, read it again and compare: (staged table, rows inserted).

    ``Refused`` if the written table isn't the old one and the planned rows, row for row, or a key is in it twice.
    """
    before = store.read(spark, root, name, commit)
    expected = before.unionByName(planned.select(*before.columns))
    place = store.stage(expected, root, name)
    after = store.at(spark, root, place)
    wrong = content_difference(expected, after, keys).agg(F.count_if(F.col("n") > 0).alias("more"), F.count_if(F.col("n") < 0).alias("fewer")).first()
    twice = after.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1").count()
    faults = {k: v for k, v in (("unplanned rows", wrong["more"]), ("missing rows", wrong["fewer"]), ("repeated keys", twice)) if v}
    if faults:
        raise store.Refused({f"{name}: {k}": v for k, v in faults.items()})
    return place, after.count() - before.count()


def _order() -> list[Column]:
    return [F.col("is_primary").desc(), F.col("updated_at").desc_nulls_last(), F.col("id").desc()]


def plans(mappings: DataFrame, entities: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links) to insert for ``mappings`` (id, anime_id, provider, provider_id, slug, url, source, confidence,
    is_primary, updated_at): an entity takes the details of its primary, then of its latest mapping."""
    ours = mappings.where(F.col("provider").isin(*PROVIDERS))
    return planned_rows(ours, entities, ENTITY, _order()).select(*entities.columns), planned_rows(ours, links, LINK, _order()).select(*links.columns)


def backfill(spark: SparkSession, root: str, mappings: DataFrame, apply: bool = True) -> dict[str, Load]:
    """Carry mappings over into a store's tables ``entities`` and ``links``, as one commit; returns the counts of both.

    Without ``apply`` nothing is written. A load is refused, and neither table changes, unless exactly the planned rows
    were written and each mapping has its entity and its link afterwards.
    """
    commit = store.latest(spark, root)
    tables = {name: store.read(spark, root, name, commit) for name in ("entities", "links")}
    ours = mappings.where(F.col("provider").isin(*PROVIDERS))
    counts, staged = {}, {}
    for (name, loaded), planned, keys in zip(tables.items(), plans(mappings, *tables.values()), (ENTITY, LINK), strict=True):
        n = planned.count()
        usable = ours.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
        distinct = usable.select(*keys).distinct().count()
        inserted = 0
        if apply:
            staged[name], inserted = verified_load(spark, root, name, planned, keys, commit)
            left = usable.join(store.at(spark, root, staged[name]).select(*keys), keys, "left_anti").count()
            if inserted != n or left:
                raise store.Refused({f"{name}: inserted instead of {n}": inserted, f"{name}: left over": left})
        counts[name] = Load(ours.count(), distinct, distinct - n, n, inserted)
    if apply:
        store.publish(spark, root, commit, staged)
    return counts


def report(counts: dict[str, Load]) -> list[tuple]:
    """(table, measure, n), a row for each count."""
    return [(name, measure, n) for name, load in counts.items() for measure, n in asdict(load).items()]
