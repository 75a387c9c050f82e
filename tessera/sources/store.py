"""Tables that change as a whole: write, audit, publish.

A store is a folder. Each table is written into a new folder of its own; a commit names the folders that belong together
and is one small file with the next number. A commit's file appears whole or not at all, and of two writers that build on
the same commit one wins and the other is told. Readers of a commit are never disturbed by later ones.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared


class Conflict(RuntimeError):
    """Another writer has published since."""


class Refused(RuntimeError):
    """The audit found faults; nothing was published."""

    def __init__(self, faults: dict[str, int]) -> None:
        super().__init__(f"refused: {faults}")
        self.faults = faults


@dataclass(frozen=True)
class Commit:
    """Number of the commit (0: none yet), and the folder and the columns of each table."""

    number: int
    tables: dict[str, tuple[str, str]]


def latest(spark: SparkSession, root: str) -> Commit:
    found = shared.names(spark, f"{root}/commits")
    if not found:
        return Commit(0, {})
    return commit_at(spark, root, int(found[-1].removesuffix(".json")))


def commit_at(spark: SparkSession, root: str, number: int) -> Commit:
    tables = shared.load_json(spark, f"{root}/commits/{number:012d}.json")
    if tables is None:
        raise LookupError(f"{root} has no commit {number}")
    return Commit(number, {name: tuple(place) for name, place in tables.items()})


def read(spark: SparkSession, root: str, name: str, commit: Commit | None = None) -> DataFrame:
    folder, schema = (commit or latest(spark, root)).tables[name]
    return spark.read.schema(schema).parquet(f"{root}/{folder}")


def stage(df: DataFrame, root: str, name: str) -> tuple[str, str]:
    """Write a table that no commit names yet; returns what ``publish`` needs. A failed write leaves no trace that anyone reads."""
    folder = f"tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return folder, ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)


def at(spark: SparkSession, root: str, place: tuple[str, str]) -> DataFrame:
    """A staged table, as it was written."""
    return spark.read.schema(place[1]).parquet(f"{root}/{place[0]}")


def stage_parts(df: DataFrame, root: str, name: str, by: str, parts: list[int]) -> dict[str, tuple[str, str] | None]:
    """Write the parts of a table that ``by`` names into folders of their own, for ``publish``; a part without rows is None.

    Rows of one part come together before they are written, and AQE deals a large part out to several tasks: there are as many parts
    however large the table is.
    """
    spark = df.sparkSession
    folder, kinds = f"tables/{name}-{uuid.uuid4().hex}", ", ".join(f"`{c}` {kind}" for c, kind in df.drop(by).dtypes)
    df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(f"{root}/{folder}")
    there = set(shared.names(spark, f"{root}/{folder}"))
    return {f"{name}/{part}": (f"{folder}/{by}={part}", kinds) if f"{by}={part}" in there else None for part in parts}


def read_parts(spark: SparkSession, root: str, name: str, schema: str, commit: Commit, parts: list[int] | None = None) -> DataFrame:
    """The rows of all parts of a table, or of some: the others' files aren't listed."""
    wanted = None if parts is None else {f"{name}/{part}" for part in parts}
    places = [place[0] for own, place in sorted(commit.tables.items()) if own.startswith(f"{name}/") and (wanted is None or own in wanted)]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{place}" for place in places])


def publish(spark: SparkSession, root: str, after: Commit, tables: dict[str, tuple[str, str] | None]) -> Commit:
    """One commit with the given tables new (None: gone) and the others as in ``after``, on which it must follow."""
    commit = Commit(after.number + 1, {name: place for name, place in {**after.tables, **tables}.items() if place is not None})
    text = json.dumps({name: list(place) for name, place in commit.tables.items()}, indent=1)
    if not shared.write_text(spark, f"{root}/commits/{commit.number:012d}.json", text, replace=False):
        raise Conflict(f"{root} has a commit {commit.number} already")
    return commit


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove tables that none of the last ``keep`` commits names, tables of writers that failed among them; returns their names.
    A folder with parts goes when none of its parts is named any more.

    No writer may be at work meanwhile: its staged tables aren't named by any commit yet.
    """
    numbers = [int(n.removesuffix(".json")) for n in shared.names(spark, f"{root}/commits")]
    kept = {"/".join(place[0].split("/")[:2]) for n in numbers[-max(1, keep) :] for place in commit_at(spark, root, n).tables.values()}
    gone = [n for n in shared.names(spark, f"{root}/tables") if f"tables/{n}" not in kept]
    for n in gone:
        shared.remove(spark, f"{root}/tables/{n}")
    for n in numbers[: -max(1, keep)]:
        shared.remove(spark, f"{root}/commits/{n:012d}.json")
    return gone
