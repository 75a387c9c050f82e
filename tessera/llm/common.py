"""Helpers that the operators share: staged tables, word patterns, bounded batches, fold of a document."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stage_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir`` where that is set. Where it is not, a temporary folder serves a
    local master only, since executors of a cluster would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/tessera-stage"


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """While it lasts, Python workers get batches of ``n`` rows at most, so that batches of texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(n, int(before)) if int(before) > 0 else n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Folder of the run that stages tables now; None outside of runs.
_run: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def staging_run(spark: SparkSession) -> Iterator[str]:
    """While it lasts, tables of this thread are staged in a folder of their own, whose path it gives.

    Results are lazy and read these tables, so the caller removes the folder (``remove_tables``) once it has written
    what it made of them. Tables of other runs, and those staged outside of any, are never touched.
    """
    token = _run.set(f"{stage_folder(spark)}/run-{uuid.uuid4().hex}")
    try:
        yield _run.get()
    finally:
        _run.reset(token)


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in the folder of the run that lasts."""
    return f"{_run.get() or stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends, lost executors cost nothing.

    A ``small`` result of many tasks is dealt to an eighth as many that write it: fewer files.
    """
    path = staging_path(df.sparkSession, name)
    if small:
        df = df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables, or whole folders of runs, that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_names(columns: list[str], n: int) -> list[str]:
    """``n`` column names that differ from ``columns``, in any case of letters."""
    taken = {c.lower() for c in columns}
    return list(itertools.islice((c for c in (f"_{i}" for i in itertools.count()) if c not in taken), n))


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 5``; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(frames: Iterator[pd.DataFrame], column: str, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that none but a single long text holds more than ``chars`` characters."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].map(lambda x: len(x) if isinstance(x, (str, bytes)) else 0).to_numpy()
        group = (sizes.cumsum() - sizes) // chars
        if group[-1] == 0:
            yield frame
            continue
        for _, part in frame.groupby(group, sort=False):
            yield part


def text_or_empty(value: object) -> str:
    return value if isinstance(value, str) else ""
