"""The folder that driver and executors share, and small files there that are whole or absent."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where that is set; where it is not, a temporary folder, which serves a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/tessera-shared"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """While it lasts, the session's settings are these."""
    before = {key: spark.conf.get(key) for key in values}
    changed = {key: value for key, value in values.items() if before[key] != value}
    for key, value in changed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in changed:
            spark.conf.set(key, before[key])


#: What a query wrote to disk for its exchanges goes when it ends; else it stays until the driver happens to collect garbage, and a
#: job of several steps holds the exchanges of all of them.
_FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Tables that both lie by some of a join's keys are joined where they lie; else Spark deals both out again by all keys.
_AS_THEY_LIE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def staged(df: DataFrame, name: str, as_they_lie: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: what is used twice is made once, and lost executors cost nothing.
    Its exchanges are gone from the disks by then.

    ``as_they_lie``: joins don't move tables that ``relational.spread`` dealt by some of their keys, which must be even enough."""
    path = new_folder(df.sparkSession, name)
    with _set(df.sparkSession, _FREED | (_AS_THEY_LIE if as_they_lie else {})):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of a path in Spark's configuration."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    fs, place = hadoop(spark, path)
    fs.delete(place, True)


def _local(path: str) -> str | None:
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def write_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> bool:
    """Write a file under another name beside its own and rename it: readers see the old file or the new one, whole.

    Without ``replace`` a file that is there already stays, and False is returned: of several writers one wins. The other
    name is removed if writing fails.
    """
    beside = f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.{uuid.uuid4().hex}.tmp"
    own = _local(path)
    if own is not None:
        hidden = _local(beside)
        os.makedirs(os.path.dirname(own), exist_ok=True)
        try:
            with open(hidden, "w", encoding="utf-8") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            if replace:
                os.replace(hidden, own)
                return True
            try:
                os.link(hidden, own)
                return True
            except FileExistsError:
                return False
        finally:
            if os.path.exists(hidden):
                os.unlink(hidden)
    fs, hidden = hadoop(spark, beside)
    try:
        out = fs.create(hidden, True)
        out.write(bytearray(text, "utf-8"))
        out.close()
        return _renamed(spark, hidden, path, replace)
    finally:
        fs.delete(hidden, False)


def _renamed(spark: SparkSession, hidden: Any, path: str, replace: bool) -> bool:
    """Rename by the file system's own atomic operation."""
    jvm, fs = spark._jvm, spark._jvm.org.apache.hadoop.fs
    place = fs.Path(path)
    how = getattr(fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE if replace else how.NONE
    context = fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(hidden, place, options)
    except Exception as e:  # noqa: BLE001  (Java's exceptions come as one class)
        cause = getattr(e, "java_exception", None)
        if not replace and cause is not None and jvm.java.lang.Class.forName("org.apache.hadoop.fs.FileAlreadyExistsException").isInstance(cause):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None where there is no such file."""
    own = _local(path)
    if own is not None:
        try:
            with open(own, encoding="utf-8") as file:
                return file.read()
        except FileNotFoundError:
            return None
    fs, place = hadoop(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, hidden ones left out; none where there is no folder."""
    fs, place = hadoop(spark, folder)
    if not fs.exists(place):
        return []
    return sorted(n for s in fs.listStatus(place) if not (n := s.getPath().getName()).startswith((".", "_")))


def save_json(spark: SparkSession, path: str, value: Any) -> None:
    """A JSON document at ``path``, whole or as it was before. What JSON can't hold is refused before anything is written."""
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False))


def load_json(spark: SparkSession, path: str) -> Any:
    """The document, None where there is none; a file that isn't JSON is an error, never a fresh start."""
    text = read_text(spark, path)
    return None if text is None else json.loads(text)
