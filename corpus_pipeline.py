"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns a DataFrame that is
written as Parquet and read again. All stages but the last return the columns of documents. Stages handle nulls, empty
texts, repeated rows and empty tables as their operators' docstrings say, and keep further columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mix, njoin, shard, toxicity
from tessera.llm.common import remove_tables, stage_folder, staging_run


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores as toxic go.

    Null and empty texts stay, repeated rows stay or go together; without labelled rows the fixed list of insults decides.
    Columns of any name come back unchanged; an empty table gives an empty one.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 of five-word shingles, the one with the least doc_id stays.

    Null and word-free texts and null ids stay; rows that repeat a document stay or go together. Columns of any name come
    back unchanged; an empty table gives an empty one.
    """
    return njoin.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts stay, repeated rows stay or go together; an empty benchmark leaves all. Columns of any name come
    back unchanged; an empty table gives an empty one.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are taken, up to three times each, so that the sources come near their target weights.

    A null source is a source; rows without words come never; rows that repeat a document are taken alike. Columns of any
    name come back unchanged; an empty table gives an empty one.
    """
    return mix.mixed_documents(docs)


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there, nulls, empty texts and repeats like any other; all columns stay.

    Where a column has the name of a new one, the new one's gets _2 behind it. An empty table gives an empty one.
    """
    return shard.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_corpus),
]

#: Model scores, hashes and draws can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage returns is written to the shared folder and read by the next.

    What a stage was made of, its input's copy and the tables that it staged itself, is removed once it is written, or
    when it fails; tables of other queries and of other runs stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = f"{stage_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with staging_run(spark) as own:
            try:
                stage(spark, docs, sf_dir).write.parquet(path)
            finally:
                remove_tables(spark, [own, *before])
        docs, before = spark.read.parquet(path), [path]
    return docs
