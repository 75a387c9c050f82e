"""Exact deduplication by content-defined chunk recipes, in native expressions only.

A text is cut into chunks where its content says so (the first line or sentence end past a least size, or a
largest size). Chunks are deduplicated into a store: a chunk's short name is a 64-bit fingerprint, verified against the
SHA-256 of its characters; contents that share a name are numbered, so an identifier (name, number) means one content.
A document becomes the ordered list of its chunks' identifiers, its recipe, and documents are equal when their recipes
are: the lists themselves are compared. Only names and digests move between tasks, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, MOST_CHARS = 1024, 4096


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Pure ASCII takes Spark's fast path, where both are the same."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> Column:
    """The text in order, cut after the first ``. ! ?`` or line end past ``least`` characters, or at ``most``."""
    pattern = rf"(?s).{{{least}}}.{{0,{most - least - 1}}}?[.!?\n]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fingerprint(chunk: Column) -> Column:
    """A chunk's short name, a long. Different chunks may share it; ``chunk_store`` tells them apart."""
    return F.xxhash64(chunk)


def chunked(docs: DataFrame) -> DataFrame:
    """One row per document: row (its number), doc_id, text_sha256, prints (name and SHA-256 of each chunk, in order). Null text: as empty."""
    body = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    prints = F.transform(chunks(body), lambda c: F.struct(fingerprint(c).alias("name"), F.unhex(F.sha2(c.cast("binary"), 256)).alias("sha")))
    # Written out, so that a row's number stays the same should a task run again.
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(body.cast("binary"), 256).alias("text_sha256"), prints.alias("prints")), "chunks")


def chunk_store(rows: DataFrame) -> DataFrame:
    """The distinct chunks of ``chunked`` rows by name: name, n_refs, contents (SHA-256 of each content of that name, in order)."""
    refs = rows.select(F.explode("prints").alias("p")).select("p.name", "p.sha")
    return refs.groupBy("name").agg(F.count("*").alias("n_refs"), F.array_sort(F.collect_set("sha")).alias("contents"))


def recipes(rows: DataFrame) -> DataFrame:
    """``chunked`` rows with their recipe in place of prints: names, and numbers of the contents under these names.

    A number is a content's place among those of its name, 0 nearly always; ``numbers`` is empty where all are 0. Rows
    need no more from the store than its names of several contents; where there are none, nothing is exchanged for it.
    """
    shared = staged(chunk_store(rows).where(F.size("contents") > 1).select("name", "contents"), "shared-names")
    kept, zeros = ["row", "doc_id", "text_sha256"], F.array().cast("array<int>")
    if shared.isEmpty():
        return rows.select(*kept, F.transform("prints", lambda p: p["name"]).alias("names"), zeros.alias("numbers"))
    refs = rows.select(*kept, F.posexplode_outer("prints").alias("at", "p")).select(*kept, "at", "p.name", "p.sha")
    number = F.coalesce(F.array_position("contents", F.col("sha")) - 1, F.lit(0)).cast("int")
    listed = refs.join(shared, "name", "left").groupBy(*kept).agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "name", number.alias("nth"))))).alias("x"))
    numbers = F.when(F.exists("x", lambda x: x["nth"] > 0), F.transform("x", lambda x: x["nth"])).otherwise(zeros)
    return listed.select(*kept, F.transform("x", lambda x: x["name"]).alias("names"), numbers.alias("numbers"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest doc_id stays. Null and empty texts are equal. Null doc_ids come below
    every number. Rows that repeat a doc_id with an equal text count in group_size; one of them is kept at most. An
    empty table gives an empty result. Only doc_id and text are read, whatever else the table has.
    """
    rows, key = staged(recipes(chunked(docs)), "recipes"), ["names", "numbers"]
    # Written out, so that both sides of the join are exchanged for it and a large group's side can be split.
    groups = staged(rows.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row")), "groups")
    joined = rows.join(groups, key)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", F.size("names").alias("n_chunks"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size,
       d.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY d.doc_id, d.text_sha256) = 1 AS kept,
       d.text_sha256
FROM d JOIN g USING (text_sha256)
"""


def op9_exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; nulls, ties, repeats and empty tables: as ``exact_groups`` says."""
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
