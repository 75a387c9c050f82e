"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The rows are hashed into blocks. The driver draws, block by block, how many of a block's rows go to
each shard (a multivariate hypergeometric draw from what the shards still lack), a matrix of
blocks x shards numbers. Rows are permuted inside their block, the matrix row cuts the permuted block
into runs, the runs are exchanged, and each shard is permuted again.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate, chain, count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, staged

#: Rows of a block, of a cell of a shard's second permutation; both sort inside one task.
BLOCK_ROWS = 200_000
MAX_BLOCKS = 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement from ``good + bad`` are good, by inversion from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rng.random() - at_mode
    left, right, p_left, p_right = mode, mode, at_mode, at_mode
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
        if p_left < 1e-300 and p_right < 1e-300:
            break
    return mode


def split_counts(rng: random.Random, colours: list[int], draws: int) -> list[int]:
    """A multivariate hypergeometric draw, colour by colour."""
    out, rest = [], sum(colours)
    for n in colours:
        rest -= n
        took = hypergeometric(rng, n, rest, draws)
        out.append(took)
        draws -= took
    return out


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts by block and shard with these exact row and column sums, as a uniform shuffle would have them."""
    if sum(rows) != sum(shards):
        raise ValueError("rows and shards must have one sum")
    rng, left, out = random.Random(seed), list(shards), []
    for n in rows:
        out.append(split_counts(rng, left, n))
        left = [a - b for a, b in zip(left, out[-1], strict=True)]
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_to_shards(rows: DataFrame, key: list[Column], shards: int = 40, seed: int = 17, block_rows: int = BLOCK_ROWS, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard), under names that rows don't have.

    ``key``: what tells rows apart; rows with equal keys are interchangeable, nulls are values like others.
    Shard sizes differ by one at most. The result depends on keys, shards and seed only, not on how the input
    is partitioned. An empty input gives an empty result.
    """
    spark = rows.sparkSession
    block_c, first_c, second_c, rank_c, cum_c, cell_c, base_c, n_c = free_names([*rows.columns, shard, slot], 8)
    hashed = [F.lit(seed), *key]
    keyed = rows.withColumns({first_c: F.xxhash64(F.lit("block"), *hashed), second_c: F.xxhash64(F.lit("slot"), *hashed)})
    total = rows.count()
    blocks = min(MAX_BLOCKS, max(1, math.ceil(total / block_rows)), max(1, total))
    blocks = max(blocks, min(total, 8 * shards)) if total else 1
    keyed = keyed.withColumn(block_c, F.pmod(F.xxhash64(F.lit("b"), first_c), F.lit(blocks)).cast("int"))
    found = {r[0]: r[1] for r in keyed.groupBy(block_c).agg(F.count("*")).collect()}  # a number for each block, at most MAX_BLOCKS
    order = sorted(found)
    matrix = communication_matrix([found[b] for b in order], even(sum(found.values()), shards), seed)
    ends = [(b, list(accumulate(counts))) for b, counts in zip(order, matrix, strict=True)]
    cuts = spark.createDataFrame(ends, T.StructType([T.StructField(block_c, T.IntegerType()), T.StructField(cum_c, T.ArrayType(T.LongType()))]))
    in_block = Window.partitionBy(block_c).orderBy(first_c, second_c)
    ranked = keyed.withColumn(rank_c, F.row_number().over(in_block) - 1)
    sharded = ranked.join(cuts, block_c).withColumn(shard, F.size(F.filter(cum_c, lambda end: end <= F.col(rank_c))).cast("int"))
    # The second permutation: cells are ranges of the second hash, so the order over all cells is one random order.
    cells = max(1, math.ceil(total / shards / block_rows), min(16, total // (shards * 100)))
    width = (1 << 32) // cells + 1
    sharded = sharded.withColumn(cell_c, F.floor((F.shiftrightunsigned(F.col(second_c), 32)) / width).cast("int"))
    # Counts by shard and cell: shards x cells numbers.
    sizes = sharded.groupBy(shard, cell_c).agg(F.count("*").alias(n_c))
    base = sizes.select(shard, cell_c, (F.sum(n_c).over(Window.partitionBy(shard).orderBy(cell_c)) - F.col(n_c)).alias(base_c))
    by_unsigned = F.shiftrightunsigned(F.col(second_c), 32)
    placed = sharded.withColumn(rank_c, F.row_number().over(Window.partitionBy(shard, cell_c).orderBy(by_unsigned, second_c, first_c)) - 1)
    return placed.join(base, [shard, cell_c]).withColumn(slot, (F.col(base_c) + F.col(rank_c)).cast("long")).select(*rows.columns, shard, slot)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """Documents with size, text_crc32, shard and slot: whole rows, ready to be written by shard.

    A null text has no bytes (size 16, CRC 0). Rows that repeat are kept and placed like any other. Groups of equal
    texts are not held together: the law is equal row counts, whatever the texts. Columns of ``docs`` come back
    unchanged; where one has such a name already, the new column's name gets the first of _2, _3, ... that is free.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc, shard, slot = (_unused(name, docs.columns) for name in ("size", "text_crc32", "shard", "slot"))
    keyed = docs.withColumns({size: (F.octet_length(text) + 16).cast("long"), crc: F.crc32(text.cast("binary"))})
    return shuffle_to_shards(keyed, [F.col("doc_id"), F.col(crc), F.col(size)], shards, seed, shard=shard, slot=slot)


def _unused(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    return next(n for n in chain([name], (f"{name}_{i}" for i in count(2))) if n.lower() not in taken)


def op10_sharding(docs: DataFrame) -> DataFrame:
    """Every row's size, checksum, shard and slot under the law ``rows``; nulls, ties, repeats, empty tables: as ``shuffle_to_shards`` says."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = staged(docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "shard-keys")
    placed = shuffle_to_shards(slim, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
