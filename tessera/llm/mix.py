"""Mixing sources to target weights through a splitting tree, in native expressions only.

Each document is cut into blocks of at most ``block_words`` words. A source's target says how many whole passes
over its blocks the mix takes, and how many words of one further pass; both together are the source's block quota, an
exact count. The quotas are divided among the output shards: the root holds every quota, each node draws for its
left child a multivariate hypergeometric share of its quotas, and a leaf is a shard with an exact count of each
source. A source's blocks, pass after pass in a permuted order, go to the shards in disjoint runs of its leaves'
counts; a block is in the mix if it lies in such a run. Each shard is shuffled by itself.

The driver draws the tree for GROUPS groups of sources. Inside a group the draw goes on in Spark, for any number of
sources: a multivariate hypergeometric share of quotas is what a uniform draw of the quotas' blocks without replacement
holds of each source, so a group's blocks are put into a random order of their own and cut at the group's leaves.
"""

from __future__ import annotations

import random
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, staged, word_count
from .shard import split_counts

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 1024
SHARDS = 16
SEED = 29
#: Blocks that one task orders.
RANGE_BLOCKS = 100_000
#: Groups that sources are hashed into; the driver holds GROUPS x shards numbers.
GROUPS = 256


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with turn: the place, from 0, of each source by code point, null last. Ranges of sources are numbered side by side."""
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    return _in_order(staged(ranged, "mix-sources"), [], [F.col("source").asc_nulls_last()], F.col("range"), "turn").drop("range")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """From (source, source_size), a row each, to (source, source_size, weight, target).

    Sources by code point, null last, weigh ``weights`` in turn. A target is min(cap, level x weight), where the
    cap is ``most_times`` the source's size and the level is such that all targets add up to all sizes. The level is
    found by resharing the excess by weight until no further source is above its cap, one aggregation a round.
    """
    turn = F.pmod("turn", F.lit(len(weights))).cast("int") + 1
    weighed = staged(_numbered(sizes).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)), "mix-weights")
    cap = F.col("source_size") * float(most_times)
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, capped = total / weight if weight else 0.0, 0
    while weight:
        above = cap <= F.lit(level) * F.col("weight")
        n, used, freed = weighed.where(above).agg(F.count("*"), F.coalesce(F.sum(cap), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if n == capped or freed >= weight:
            break
        level, capped = (total - used) / (weight - freed), n
    return weighed.select("source", "source_size", "weight", F.least(cap, F.lit(float(level)) * F.col("weight")).alias("target"))


def quota_tree(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Counts by shard and quota: every quota is met exactly, shard totals differ by one at most."""
    rng, leaves = random.Random(seed), []

    def split(counts: list[int], parts: int) -> None:
        if parts == 1:
            leaves.append(counts)
            return
        left = parts // 2
        size = sum(counts)
        # shard totals are even: the first (size mod parts) shards get one more
        room = size // parts * left + min(left, size % parts)
        mine = split_counts(rng, counts, room)
        split(mine, left)
        split([a - b for a, b in zip(counts, mine, strict=True)], parts - left)

    split(list(quotas), shards)
    return leaves


def _in_order(rows: DataFrame, group: list[str], order: list[Column], spread: Column, name: str) -> DataFrame:
    """``name``: the row's place, from 0, in its group by ``spread`` (a small int that the order begins with), then ``order``.

    A hot group is ordered in parts, one for each value of ``spread``; only the parts' counts are added up in one place.
    """
    rows = rows.withColumn("_part", spread)
    parts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    base = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).alias("_base"))
    placed = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = F.col("_part") == F.col("_p")
    for s in same:
        on = on & s
    return placed.join(base, on).withColumn(name, (F.col(name) + F.col("_base")).cast("long")).drop("_part", "_p", "_base", *[f"_g{i}" for i in range(len(group))])


def _runs(drawable: DataFrame, shards: int, seed: int, bits: int) -> DataFrame:
    """The tree's leaves by source: _s and _ends, where in the source's order each shard's run ends.

    ``drawable``: source and lot (a random long), a row for each block of the quotas.
    """
    group = F.pmod(F.xxhash64(F.lit(seed), F.lit("group"), "source"), F.lit(GROUPS)).cast("int")
    lots = drawable.select("source", group.alias("_group"), F.col("lot").alias("_lot"))
    rows = sorted((r[0], r[1]) for r in lots.groupBy("_group").agg(F.count("*")).collect())
    leaves = quota_tree([n for _, n in rows], shards, seed)
    ends_of = [(g, list(accumulate(leaf[i] for leaf in leaves))) for i, (g, _) in enumerate(rows)]
    group_ends = drawable.sparkSession.createDataFrame(ends_of, "_h int, _ends array<bigint>")
    lots = _in_order(lots, ["_group"], [F.shiftrightunsigned("_lot", 1), F.col("source")], F.shiftrightunsigned("_lot", 64 - bits).cast("int"), "_at")
    leaf = F.size(F.filter("_ends", lambda e: e <= F.col("_at")))
    quotas = lots.join(F.broadcast(group_ends), F.col("_group") == F.col("_h")).groupBy("source", leaf.alias("leaf")).agg(F.count("*").alias("n"))
    by_source = quotas.groupBy(F.col("source").alias("_s")).agg(F.collect_list(F.struct("leaf", "n")).alias("_leaves"))
    up_to = lambda k: F.aggregate(F.filter("_leaves", lambda x: x["leaf"] <= k), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    return by_source.select("_s", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), up_to).alias("_ends"))


#: Order of a source's blocks in a pass, after the random number that they are ordered by.
_TIES = ("doc_id", "block", "text_crc32", "size")


def _quotas(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """(_s, quota, last_words): blocks that the mix takes of each source, and words of each copy of the last one (null: all).

    The further pass takes blocks by ``u`` until their words reach the source's rest. The range of u in which it ends
    is found from the ranges' sums; only that range is looked at block by block.
    """
    same = F.col("source").eqNullSafe(F.col("_s"))
    per_range = blocks.groupBy("source", "range").agg(F.sum(F.col("full_words") * F.col("m")).alias("w"), F.count("block").alias("n"))
    own = Window.partitionBy("source").orderBy("range")
    running = per_range.withColumns({"w_before": F.sum("w").over(own) - F.col("w"), "n_before": F.sum("n").over(own) - F.col("n")})
    rest = targets.select(F.col("source").alias("_s"), "rest")
    last = running.join(rest, same).where((F.col("w_before") < F.col("rest")) & (F.col("w_before") + F.col("w") >= F.col("rest"))).select("_s", F.col("range").alias("_r"), "w_before", "n_before", "rest")
    near = blocks.where("block IS NOT NULL").join(last, same & (F.col("range") == F.col("_r")))
    by_u = Window.partitionBy("source").orderBy(F.shiftrightunsigned("u", 1), *_TIES)
    words = F.col("full_words") * F.col("m")
    at = near.withColumns({"nth": F.row_number().over(by_u), "b": F.col("w_before") + F.sum(words).over(by_u.rowsBetween(Window.unboundedPreceding, 0)) - words})
    end = at.where((F.col("b") < F.col("rest")) & (F.col("b") + words >= F.col("rest"))).select("_s", (F.col("n_before") + F.col("nth")).alias("extra"), F.floor((F.col("rest") - F.col("b")) / F.col("m")).cast("long").alias("last_words"))
    counted = blocks.groupBy("source").agg(F.count("block").alias("n")).join(targets.select(F.col("source").alias("_t"), "passes"), F.col("source").eqNullSafe(F.col("_t")))
    return counted.join(end, same, "left").select(F.col("source").alias("_s"), (F.col("n") * F.col("passes") + F.coalesce("extra", F.lit(0))).cast("long").alias("quota"), "last_words")


def mix_blocks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: a row for each drawn block copy, and one with nulls for each document of which nothing is drawn.

    Columns: doc_id, source, size, text_crc32, m (rows that are equal in all of these; they share their blocks'
    fate), source_size, target, block (number in the document), copy, words, shard, slot. Null texts have size 0
    and no blocks; a null source is a source. Empty input gives an empty mix. Only doc_id, source and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", "source", word_count(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    known = staged(slim.groupBy("doc_id", "source", "size", "text_crc32").agg(F.count("*").alias("m")), "mix-sizes")
    sizes = known.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    quota = F.round("target").cast("long")
    targets = staged(
        source_targets(sizes, weights, most_times).withColumns({
            "passes": F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long"),
        }).withColumn("rest", quota - F.col("passes") * F.col("source_size")),
        "mix-targets",
    )
    n_blocks = known.agg(F.sum(F.ceil(F.col("size") / block_words) * F.col("m"))).first()[0] or 0
    # Ranges of the random order, a power of two, so that none holds much over RANGE_BLOCKS blocks.
    bits = max(8, (int(n_blocks) // RANGE_BLOCKS).bit_length() + 1)
    block_no = F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words)))
    blocks = known.select("*", F.explode_outer(block_no).alias("block")).withColumns({
        "full_words": F.when(F.col("block").isNotNull(), F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words)).otherwise(0).cast("long"),
        "u": F.xxhash64(F.lit(seed), F.lit("draw"), "doc_id", "source", "text_crc32", "size", "block"),
    }).withColumn("range", F.shiftrightunsigned("u", 64 - bits).cast("int"))
    quotas = staged(_quotas(blocks, targets), "mix-quotas")
    wanted = targets.select(F.col("source").alias("_t"), "source_size", "target", "passes", "rest").join(quotas, F.col("_t").eqNullSafe(F.col("_s"))).drop("_t")
    joined = blocks.join(wanted, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # Every block, once for each pass that its source has a part in, in the source's permuted order.
    copies = F.when(F.col("block").isNotNull(), F.filter(F.sequence(F.lit(1).cast("long"), F.col("passes") + 1), lambda c: (c <= F.col("passes")) | (F.col("rest") > 0)))
    offered = joined.select("doc_id", "source", "size", "text_crc32", "m", "source_size", "target", "block", "u", "range", "full_words", "quota", "last_words", F.explode_outer(copies).alias("copy"))
    part = (F.coalesce(F.least(F.col("copy") - 1, F.lit(most_times)), F.lit(0)) * (1 << bits) + F.col("range")).cast("int")
    order = [F.col("copy"), F.shiftrightunsigned("u", 1), *map(F.col, _TIES)]
    placed = staged(_in_order(offered.where("copy IS NOT NULL"), ["source"], order, part, "at").drop("range"), "mix-offered")
    runs = _runs(placed.where("at < quota").select("source", F.xxhash64(F.lit(seed), F.lit("tree"), "source", "at").alias("lot")), shards, seed, bits)
    # A copy is drawn if it lies in one of its source's runs; the last one in part.
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("at")))
    drawn = placed.join(runs, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("shard", F.when(F.col("_ends").isNotNull() & (shard < shards), shard).cast("int")).drop("_s", "_ends")
    words = F.when(F.col("at") == F.col("quota") - 1, F.coalesce("last_words", "full_words")).otherwise(F.col("full_words"))
    drawn = staged(drawn.where("shard IS NOT NULL").withColumn("words", words), "mix-drawn")
    mine = F.xxhash64(F.lit(seed), F.lit("slot"), "doc_id", "source", "text_crc32", "size", "block", "copy")
    slots = _in_order(drawn.withColumn("_w", mine), ["shard"], [F.shiftrightunsigned("_w", 1), *map(F.col, _TIES), F.col("copy")], F.shiftrightunsigned("_w", 64 - max(4, bits - 4)).cast("int"), "slot")
    cols = ["doc_id", "source", "size", "text_crc32", "m", "source_size", "target", "block", "copy", "words", "shard", "slot"]
    key = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("doc_id", "source", "size", "text_crc32")]
    some = drawn.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "text_crc32")]).distinct()
    nothing = known.join(some, reduce(Column.__and__, key), "left_anti").join(wanted.select("_s", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).withColumns({
        "block": F.lit(None).cast("long"), "copy": F.lit(None).cast("long"), "words": F.lit(None).cast("long"), "shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long"),
    })
    return slots.select(*cols).unionByName(nothing.select(*cols))


def mix_counts(docs: DataFrame, **how: object) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, n_blocks, shards (those that hold a part of it)."""
    blocks = mix_blocks(docs, **how)
    per = blocks.groupBy("doc_id", "source", "size", "text_crc32", "m", "source_size", "target").agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.count("words").alias("n_blocks"), F.array_sort(F.collect_set("shard")).alias("shards"))
    return per.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("_n", "m")


def op4_mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_blocks, shards of every row; nulls, ties, repeats and empty tables: as ``mix_blocks`` says."""
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", "taken", "n_blocks", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``docs``: each row as often as the words drawn from it make it up, rounded by a fair hash.

    A document of which 1.3 times its words are drawn comes once, or twice with chance 0.3. Documents without words
    come never. Rows with one doc_id, source and text are alike. All columns come back unchanged, whatever they are called.
    """
    crc, times, i, *key = free_names(docs.columns, 6)
    own = ("doc_id", "source", "text_crc32")
    counts = mix_blocks(docs.select("doc_id", "source", "text"), seed=seed).groupBy(*own).agg((F.sum("words") / F.max("size")).alias("part"))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("times"), *own), F.lit(1_000_003)) / 1_000_003
    wanted = counts.select(*[F.col(c).alias(k) for c, k in zip(own, key, strict=True)], F.floor(F.col("part") + chance).cast("int").alias(times)).where(F.col(times) > 0)
    keyed = docs.withColumn(crc, F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(("doc_id", "source", crc), key, strict=True)]
    hit = keyed.join(wanted, reduce(Column.__and__, same))
    return hit.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
