"""Compression of vectors into codes: integer product quantisation, exact at every step.

Components become integers, vectors are cut into parts, and every part's place has its codebook of some entries. In each
round the codebooks are broadcast, Arrow batches find the nearest entry of every part by norm expansion (|x|^2 - 2xy +
|y|^2) with integer matrix products, each task adds up its parts by entry, and a grouped shuffle merges the sums. All
numbers are integers, so the result doesn't depend on how rows are dealt out or on tasks that run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, staged

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Labels up to which their sums are broadcast (some 50 bytes each).
BROADCAST_LABELS = 200_000


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``, integers."""

    entries: np.ndarray
    scale: int

    @property
    def sha256(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def most(width: int) -> int:
    """The largest component that sums of squared distances over a part of ``width`` components and over all parts allow in 64 bits."""
    return min(int((2**56 / max(1, width)) ** 0.5), 2**31 - 1)


def _usable(vector: Column, parts: int) -> Column:
    """Not null, without null or non-finite components, and with a length that the number of parts divides."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite, F.lit(False))


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v of the rows to be coded: v has floor(scale * x) of each component x, as a staged table.

    Rows whose vector is null, empty or holds a null or non-finite component go, as do those whose length isn't a
    multiple of ``parts`` or isn't the most frequent one (the larger of two as frequent). Components beyond ``most``
    count as that; for 8 components a part it is 2^26, 2^14 before scaling.
    """
    names = {c.lower(): c for c in vectors.columns}
    label = F.col(f"`{names['label']}`") if "label" in names else F.lit(None).cast("int")
    whole = vectors.select("vec_id", label.alias("label"), F.col("embedding").cast("array<double>").alias("v")).where(_usable(F.col("v"), parts))
    lengths = whole.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).head()
    width = lengths["length"] if lengths else parts
    bound = float(most(width // parts))
    scaled = F.transform("v", lambda x: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(x * F.lit(float(scale))).cast("double"))).cast("int"))
    return staged(whole.where(F.size("v") == width).select("vec_id", "label", scaled.alias("v")), "vectors")


def _parts_of(column: pd.Series, parts: int) -> np.ndarray:
    """[part, row, position] of a batch's vectors."""
    rows = np.stack(column.to_numpy()).astype(np.int64)
    return rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of ``x``, the first of those as near."""
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _first_entries(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the least ids; of rows that repeat an id, the least vector counts."""
    ids: list = []
    while len(ids) < entries:  # once, unless ids repeat; each time the tasks' least ids come together, no row is exchanged
        rest = vectors.where("vec_id IS NOT NULL").select("vec_id")
        least = [r[0] for r in (rest.where(F.col("vec_id") > F.lit(ids[-1])) if ids else rest).orderBy("vec_id").limit(entries).collect()]
        if not least:
            break
        ids = [*ids, *sorted(set(least))][:entries]
    own = vectors.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")
    rows = [r["v"] for r in own.collect()] if ids else []  # as many as a codebook has entries
    if not rows:
        return np.empty((parts, 0, 0), dtype=np.int64)
    return np.array(rows, dtype=np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the mean, rounded down, of the parts nearest to it; an entry without any stays."""
    parts, n, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((parts, n, width + 1), dtype=np.int64)
        for f in frames:
            if len(f):
                for p, x in enumerate(_parts_of(f["v"], parts)):
                    at, _ = nearest(x, sent.value[p])
                    np.add.at(total[p], at, np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1))
        cell = np.flatnonzero(np.repeat(total[:, :, width].ravel() > 0, width + 1))
        yield pd.DataFrame({"cell": cell, "amount": total.ravel()[cell]})

    sums = vectors.select("v").mapInPandas(run, "cell long, amount long").groupBy("cell").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    merged = np.zeros(parts * n * (width + 1), dtype=object)
    for cell, amount in sums.collect():  # one number for each component of the codebooks, and one for each entry
        merged[cell] = int(amount)
    sent.unpersist()
    merged = merged.reshape(parts, n, width + 1)
    out = books.copy()
    for p, e in zip(*np.nonzero(merged[:, :, width]), strict=True):
        out[p, e] = [x // merged[p, e, width] for x in merged[p, e, :width]]  # rounds down, below zero too
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of the ``integer_vectors``. With fewer ids than entries there are as many entries as ids."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    books = _first_entries(vectors, parts, entries)
    if books.shape[1]:
        for _ in range(rounds):
            books = _moved(vectors, books)
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances of all parts) of every row of ``integer_vectors``.

    Without codebook entries, as where all ids are null, codes are empty and errors 0.
    """
    kinds = dict(vectors.dtypes)
    sent, parts, n = vectors.sparkSession.sparkContext.broadcast(books.entries), *books.entries.shape[:2]
    digits = np.array([f"{i:02x}" for i in range(256)], dtype=object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            code, error = np.full(len(f), "", dtype=object), np.zeros(len(f), dtype=np.int64)
            if len(f) and n:
                for p, x in enumerate(_parts_of(f["v"], parts)):
                    at, far = nearest(x, sent.value[p])
                    code, error = code + digits[at], error + far
            yield pd.DataFrame({"vec_id": f["vec_id"], "label": f["label"], "code": code, "error": error})

    return vectors.mapInPandas(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(coded: DataFrame, books: Codebooks, name: str = "approximate") -> DataFrame:
    """``coded`` with the vector that each code stands for, in the components' own scale; null for codes that are none."""
    kind = "array<double>"
    parts, n, width = books.entries.shape
    table = F.lit(books.entries.reshape(parts * n, width).tolist() if n else None).cast("array<array<double>>")
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * n
    one = F.flatten(F.array(*(F.get(table, entry(p)) for p in range(parts)))) if n else F.lit(None)
    scaled = F.transform(one.cast(kind), lambda x: x / F.lit(float(books.scale)))
    return coded.withColumn(name, F.when(F.length("code") == 2 * parts, scaled))


def with_label_error(coded: DataFrame, name: str = "label_error") -> DataFrame:
    """``coded`` with the errors' sum over rows of the same label, null labels together.

    Errors are added up before they are exchanged, so that a label of most rows costs a row a task. The sums are broadcast
    while they are few; beyond that the join is by sorting, where AQE splits a label of most rows.
    """
    key, total = free_names([*coded.columns, name], 2)
    sums = staged(coded.groupBy(F.col("label").alias(key)).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias(total)), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    longest = F.lit(2**63 - 1).cast("decimal(38,0)")
    return coded.join(sums, F.col("label").eqNullSafe(F.col(key))).withColumn(name, F.least(F.col(total), longest).cast("long")).drop(key, total)


def op13_vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row whose vector is whole.

    Rows whose vector is null, empty or holds null or non-finite components go, see ``integer_vectors`` for odd lengths and
    huge components. Rows that repeat a vec_id are coded each; for a start, an id's least vector counts once. A row with a
    null vec_id is coded but starts no entry. Equal distances go to the lower index. Other columns than vec_id, embedding
    and label aren't read; an empty table gives an empty result.
    """
    vectors = integer_vectors(embeddings)
    books = fit(vectors)
    coded = staged(encode(vectors, books), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def _sql() -> str:
    """Six rounds as a chain of tables: assignments a0 to a6 of parts to the entries of codebooks c0 to c6."""
    far = "list_sum(list_transform(range(1, len(x.s) + 1), lambda i: (x.s[i] - c.s[i]) * (x.s[i] - c.s[i])))"
    chain = []
    for r in range(ROUNDS + 1):
        chain.append(f"a{r} AS MATERIALIZED (SELECT x.row, x.p, arg_min(c.e, {far} * {ENTRIES} + c.e) AS e, min({far}) AS far FROM parts x JOIN c{r} c USING (p) GROUP BY x.row, x.p)")
        if r < ROUNDS:
            chain.append(f"""m{r} AS MATERIALIZED (
  SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS s FROM (
    SELECT p, e, i, sum(v)::HUGEINT AS t, count(*)::HUGEINT AS n FROM (
      SELECT p, a{r}.e, generate_subscripts(s, 1) AS i, unnest(s) AS v FROM a{r} JOIN parts USING (row, p)) GROUP BY p, e, i) GROUP BY p, e
), c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.s::BIGINT[], c.s) AS s FROM c{r} c LEFT JOIN m{r} m USING (p, e))""")
    steps = ", ".join(chain)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS s FROM kept, range({PARTS}) AS t(p)
), c0 AS MATERIALIZED (SELECT p, row - 1 AS e, s FROM parts WHERE row <= {ENTRIES}), {steps}, books AS (
  SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS}
), coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', a.e), '' ORDER BY a.p) AS code, sum(a.far)::BIGINT AS error FROM a{ROUNDS} a JOIN kept k USING (row) GROUP BY row, k.vec_id, k.label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books
"""


OP13_SQL = _sql()
