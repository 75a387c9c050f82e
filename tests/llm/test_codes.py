"""Vector codes against plain integer loops and against SQL, hard vectors, decoding."""

import hashlib
import math
import random

import duckdb
import pytest

from tessera.llm import codes, queries

VECTOR = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def plain(rows):
    """The contract by loops: {vec_id: (code, error, label_error, digest)} of rows with distinct ids."""
    kept = sorted((i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // 8
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(part(v, p), books[p])[1], []).append(part(v, p))
            for e, xs in members.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found, by_label = {}, {}
    for i, v, label in kept:
        own = [nearest(part(v, p), books[p]) for p in range(8)]
        found[i] = ("".join(f"{e:02x}" for _, e in own), sum(far for far, _ in own), label)
        by_label[label] = by_label.get(label, 0) + found[i][1]
    return {i: (code, error, by_label[label], digest) for i, (code, error, label) in found.items()}


def vectors(n, width, seed=1):
    rng = random.Random(seed)
    return [(3 * i + 1, [rng.choice([0.0, -0.5, 1 / 3, rng.gauss(0, 1)]) for _ in range(width)], rng.choice([None, 1, 2, 2])) for i in range(n)]


def result(found):
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()}


@pytest.mark.parametrize(("n", "width"), [(300, 16), (40, 64), (7, 8)])
def test_equals_plain_loops(spark, n, width):
    rows = vectors(n, width)
    rows += [(0, None, 1), (2, [None] + [0.0] * (width - 1), 1), (5, [float("nan")] * width, 2), (8, [float("-inf")] * width, None)]
    rows.append((10**9, list(rows[0][1]), None))  # a repeated vector
    rows = [(i, v and [None if x is None else spark_float(x) for x in v], label) for i, v, label in rows]
    random.Random(2).shuffle(rows)
    assert result(codes.op13_vector_codes(spark.createDataFrame(rows, VECTOR).repartition(5))) == plain(rows)


def spark_float(x):
    import numpy as np

    return float(np.float32(x))


def test_query_equals_its_sql(spark):
    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(map(tuple, duck.execute(codes.OP13_SQL).fetchall()))
    got = queries.queries()["op13_vector_codes"](spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_ids_that_repeat_start_one_entry_each(spark):
    rows = vectors(40, 8)
    rows = [r for i, r in enumerate(rows) for _ in range(30 if i < 3 else 1 + i % 2)]
    first = codes._first_entries(codes.integer_vectors(spark.createDataFrame(rows, VECTOR).repartition(4)), 8, 16)
    want = [[math.floor(4096 * spark_float(x)) for x in v] for _, v, _ in vectors(40, 8)[:16]]
    assert first.transpose(1, 0, 2).reshape(16, 8).tolist() == want


def test_hard_rows(spark):
    rows = vectors(30, 16) + vectors(30, 16)[:5] * 9  # repeated rows, more than a codebook has entries
    rows += [(None, rows[0][1], 1), (900, [], 1), (901, [1.0] * 15, 1), (902, [1.0] * 24, 1), (903, [3e38] * 16, 2), (904, [-3e38] * 16, 2)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTOR + ", v STRING, error INT")
    found = codes.op13_vector_codes(frame).collect()
    kept = [r for r in rows if len(r[1]) == 16]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in kept)
    assert all(0 <= r["error"] <= r["label_error"] for r in found)
    by_id = {}
    for r in found:
        assert by_id.setdefault(r["vec_id"], tuple(r)) == tuple(r)
    assert codes.op13_vector_codes(frame.limit(0)).count() == 0
    assert codes.op13_vector_codes(frame.where("vec_id IS NULL")).first()["code"] == ""


def test_decoded_vectors_are_as_far_as_the_errors_say(spark):
    rows = vectors(200, 16)
    own = codes.integer_vectors(spark.createDataFrame(rows, VECTOR))
    books = codes.fit(own, entries=32, rounds=3)
    back = codes.decode(codes.encode(own, books), books).collect()
    floors = {r["vec_id"]: r["v"] for r in own.collect()}
    for r in back:
        assert sum((a - round(b * 4096)) ** 2 for a, b in zip(floors[r["vec_id"]], r["approximate"], strict=True)) == r["error"]


def test_errors_of_many_labels_are_joined_by_sorting(spark, monkeypatch):
    frame = spark.createDataFrame(vectors(60, 8), VECTOR)
    want = result(codes.op13_vector_codes(frame))
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert result(codes.op13_vector_codes(frame)) == want
