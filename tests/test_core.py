"""Golden rows for the scalar functions, rules, ranges, merges, sources and the micro-batch form."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import classify, matching, merge, ranges, reads, shape
from tessera.operators import relational as rel
from tessera.sources import files
from tessera.streaming import microbatch


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(("a", "b", "holds"), [
    ("Pokémon: Horizons", "Pokemon Horizons", lambda s: s == 1), ("Hero Academia My", "My Hero Academia", lambda s: s == 1),
    ("Blue Lock", "Blue Period", lambda s: s < 0.5), ("Love Live", "Love Stage", lambda s: s < 0.5),
    ("Cyberpunk Edgerunners", "Cyberpunk: Edgerunner", lambda s: s > 0.7), ("Sword Art Online", "Sword Art Online Alternative", lambda s: s < 1),
    ("", "x", lambda s: s == 0), (None, "x", lambda s: s == 0),
])
def test_title_similarity(spark, a, b, holds):
    titles = spark.createDataFrame([(a, b)], "a STRING, b STRING").select(*[fn.comparable_title(F.col(c)).alias(c) for c in "ab"])
    assert holds(titles.select(fn.title_similarity(F.col("a"), F.col("b"))).first()[0])


def test_scalars(spark):
    c = F.col("a")
    rows = [("Session #2: Stray Dog Strut",), ("#0",), ("none",)]
    assert values(spark, rows, "a STRING", fn.explicit_number(c)) == [(2,), (None,), (None,)]
    assert values(spark, [("12",), ("12.0",), ("1e2",), ("-3",), ("",), ("x",)], "a STRING", fn.positive_id(c)) == [(12,), (12,), (100,), (None,), (None,), (None,)]
    assert values(spark, [(49.5,), (-2.5,), (500.0,), (None,), (float("nan"),)], "a DOUBLE", fn.clamp_confidence(c)) == [(50,), (0,), (100,), (0,), (0,)]
    assert values(spark, [("2024-02-30",), ("2024-02-29",), ("x",)], "a STRING", fn.strict_date(c).cast("string")) == [(None,), ("2024-02-29",), (None,)]
    assert values(spark, [('["a",1,null,"b"]',), ("bad",), (None,)], "a STRING", fn.json_strings(c)) == [(["a", "b"],), ([],), ([],)]
    assert values(spark, [("12:3",), ("12:0",), ("12",)], "a STRING", *fn.composite_id(c)) == [(12, 3), (None, None), (None, None)]
    assert values(spark, [("  Hello, World_ x-- ",)], "a STRING", fn.slugify(c)) == [("hello-world-x",)]
    dates = values(spark, [(2004, 10, None), (None, 1, 1)], "y INT, m INT, d INT", fn.partial_date(F.col("y"), F.col("m"), F.col("d")))
    assert dates == [("2004-10-01",), (None,)]


@pytest.mark.parametrize(("rows", "want"), [
    ([("provider", "available", 90)], ("confirmed", 90)), ([("community", "not_available", 50)], ("possible", 50)),
    ([("official_site", "not_available", 90)], ("not_available", 90)), ([("provider", "partial", 80)], ("partial", 80)),
    ([("provider", None, None)], ("unknown", 0)),
])
def test_evidence(spark, rows, want):
    df = spark.createDataFrame([(1, *r) for r in rows], "k INT, s STRING, v STRING, c INT")
    assert tuple(classify.resolve_evidence(df, ["k"], "s", "v", "c").select("status", "score").first()) == want


@pytest.mark.parametrize(("owners", "want"), [
    ([20, 20, 10, 10, 10], "owner-then-orphan-adjacent"), ([10, 10, 20, 20], "orphan-then-owner-adjacent"), ([20, 20, None, 10, 10], "owner-orphan-with-gap"),
    ([20, 10, 20, 10], "fragmented-between-owner-and-orphan"), ([20, 30, 10], "other-anime-involved"), ([None], "unmapped-only"), ([10], "orphan-only"), ([20], "owner-only"),
    ([10, None, 10, 20], "fragmented-between-owner-and-orphan"), ([(1, 10), (2, 10), (1, 20)], "owner-orphan-with-gap"), ([(1, 10), (1, 10), (2, 20), (0, 30)], "orphan-then-owner-adjacent"),
])
def test_ownership(spark, owners, want):
    df = spark.createDataFrame([(1, *(o if isinstance(o, tuple) else (i + 1, o))) for i, o in enumerate(owners)], "s INT, n INT, o INT")
    assert classify.ownership(df, ["s"], "n", "o", F.lit(10), F.lit(20)).first()["ownership"] == want


@pytest.mark.parametrize(("local", "provider", "gap", "missing", "offset"), [
    (range(1, 13), range(13, 25), "complete", 0, 12), (range(1, 12), range(13, 24), "trailing", 1, 12), ([3, 4, 5], [15, 16, 17], "both-ends", 9, 12),
    ([1, 2, 4], [13, 14, 15], "internal-or-nonlinear", 9, None), ([1, 2, 3], [13, 14, 16], "internal-or-nonlinear", 9, None),
])
def test_coverage(spark, local, provider, gap, missing, offset):
    df = spark.createDataFrame([(1, x, p) for x, p in zip(local, provider, strict=True)], "k INT, x INT, p INT")
    got = ranges.coverage(df, ["k"], "x", "p", F.lit(12)).first()
    assert (got["gap"], got["n_missing"], got["offset"]) == (gap, missing, offset)


def test_segments(spark):
    c = [F.col(x) for x in ("ps", "pe", "ls", "le")]
    rows = [(13.0, 24.0, 1.0, 12.0), (13.0, 24.0, 1.0, 11.0), (13.0, 12.0, 1.0, 12.0), (0.0, 1.0, 1.0, 2.0), (1.0, 2.0, -1.0, 0.0), (1.0, 2.5, 1.0, 2.0), (None, 2.0, 1.0, 2.0), (1.0, 2.0, 4.0, 3.0)]
    want = [None, "unequal-span", "reversed-provider-range", "non-positive-start", "non-positive-start", "non-integer", "non-integer", "reversed-local-range"]
    assert values(spark, rows, "ps DOUBLE, pe DOUBLE, ls DOUBLE, le DOUBLE", ranges.segment_fault(*c)) == [(w,) for w in want]
    assert values(spark, [(13,), (24,), (12,), (25,)], "n INT", *[f(F.col("n"), F.lit(13), F.lit(24), F.lit(1), F.lit(12)) for f in (ranges.to_local, ranges.to_provider)]) == [(1, None), (12, None), (None, 24), (None, None)]
    points = spark.createDataFrame([(1, n) for n in range(1, 49)], "k INT, n INT")
    segments = spark.createDataFrame([(1, 25, 48, 1, 24)], "k INT, ps INT, pe INT, ls INT, le INT")
    mapped = {r["n"]: r["local"] for r in ranges.map_points(points, segments, ["k"], "n").collect()}
    assert len(mapped) == 24 and mapped[25] == 1 and mapped[48] == 24


def test_merges(spark):
    schema = "k INT, origin STRING, conf INT, v STRING"
    t, s = spark.createDataFrame([(1, "manual", 80, "a"), (2, "fuzzy", 60, None)], schema), spark.createDataFrame([(1, "api", 90, "b"), (2, "api", 50, "c"), (3, "api", 10, "d")], schema)
    got = {tuple(r) for r in merge.keep_provenance(t, s, ["k"], "origin", "conf", ("manual",)).collect()}
    assert got == {(1, "manual", 90, "a"), (2, "api", 60, "c"), (3, "api", 10, "d")}
    merged, rejects = merge.guarded(t, s, ["k"], "origin")
    assert {r["k"] for r in rejects.collect()} == {1, 2} and {(r["k"], r["v"]) for r in merged.collect()} == {(1, "a"), (2, None), (3, "d")}
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True)], "g INT, k INT, p BOOLEAN")
    chosen = spark.createDataFrame([(1, 2)], "g INT, k INT")
    assert {tuple(r) for r in merge.promote(rows, ["g"], "p", chosen, "k").collect()} == {(1, 1, False), (1, 2, True), (2, 3, True)}


def test_sources(spark, tmp_path):
    ids = tmp_path / "ids"
    ids.mkdir()
    (ids / "a.txt").write_text("3\n 7 \nx\n-1\n0\n3\n")
    files.append_new_ids(spark, str(ids), spark.createDataFrame([(7,), (9,)], "id BIGINT"))
    assert sorted(r[0] for r in files.id_lines(spark, str(ids)).collect()) == [3, 7, 9]
    cache = tmp_path / "cache.tsv"
    cache.write_text("5\t1000\nbad\t1\n6\tx\n")
    assert [r["id"] for r in files.timed_cache(spark, str(cache)).collect()] == [5]
    log = tmp_path / "log"
    log.write_text("\n".join([json.dumps({"at": i}) for i in range(5)] + ["{bad", "x" * 20_000]))
    assert [r["at"] for r in files.log_tail(spark, str(log), "at INT", "at", 2).collect()] == [4, 3]


def test_micro_batches_equal_batch(spark, tmp_path):
    src, schema = tmp_path / "in", "k INT, origin STRING, conf INT"
    empty = spark.createDataFrame([], schema)
    batches = [[(1, "manual", 80), (2, "api", 50)], [(1, "api", 90), (3, "api", 10)]]

    def fold(before, batch):
        return merge.keep_provenance(before, batch, ["k"], "origin", "conf", ("manual",))

    want = empty
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema)
        part.coalesce(1).write.mode("append").parquet(str(src))
        want = fold(want, part)
        stream = spark.readStream.schema(schema).parquet(str(src))
        microbatch.maintain(stream, str(tmp_path / "state"), str(tmp_path / "cp"), empty, fold).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "state" / f"version={i}"))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_ranking(spark):
    rows = spark.createDataFrame([(1, "a", 150), (1, "b", 145), (2, "a", 150), (2, "b", 130), (3, "a", 5)], "k INT, n STRING, s INT")
    assert {(r["k"], r["n"]) for r in rel.clear_winner(rows, ["k"], "s", [F.col("n")], 10).collect()} == {(2, "a"), (3, "a")}
    assert {r["k"] for r in rel.clear_winner(rows, ["k"], "s", [F.col("n")], 10, 45).collect()} == {2}
    assert rel.both_ways(rows.select("k", F.lit(9).alias("m")), "k", "m").count() == 6


def test_ranges_of_other_owners(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(3), s, s + rng.randrange(9)) for i in range(200) for s in [rng.randrange(60)]] + [(900, 0, 0, None, 5), (901, 0, 1, 9, 3), (902, None, 0, 1, 60), (903, 1, None, 1, 60)]
    frame = spark.createDataFrame(rows, "i INT, k INT, owner INT, s INT, e INT")
    meets = lambda a, b: a[1] == b[1] and a[2] != b[2] and None not in (*a[1:4], *b[1:4]) and a[3] <= a[4] and b[3] <= b[4] and a[3] <= b[4] and b[3] <= a[4]
    want = {a[0] for a in rows if not any(meets(a, b) for b in rows)}
    assert {r["i"] for r in ranges.without_overlap(frame, ["k"], "owner", "s", "e").collect()} == want
    twice = ranges.without_overlap(frame.unionByName(frame), ["k"], "owner", "s", "e").collect()
    assert sorted(r["i"] for r in twice) == sorted([*want, *want])
    segments = spark.createDataFrame([(k, s, s + 70, 1, 71) for k in range(3) for s in (1, 100, 500)], "k INT, ps INT, pe INT, ls INT, le INT")
    points = spark.createDataFrame([(k, n, n) for k in range(4) for n in range(0, 600, 7)], "k INT, n INT, x INT")
    few = [sorted(map(tuple, f.collect())) for f in (ranges.map_points(points, segments, ["k"], "n"), ranges.outside_segments(points, segments, ["k"], "n", "x"))]
    monkeypatch.setattr(ranges, "BROADCAST_SEGMENTS", 2)
    many = [sorted(map(tuple, f.collect())) for f in (ranges.map_points(points, segments, ["k"], "n"), ranges.outside_segments(points, segments, ["k"], "n", "x"))]
    assert few == many and few[0]


@pytest.mark.parametrize(("failed", "over", "begun"), [("fof", [0, 2], [0]), ("oof", [2], [0]), ("ooooof", [], []), ("f" + "o" * 39 + "f" * 8, [0, 44, 45, 46, 47], [0, 11])])
def test_back_off(spark, failed, over, begun):
    rows = spark.createDataFrame([(1, i, i // 4, c == "f") for i, c in enumerate(failed)], "k INT, i INT, batch BIGINT, failed BOOLEAN")
    seen = microbatch.failure_windows(rows, ["k"], [F.col("i")], F.col("failed"))
    assert sorted(r["i"] for r in seen.where("over").collect()) == over
    assert sorted(r["batch"] for r in microbatch.back_offs(seen, ["k"], "batch").collect()) == begun


def test_paths_keep_plus_signs(spark):
    rows = [("/a+b/%C3%A9//c%20d/%zz/",)]
    assert values(spark, rows, "p STRING", fn.path_segments(F.col("p"))) == [(["a+b", "é", "c d", "%zz"],)]
    assert values(spark, [("a b+c~(d)!*'é/",)], "p STRING", fn.encoded(F.col("p"))) == [("a%20b%2Bc~(d)!*'%C3%A9%2F",)]


@pytest.mark.parametrize(("row", "want"), [((0, 0, 10), (0, 0, 0.0, None)), ((12, 10, 60), (0, 100, 12.0, 0)), ((1, 3, 0), (2, 33, 0.0, None)), ((5, 10, 90), (5, 50, 3.3333333333333335, 90))])
def test_progress(spark, row, want):
    got = spark.createDataFrame([row], "d INT, t INT, s INT").select(*reads.progress(F.col("d"), F.col("t"), F.col("s"))).first()
    assert tuple(got) == want


def test_slugs_are_unique_as_if_rows_came_in_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "b", "", " ", "c", *[f"{x}-{rng.randrange(1, 40)}" for x in ("a", "b", "a-5", "b-7")]])) for i in range(1, 40)]
    rows += [(5000, "a"), (5001, "a-5000"), (5002, "a-5000-5001"), (4999, "a-5002"), (5003, "a-5003-5002")]
    taken = [("b",), ("a-9",), ("c-3",), ("7",)]
    have, want = {t for t, in taken}, {}
    for i, slug in sorted(rows):
        one = slug if slug.strip() else str(i)
        own = next((s for s in (one, f"{one}-{i}") if s not in have), f"{one}-{i}-now")
        have.add(own)
        want[i] = own
    got = matching.unique_slugs(spark.createDataFrame(rows, "id INT, slug STRING"), "slug", "id", spark.createDataFrame(taken, "slug STRING"), "now").collect()
    assert {r["id"]: r["slug"] for r in got} == want


def test_decompositions_equal_the_unicode_data(spark):
    rng = random.Random(4)
    codes = [*range(1, 0x3400), *range(0xA000, 0xD800, 5), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F260), *range(0x2F800, 0x2FA20), *rng.sample(range(0x10000, 0x110000), 500)]
    rows = [(f"a{chr(c)}b",) for c in codes] + [("".join(chr(rng.choice(codes)) for _ in range(20)),) for _ in range(200)] + [("",), (None,)]
    plain = lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.category(x).startswith("M"))
    for text, got in spark.createDataFrame(rows, "t STRING").select("t", fn.decomposed(F.col("t"))).collect():
        assert got == plain(text), (text, got)


def test_json_set(spark):
    j = F.col("j")
    rows = [('{"a":1,"b":{"c":[1,2],"d":"x\\"y"}}',), ("[1]",), ("bad",), (None,), ('{"b":3}',), ("{}",)]
    top = values(spark, rows, "j STRING", fn.json_set(j, ["a"], F.lit('n"o')))
    assert [r[0] for r in top] == ['{"a":"n\\"o","b":{"c":[1,2],"d":"x\\"y"}}', "[1]", "bad", None, '{"a":"n\\"o","b":3}', '{"a":"n\\"o"}']
    deep = values(spark, rows, "j STRING", fn.json_set(j, ["b", "e"], F.lit("n")))
    assert [r[0] for r in deep] == ['{"a":1,"b":{"c":[1,2],"d":"x\\"y","e":"n"}}', "[1]", "bad", None, '{"b":3}', "{}"]
    assert values(spark, rows[:1], "j STRING", fn.json_set(j, ["a"], F.lit(None).cast("string"))) == [(None,)]


def test_shapes(spark):
    for name in ("shape_x_a", "shape_x_b"):
        spark.range(1).select(F.col("id"), F.lit(1).alias("N")).createOrReplaceTempView(name)
    have = shape.catalogue(spark, "shape_x_").unionByName(spark.createDataFrame([("index", "a", "id")], "kind STRING, table STRING, name STRING"))
    good = shape.shape_report(have, shape.wanted_shape(spark, {"A": ["ID", "n"]}, ["gone"], {"a": ["id"]}))
    assert tuple(shape.verdict(good).first()) == (True, 4, 0, 0, 3)
    bad = shape.verdict(shape.shape_report(have, shape.wanted_shape(spark, {"a": ["x"], "c": []}, ["b"], {"a": ["n"]}))).first()
    assert tuple(bad)[:4] == (False, 1, 3, 1) and shape.exists(spark, "shape_x_a") and not shape.exists(spark, "shape_x_c")
