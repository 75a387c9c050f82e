"""Stores that change as a whole, moves that are verified, and small files that are whole or absent."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import moves
from tessera.operators.moves import Moves
from tessera.sources import reports, shared, store

ROWS = "mapping_id INT, episode_id INT, provider STRING, source STRING"
MOVE = "mapping_id INT, from_id INT, to_id INT, provider STRING"


@pytest.fixture
def root(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [(1, 10, "a", "x"), (2, 20, "a", "x"), (3, 30, "a", "x"), (4, 30, "b", "x"), (5, 50, None, "x"), (6, 60, "a", "x"), (6, 61, "a", "x")]
    store.publish(spark, root, store.latest(spark, root), {"m": store.stage(spark.createDataFrame(rows, ROWS), root, "m")})
    return root


def asked(spark, rows, **more):
    return Moves(spark.createDataFrame(rows, MOVE), "mapping_id", "episode_id", ("provider",), **more)


@pytest.mark.parametrize(("planned", "faults"), [
    ([(1, 10, 40, "a")], {}), ([(1, 10, 20, "a"), (2, 20, 21, "a")], {}), ([(1, 10, 20, "a"), (2, 20, 10, "a")], {}), ([(4, 30, 10, "b")], {}), ([(5, 50, 51, None)], {}),
    ([(1, 10, 30, "a"), (2, 20, 30, "a")], {1: "shared-target", 2: "shared-target"}), ([(1, 10, 40, "a"), (1, 10, 41, "a")], {1: "moved-twice"}), ([(1, 10, 20, "a")], {1: "occupied-target"}),
    ([(9, 10, 40, "a")], {9: "unknown-row"}), ([(6, 60, 40, "a")], {6: "ambiguous-row"}), ([(1, 11, 40, "a"), (2, 20, 21, "b")], {1: "not-at-origin", 2: "not-at-origin"}), ([(3, 30, 40, "a")], {3: "blocked"}),
    ([(1, None, 40, "a")], {1: "not-at-origin"}),
])
def test_moves_are_judged_by_where_rows_stand_afterwards(spark, root, planned, faults):
    before = store.read(spark, root, "m")
    plan = asked(spark, planned, blocked=spark.createDataFrame([(3,)], "mapping_id INT"))
    assert {r["mapping_id"]: r["fault"] for r in moves.move_faults(before, plan).collect()} == faults
    old, rows = store.latest(spark, root), sorted(map(str, before.collect()))
    if faults:
        with pytest.raises(store.Refused):
            moves.carry_out(spark, root, {"m": plan})
        assert store.latest(spark, root) == old
    else:
        new = moves.carry_out(spark, root, {"m": plan})
        after = {(r[0], r[1]) for r in store.read(spark, root, "m").collect()}
        assert new.number == 2 and {(m, to) for m, _, to, _ in planned} <= after and len(after) == 7
    assert sorted(map(str, store.read(spark, root, "m", old).collect())) == rows


def test_a_failure_between_stage_and_publish_leaves_the_store(spark, root, monkeypatch):
    rows, old = sorted(map(str, store.read(spark, root, "m").collect())), store.latest(spark, root)

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(store, "publish", crash)
    with pytest.raises(OSError, match="gone"):
        moves.carry_out(spark, root, {"m": asked(spark, [(1, 10, 40, "a")])})
    monkeypatch.undo()
    assert store.latest(spark, root) == old and sorted(map(str, store.read(spark, root, "m").collect())) == rows
    assert len(store.vacuum(spark, root)) == 1 and sorted(map(str, store.read(spark, root, "m").collect())) == rows


def test_an_audit_sees_what_a_faulty_write_did(spark, root, monkeypatch):
    before, plan = store.read(spark, root, "m"), asked(spark, [(1, 10, 40, "a")], changes={"source": F.lit("system")})
    good = moves.moved(before, plan)
    assert {r["n"] for r in moves.move_audit(before, good, plan).collect()} == {0}
    for bad, check in ((good.where("mapping_id <> 2"), "rows"), (before, "wrong-place"), (good.withColumn("source", F.lit("y")), "touched"), (good.withColumn("mapping_id", F.lit(1)), "shared-key"), (good.withColumn("episode_id", F.lit(40)), "shared-place")):
        assert moves.move_audit(before, bad, plan).where("n > 0").where(F.col("check") == check).count() == 1
    monkeypatch.setattr(moves, "moved", lambda rows, plan: rows)
    with pytest.raises(store.Refused, match="wrong-place"):
        moves.carry_out(spark, root, {"m": plan})
    assert store.latest(spark, root).number == 1


def test_tables_move_together_or_not_at_all(spark, root):
    store.publish(spark, root, store.latest(spark, root), {"n": store.stage(store.read(spark, root, "m").where("mapping_id < 6"), root, "n")})
    with pytest.raises(store.Refused) as refused:
        moves.carry_out(spark, root, {"n": asked(spark, [(1, 10, 40, "a")]), "m": asked(spark, [(1, 10, 20, "a")])})
    assert refused.value.faults == {"m: occupied-target": 1} and store.latest(spark, root).number == 2
    moves.carry_out(spark, root, {"n": asked(spark, [(1, 10, 40, "a")]), "m": asked(spark, [(1, 10, 41, "a")])})
    assert [store.read(spark, root, t).where("mapping_id = 1").first()["episode_id"] for t in "nm"] == [40, 41]


def test_of_two_writers_one_wins(spark, root):
    old, place = store.latest(spark, root), store.stage(store.read(spark, root, "m").limit(1), root, "m")
    done, lost = [], []

    def write():
        try:
            done.append(store.publish(spark, root, old, {"m": place}))
        except store.Conflict:
            lost.append(1)

    threads = [threading.Thread(target=write) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 1 and len(lost) == 3 and store.latest(spark, root).number == 2


def test_vacuum_keeps_what_the_last_commits_name(spark, root):
    for k in range(3):
        moves.carry_out(spark, root, {"m": asked(spark, [(1, 10 + k, 11 + k, "a")])})
    assert len(store.vacuum(spark, root, 2)) == 2 and store.read(spark, root, "m").count() == 7
    assert store.read(spark, root, "m", store.commit_at(spark, root, 3)).count() == 7
    with pytest.raises(LookupError):
        store.commit_at(spark, root, 1)


def test_a_reader_never_sees_half_a_file(spark, tmp_path):
    path, values, seen, stop = f"file://{tmp_path}/a/state.json", [{"n": [i] * 20_000} for i in range(30)], [], threading.Event()
    assert shared.load_json(spark, path) is None
    shared.save_json(spark, path, values[0])

    def watch():
        while not stop.is_set():
            seen.append(shared.load_json(spark, path))

    reader = threading.Thread(target=watch)
    reader.start()
    for v in values:
        shared.save_json(spark, path, v)
    stop.set()
    reader.join()
    assert all(v in values for v in seen) and shared.load_json(spark, path) == values[-1]
    assert os.listdir(tmp_path / "a") == ["state.json"]


def test_a_crash_leaves_the_old_file(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/state.json"
    shared.save_json(spark, path, {"n": 1})
    with pytest.raises((ValueError, TypeError)):
        shared.save_json(spark, path, {"n": float("nan")})

    def crash(*_):
        raise OSError("no space")

    monkeypatch.setattr(os, "replace", crash)
    with pytest.raises(OSError, match="no space"):
        shared.save_json(spark, path, {"n": 2})
    assert shared.load_json(spark, path) == {"n": 1} and os.listdir(tmp_path) == ["state.json"]
    (tmp_path / "state.json").write_text('{"n": ')
    with pytest.raises(json.JSONDecodeError):
        shared.load_json(spark, path)


def test_small_files_by_the_hadoop_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_local", lambda path: None)  # as for a store that isn't mounted
    path = f"file://{tmp_path}/deep/a.txt"
    assert shared.read_text(spark, path) is None
    assert shared.write_text(spark, path, "é1", replace=False) and not shared.write_text(spark, path, "2", replace=False)
    assert shared.read_text(spark, path) == "é1"
    assert shared.write_text(spark, path, "3") and shared.read_text(spark, path) == "3"


def test_reports(spark, tmp_path):
    found = spark.createDataFrame([("b", "warning", 2, False), ("a", "error", 0, True), ("c", "error", 1, False)], "code STRING, severity STRING, n BIGINT, ok BOOLEAN")
    path = f"file://{tmp_path}/r.json"
    report = reports.save_findings(found, path)
    assert (report["ok"], report["errors"], report["warnings"]) == (False, 1, 1) and [f["code"] for f in report["findings"]] == ["b", "c", "a"]
    assert sorted(map(tuple, reports.findings(spark, path).collect())) == sorted(map(tuple, found.collect()))
    assert reports.report_path(["--x", "--write"], "/r") == (["--x"], "/r/mapping-audit.json")
    assert reports.report_path(["--write", "--x"], "/r") == (["--x"], "/r/mapping-audit.json")
    assert reports.report_path(["--write", "o.json"], "/r") == ([], "/r/o.json") and reports.report_path(["--write=/o.json"], "/r") == ([], "/o.json")
    assert reports.report_path([], "/r") == ([], None)
    with pytest.raises(ValueError, match="path"):
        reports.report_path(["--write= "], "/r")
