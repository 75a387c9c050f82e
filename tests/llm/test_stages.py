"""Pipeline stages on hard rows, and the queries with SQL against it."""

import os
import threading

import duckdb
import pytest

import corpus_pipeline
from tessera.llm import common, exact, mix, njoin, queries, urls

from .test_operators import hard_rows

DATA = "/root/testdata/sf0.001"
DOC = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
CLASHES = "_t _d _s _c _crc _0 _1 _2 size shard slot text_crc32 body set1 sig at quota taken y label score".split()


def test_all_stages_take_hard_rows_and_clashing_columns(spark):
    base = [(*r, *[f"{c}{r[0]}" for c in CLASHES]) for r in hard_rows()]
    docs = spark.createDataFrame(base, DOC + "".join(f", `{c}` STRING" for c in CLASHES))
    rows = set(base)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "sharding") == (out.columns != docs.columns)
        assert {tuple(r)[: len(docs.columns)] for r in out.collect()} <= rows, name
        assert stage(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name", ["url_rules"])
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = sorted(map(str, duck.execute(queries.oracle_sql()[name]).fetchall()))
    got = queries.queries()[name](spark, DATA).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_hard_urls(spark):
    long = "http://a.example.com/" + "x" * 100_000 + "?q=1"
    rows = [(1, None, 1), (1, "", 1), (2, long, 1), (2, long, 1), (3, "://", 1), (4, "http://A.NET/de/é", 1), (None, "http://x.org/es/", 1)]
    got = urls.op7_url_filter(spark.createDataFrame(rows, "page_id BIGINT, url STRING, host INT")).collect()
    assert len(got) == len(rows) and {r["verdict"] for r in got} <= {"allow", "block"}
    assert {(r["page_id"], r["rule"]) for r in got if r["rule"]} == {(4, "net/de/"), (None, "org/es/")}


def _runs(spark):
    return [n for n in os.listdir(common.stage_folder(spark).removeprefix("file://")) if n.startswith("run-")]


def test_runs_leave_other_results_alone(spark, monkeypatch):
    """Lazy results of other operators outlive a run, a run that fails, and two runs at once; runs leave no tables of their own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [exact.op9_exact_dedup(docs), njoin.op3_ngram_jaccard(docs), mix.op4_mix(docs)]
    want = [sorted(map(str, df.collect())) for df in held]
    some = {name: stage for name, stage in corpus_pipeline.STAGES if name in ("mixing", "sharding")}
    monkeypatch.setattr(corpus_pipeline, "STAGES", list(some.items()))
    first = sorted(map(str, corpus_pipeline.run(spark, DATA).collect()))

    def fails(spark, docs, sf_dir):
        common.staged(docs.limit(1), "half")
        raise RuntimeError("stop")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", some["mixing"]), ("failing", fails)])
    with pytest.raises(RuntimeError, match="stop"):
        corpus_pipeline.run(spark, DATA)
    monkeypatch.setattr(corpus_pipeline, "STAGES", list(some.items()))
    found = []
    threads = [threading.Thread(target=lambda: found.append(sorted(map(str, corpus_pipeline.run(spark, DATA).collect())))) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == [first, first] and not _runs(spark)
    assert [sorted(map(str, df.collect())) for df in held] == want
