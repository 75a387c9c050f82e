"""Every query with SQL gives the rows of that SQL on DuckDB."""

import duckdb
import pytest

from tessera.plans import catalogue, collisions, jobs, loads, lookups, planners, repairs, smalls, streams  # noqa: F401  (the others add their queries to the catalogue)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(frame):
    def one(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    got, want = catalogue.queries()[name](spark, DATA).toPandas(), duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.where(got.notna(), None)) == plain(want.astype(object).where(want.notna(), None))
