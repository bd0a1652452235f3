"""Every query with SQL against that SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return f"{v + 0.0:.7g}"
    return "[" + ",".join(map(_norm, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(_norm, r)) for r in df.select(*cols).collect())
    out = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(_norm(r[i]) for i in at) for r in out.fetchall())


@pytest.mark.parametrize("name", ["ensemble_score", "ensemble_score_sql"])
def test_ensemble_equals_sql_at_a_half(spark, tmp_path, name):
    """Two events of sf0.1 whose trees add up to almost 0."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES (79132::BIGINT, TIMESTAMP '2024-01-24 17:44:43', 127::BIGINT), (58195, TIMESTAMP '2024-01-18 10:50:32', 1124)) v(event_id, ts, user_id)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select("path", "idx", "raw_score", "probability", "admitted").collect()))
    assert got == sorted(con.execute(entry.oracle_sql()[name]).fetchall()) == [(127, 0, 0.0, 0.5, True), (1124, 0, 0.0, 0.5, True)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_find_the_package():
    assert os.path.isdir(os.path.join(entry.HERE, "tessitura"))
