"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from evalspan.plans import oracle, queries

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("EVALSPAN_TESTDATA", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    cur = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in cur.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    assert have == want


def test_all_queries_have_sql_or_are_named():
    without = set(queries.queries()) - set(oracle.oracle_sql())
    assert without == {"m7_ridge"}  # tested against a direct solution in test_operators


def test_no_query_needs_the_training_data_package():
    assert not [n for n in queries.queries() if n[0] == "p" and n[1].isdigit()]
