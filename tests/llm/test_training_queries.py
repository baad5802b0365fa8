"""Queries that SQL can express over whole tables, on the smallest of them; the others must run and keep their columns."""

import os

import pytest

from evalspan.llm import oracle, queries

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("EVALSPAN_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["row_id"], "p2_found": ["instance_id", "sample", "replicate", "first_step", "last_step"], "p3_found": ["candidate_id"],
    "p4_found": ["sha_a", "sha_b"], "p5_found": ["record_set", "id_a", "id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
}


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
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_query_runs(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    assert df.count() > 0 or name.endswith("_found")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, con, name):
    assert queries.queries()[name](spark, DATA).columns == COLUMNS[name]


def test_p7_registers_the_mix_first():
    assert [n for n in queries.queries() if n.startswith("p7_")][0] == "p7_mix"
