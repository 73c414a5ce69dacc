"""Every query with SQL against DuckDB on the smallest data; the others run and give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

#: Queries that find nothing in the smallest data.
EMPTY = {"residual_merge_edges"}
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = {n: q for m in entry._MODULES if ".llm." not in m.__name__ for n, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def cell(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v)


def rows(frame, cols):
    frame = frame[cols].astype(object)
    return sorted((tuple(cell(v) for v in r) for r in frame.where(frame.notna(), None).itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0 or name in EMPTY
        return
    want = duck.execute(sql).fetchdf()
    assert sorted(want.columns) == cols
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    compare(spark, duck, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
