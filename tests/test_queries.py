"""Every registered query of the panel modules runs, and those with SQL give the same rows as DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from panelkit.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.4f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    df = q.queries()[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    assert found
    sql = q.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(columns, want.fetchall())
