"""Corpus queries next to their DuckDB texts; every method named has its query."""

import glob
import os

import duckdb
import pytest

from ledgerlark.llm.queries import ORACLES, QUERIES


def test_one_query_for_each_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    df = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr) and got
