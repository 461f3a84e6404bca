"""The registered queries keep their contract; result checks against SQL run in tools/compare.py."""

import duckdb
import glob
import os

import pytest

from ledgerlark.catalog import ORACLES, QUERIES

SAMPLE = [
    "payment_features_mixed_kinds", "settled_history_features", "ranking_metrics", "policy_frontier",
    "choose_f1_cutoff", "asof_last_k_neighbors_ties", "graph_degree", "sample_edges", "empirical_tail_score",
    "released_feedback", "replay_fixed_history", "chronological_split", "stage_masked_counts",
]


def test_every_text_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)
