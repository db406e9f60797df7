"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pandas as pd
import pytest

import __spark_entry__
from flowgraph.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["g3_delete_nodes", "g7_adjacency", "g10_random_digraph", "d3_d4_dfst", "d10_cycle_breakers", "m1_idom", "l4_loop_forest", "c4_remove_empty", "p5_max_matching", "f3_f6_live_vars", "e3_gcd_test", "x5_assign_effect", "v2_dot_clusters"]


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, tables, name):
    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple("null" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df.itertuples(index=False))

    ours = registry.QUERIES[name](spark, DATA).toPandas()
    theirs = tables.execute(registry.ORACLE_SQL[name]).fetch_df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_names_and_sql_belong_together():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"x7_points_to_any"}
