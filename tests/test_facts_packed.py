"""Packed facts against rows of facts; allocation sites, call blocks and large type trees."""

import random

import pytest
from pyspark.sql import functions as F

from flowgraph.operators import dataflow, pointsto
from tests.test_large import build, random_graphs

STMTS = "graph_id long, node_id long, stmt_id long, pos int, writes array<string>, reads array<string>"


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_packed_facts_equal_rows(spark, direction):
    rng = random.Random(6)
    g = build(spark, random_graphs(6, 30, 2))
    rows, n = [], 0
    for graph in range(30):
        for _ in range(200 if graph == 0 else 12):  # more than two words of one variable
            n += 1
            rows.append((graph, rng.randrange(3 if graph else 2), n, n, [rng.choice("ab")] if graph else ["a"], [rng.choice("abc")]))
    parts = dataflow.gen_kill(spark.createDataFrame(rows, STMTS))
    many = spark.createDataFrame(rows, STMTS).select("graph_id", "node_id", "stmt_id", F.col("writes")[0].alias("var"))
    for gen, kill in ((parts["defs"], parts["kill"]), (parts["uses"], parts["kill"]), (many, parts["kill"].where("node_id = 1"))):
        got = dataflow.solve_packed(g, gen, kill, direction)
        want = dataflow.solve(g, gen, kill, direction)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert dataflow.solve_packed(g, parts["defs"].where("false"), parts["kill"], direction).isEmpty()


def test_a_type_tree_larger_than_the_stride(spark):
    rows = [(owner, 0, "static", path, "simple") for owner in (1, 2) for path in [[], *([i] for i in range(3 * owner))]]
    types = spark.createDataFrame(rows, "owner long, region_id long, alloc string, path array<int>, kind string")
    found = pointsto.allocate_blocks(types, stride=4).collect()
    assert len({r.block_id for r in found}) == len(rows) == 11
    roots = {r.block_id for r in found if r.parent_block is None}
    assert len(roots) == 2 and sorted(r.pos for r in found if r.parent_block == max(roots)) == list(range(6))


def test_allocations_and_calls_make_blocks(spark):
    blocks = spark.createDataFrame([(1, 5, 7, "simple", "static", None, None), (2, 6, 7, "simple", "static", None, None)], "graph_id long, block_id long, region_id long, kind string, alloc string, parent_block long, pos int")
    exprs = spark.createDataFrame([(0, 0, "new", None, None, None, 7, None), (1, 0, "block", None, None, 5, None, None), (2, 1, "oneof", 0, 1, None, None, None), (3, 0, "new", None, None, None, 8, None)], "expr_id long, level int, op string, arg1 long, arg2 long, block_id long, region_id long, field int")
    told, grown = pointsto.allocation_sites(exprs, spark.createDataFrame([(1, 2), (2, 3), (2, 0)], "graph_id long, expr_id long"), blocks)
    made = {(r.graph_id, r.block_id, r.region_id, r.alloc) for r in grown.collect()}
    assert made == {(1, 5, 7, "static"), (2, 6, 7, "static"), (1, 7, 7, "dynamic"), (2, 7, 7, "dynamic"), (2, 10, 8, "dynamic")}
    inside = spark.createDataFrame([(7, 7), (8, 8)], "super long, sub long")
    asked = spark.createDataFrame([(1, 0, 2)], "graph_id long, point long, expr_id long")
    state = spark.createDataFrame([], "graph_id long, point long, block_id long, value long")
    assert {r.value for r in pointsto.eval_expr(asked, told, state, grown, inside).collect()} == {5, 7}
    stmts = spark.createDataFrame([(1, "black", [7, 8]), (1, "black", [8]), (2, "assign", [7]), (2, "black", None)], "graph_id long, kind string, regions array<long>")
    called = {(r.graph_id, r.block_id, r.region_id, r.kind) for r in pointsto.call_blocks(stmts, blocks).collect()}
    assert called == {(1, 5, 7, "simple"), (2, 6, 7, "simple"), (1, 14, 7, "pseudo"), (1, 15, 8, "pseudo")}
