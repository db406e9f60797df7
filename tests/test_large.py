"""Forms for one large graph: components, dominators and matchings by joins alone, against slow definitions."""

import random

import pytest

from flowgraph.model import Graph
from flowgraph.operators import auction, cover, dfs, fixpoint, regions


def build(spark, graphs):
    """Graphs of (number of nodes, edges) by id; all start at node 0."""
    nodes = [(g, i, "") for g, (n, _) in graphs.items() for i in range(n)]
    edges = [(g, i, a, b, "") for g, (_, rows) in graphs.items() for i, (a, b) in enumerate(rows)]
    return Graph(
        spark.createDataFrame(nodes, "graph_id long, node_id long, info string"),
        spark.createDataFrame(edges, "graph_id long, edge_id long, src long, dst long, info string"),
        spark.createDataFrame([(g, 0) for g in graphs], "graph_id long, start long"),
    )


def reach(out, start, avoid=None):
    seen, todo = {start} - {avoid}, [start] if start != avoid else []
    while todo:
        for b in out.get(todo.pop(), ()):
            if b not in seen and b != avoid:
                seen.add(b)
                todo.append(b)
    return seen


def adjacency(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    return out


def components(n, edges):
    out, back, found = adjacency(edges), adjacency([(b, a) for a, b in edges]), {}
    for v in range(n):
        if v not in found:
            found |= dict.fromkeys(reach(out, v) & reach(back, v), v)
    return found


def dominator_tree(edges):
    out = adjacency(edges)
    every = reach(out, 0)
    above = {v: [d for d in every if v not in reach(out, 0, d)] for v in every}
    return {v: max((d for d in above[v] if d != v), key=lambda d: len(above[d]), default=None) for v in every}


@pytest.fixture
def tables(monkeypatch):
    """Counts the tables that are written."""
    count, cut = [0], fixpoint.cut

    def counted(df):
        count[0] += 1
        return cut(df)

    for module in (fixpoint, regions, dfs):
        monkeypatch.setattr(module, "cut", counted)
    return count


def random_graphs(seed, number, most):
    rng = random.Random(seed)
    graphs = {}
    for g in range(number):
        n = rng.randrange(2, 25)
        graphs[g] = (n, [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, int(most * n)))])
    return graphs


def test_components_of_random_graphs(spark):
    graphs = random_graphs(1, 120, 1.6)
    got = {(r.graph_id, r.node_id): r.component for r in regions.scc_by_joins(build(spark, graphs)).collect()}
    assert got == {(g, v): c for g, (n, edges) in graphs.items() for v, c in components(n, edges).items()}


def test_components_take_rounds_of_the_logarithm_of_a_chain(spark, tables):
    rng, made = random.Random(2), []
    for n in (60, 480):
        at = list(range(n + 100))
        rng.shuffle(at)
        circle = [(at[i], at[(i + 1) % n]) for i in range(n)]
        tail = [(at[i], at[i + 1]) for i in range(n, n + 99)] + [(at[5], at[n])]
        edges = circle + tail + [(at[n // 2], at[3])]
        tables[0] = 0
        got = {r.node_id: r.component for r in regions.scc_by_joins(build(spark, {0: (n + 100, edges)})).collect()}
        made.append(tables[0])
        assert got == components(n + 100, edges)
    assert made[1] <= made[0] + 8  # eight times the length


def test_dominators_of_random_graphs(spark):
    graphs = random_graphs(3, 120, 2)
    graphs[1000] = (40, [(i, i + 1) for i in range(39)] + [(i, i + 2) for i in range(38)] + [(39, 7), (30, 20)])
    got = {(r.graph_id, r.node_id): r.idom for r in dfs.idom_by_joins(build(spark, graphs)).collect()}
    assert got == {(g, v): d for g, (_, edges) in graphs.items() for v, d in dominator_tree(edges).items()}


def test_dominators_of_a_long_path(spark, tables):
    n = 20_000
    edges = [(i, i + 1) for i in range(n - 1)] + [(n - 1, 5), (n - 1, 0)]
    found = dfs.idom_by_joins(build(spark, {0: (n, edges)}))
    assert found.where("idom = node_id - 1").count() == n - 1 and found.where("idom is null").count() == 1
    assert tables[0] < 100


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "graph_id long, l long, r long, weight long")


def random_pairs(seed):
    rng, rows, totals = random.Random(seed), [], {}
    for g, (lefts, rights, m, most) in enumerate([(6, 6, 14, 9), (25, 25, 80, 12), (60, 8, 200, 30), (8, 60, 200, 30), (30, 30, 60, 1)]):
        own = {(rng.randrange(lefts), rng.randrange(rights)): rng.randrange(-1, most) + (most == 1) for _ in range(m)}
        totals[g] = sum(own[p] for p in cover.best_matching(own))
        rows += [(g, a, b, w) for (a, b), w in own.items()]
    return rows, totals


def test_bids_reach_the_greatest_total(spark):
    rows, totals = random_pairs(4)
    got = auction.auction_matching(pairs_of(spark, rows + rows[:5])).collect()
    weights = {(g, a, b): w for g, a, b, w in rows}
    assert all(weights[r.graph_id, r.l, r.r] == r.weight for r in got)
    for end in ("l", "r"):
        assert len({(r.graph_id, r[end]) for r in got}) == len(got)
    assert {g: sum(r.weight for r in got if r.graph_id == g) for g in totals} == totals


def test_bids_within_epsilon_and_large_groups(spark):
    rows, totals = random_pairs(5)
    got = auction.auction_matching(pairs_of(spark, rows), epsilon=0.5).collect()
    for g, total in totals.items():
        own = [r.weight for r in got if r.graph_id == g]
        assert total - 0.5 * min(len({r[1] for r in rows if r[0] == g}), len({r[2] for r in rows if r[0] == g})) <= sum(own) <= total
    mixed = cover.max_matching(pairs_of(spark, rows), max_pairs=150).groupBy("graph_id").sum("weight").collect()  # both ways
    assert {r[0]: r[1] for r in mixed} == totals
    assert auction.auction_matching(pairs_of(spark, [(1, 1, 1, 0), (1, 2, 1, -4)])).isEmpty() and auction.auction_matching(pairs_of(spark, [])).isEmpty()
