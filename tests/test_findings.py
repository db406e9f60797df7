"""Queries against their SQL on small tables made for one case each."""

import pytest

from flowgraph.plans import registry

duckdb = pytest.importorskip("duckdb")


def _same(spark, folder, name, **tables):
    """A query's rows equal those of its SQL over tables given as SELECTs."""
    con = duckdb.connect()
    for table, text in tables.items():
        con.execute(f"copy ({text}) to '{folder}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    ours = registry.QUERIES[name](spark, str(folder))
    theirs = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    rows = sorted(map(repr, theirs.fetchall()))
    assert sorted(repr(tuple(r)) for r in ours.select(columns).collect()) == rows
    return rows


def _events(*walks):
    """Users' events of one day, a minute apart; a step is (kind, number, value) or a number of clicks' node."""
    rows, at = [], 0
    for user, walk in enumerate(walks):
        for step in walk:
            kind, k, value = step if isinstance(step, tuple) else ("click", step, step)
            rows.append(f"({at}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {at} MINUTE, {user}, '{kind}', {value}.5, '{{\"k\": {k}}}')")
            at += 1
    return f"SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {', '.join(rows)}) t(event_id, ts, user_id, event_type, value, props)"


def test_orders_of_a_region_that_an_outer_one_tears_apart(spark, tmp_path):
    assert len(_same(spark, tmp_path, "h1_h2_orders", events=_events([3, 1, 2, 2, 1, 2, 3, 2, 0], [0, 1, 2]))) == 7


def _tables_written(monkeypatch):
    """A list that grows by an entry for each table written in the shared folder."""
    from flowgraph.operators import fixpoint

    made, plain = [], fixpoint._new_path
    monkeypatch.setattr(fixpoint, "_new_path", lambda spark: made.append(1) or plain(spark))
    return made


KINDS = ["click", "view", "purchase", "signup", "error"]


@pytest.mark.parametrize("name", ["x7_points_to", "x8_may_alias", "x9_must_alias", "x10_undefined", "x11_asserts"])
def test_points_to_of_long_days_takes_no_round_a_statement(spark, tmp_path, monkeypatch, name):
    made = _tables_written(monkeypatch)
    walks = [[(KINDS[(i * i + u) % 5], i * 7 % 11, (i * (u + 1)) % 6) for i in range(60)] for u in range(3)]
    customers = "SELECT k::BIGINT AS c_custkey, (k % 3)::INTEGER AS c_nationkey FROM range(6) r(k)"
    assert _same(spark, tmp_path, name, events=_events(*walks), customer=customers)
    assert len(made) <= 6


def test_points_to_of_large_graphs_by_joins_equals_packed(spark, tmp_path, monkeypatch):
    from flowgraph.operators import pointsto
    from flowgraph.plans import flows

    walks = [[(KINDS[(i * i + u) % 5], i * 7 % 11, (i * (u + 1)) % 6) for i in range(9 + u)] for u in range(4)]
    for table, text in {"events": _events(*walks), "customer": "SELECT k::BIGINT AS c_custkey, 1::INTEGER AS c_nationkey FROM range(6) r(k)"}.items():
        duckdb.connect().execute(f"copy ({text}) to '{tmp_path}/{table}.parquet'")
    plain, found = pointsto.points_to_states, []
    for most in (0, 21, 100):  # none, some and all graphs are packed
        monkeypatch.setattr(pointsto, "points_to_states", lambda *a, most=most: plain(*a, most=most))
        rows = flows._direct(spark, str(tmp_path), flows._customers(spark, str(tmp_path)))
        found.append(sorted((r.graph_id, r.point, sorted(r.held.items()), r.static) for r in rows.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 40


def test_points_to_of_any_statements_takes_no_round_a_statement(spark, tmp_path, monkeypatch):
    from flowgraph.operators import pointsto

    walks = [[(KINDS[(i * i + u) % 5], i * 7 % 11, (i * (u + 1)) % 6) for i in range(4 - u)] for u in range(2)]
    duckdb.connect().execute(f"copy ({_events(*walks)}) to '{tmp_path}/events.parquet'")
    made, plain = _tables_written(monkeypatch), pointsto.points_to
    packed = registry.QUERIES["x7_points_to_any"](spark, str(tmp_path)).collect()
    assert len(made) <= 10
    monkeypatch.setattr(pointsto, "points_to", lambda *a: plain(*a, most=0))
    joined = registry.QUERIES["x7_points_to_any"](spark, str(tmp_path)).collect()
    assert sorted(packed) == sorted(joined) and len(packed) > 80


def test_calls_that_lead_along_many_blocks_double_their_steps(spark, tmp_path, monkeypatch):
    from flowgraph.operators import pointsto

    made, plain = _tables_written(monkeypatch), pointsto.black_effect
    monkeypatch.setattr(pointsto, "black_effect", lambda *a: plain(*a, most=300))
    customers = "SELECT k::BIGINT AS c_custkey, (CASE WHEN k < 300 THEN 0 ELSE k % 3 END)::INTEGER AS c_nationkey FROM range(310) r(k)"
    assert len(_same(spark, tmp_path, "x6_black_effect", customer=customers)) > 150 * 150
    assert len(made) < 50


def test_calls_lead_where_plain_search_does(spark):
    import random

    from flowgraph.operators import pointsto

    rng = random.Random(5)
    held = {(p, b, v) for p in range(3) for b in range(60) for v in [rng.choice([b + 1, b - 1, b + 1, -1])] + [rng.randrange(60)] * (rng.random() < 0.15)} | {(3, b, b % 40 + 1) for b in range(1, 41)}
    parts = {(b, b + 60) for b in range(0, 60, 13)} | {(60, 70), (73, 3)}
    seeds = {(0, 7), (1, 30), (1, 2), (2, 0), (3, 5)}
    state = spark.createDataFrame([(0, *h) for h in held], "graph_id long, point long, block_id long, value long")
    blocks = spark.createDataFrame([(0, b, a) for a, b in parts], "graph_id long, block_id long, parent_block long")
    given = spark.createDataFrame([(0, *s) for s in seeds], "graph_id long, point long, value long")
    want = set()
    for p in range(4):
        reach, todo = set(), [v for q, v in seeds if q == p]
        while todo:
            v = todo.pop()
            if v not in reach:
                reach.add(v)
                todo += [n for q, b, n in held if q == p and b == v] + [n for b, n in parts if b == v]
        want |= {(0, *h) for h in held if h[0] == p} | {(0, p, b, v) for b in reach if b >= 0 for v in reach}
    for most in (0, 4_096):  # by joins, and packed
        rows = [tuple(r) for r in pointsto.black_effect(state, given, blocks, most).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


LINES = "SELECT o::BIGINT AS l_orderkey, (n + 1)::INTEGER AS l_linenumber FROM range(30) t(o), range(7) u(n) WHERE n <= o % 7"


@pytest.mark.parametrize("name, most", [("x4_eval_ops", 9), ("x6_black_parts", 9), ("e5_nest_points", 5), ("x2_allocate_blocks", 0)])
def test_orders_write_few_tables(spark, tmp_path, monkeypatch, name, most):
    made = _tables_written(monkeypatch)
    _same(spark, tmp_path, name, lineitem=LINES)
    assert len(made) <= most


def test_blocks_of_deep_and_broken_type_trees(spark):
    from flowgraph.operators import pointsto

    paths = [[], [0], [0, 0], [0, 1], [0, 1, 4], [1], [2, 0], [2, 0, 1], [3], *([9] * n for n in range(1, 20))]
    for paths in (paths[:9], paths):  # by windows, and by joins
        types = spark.createDataFrame([(7, 0, "static", p, "simple") for p in paths], "owner long, region_id long, alloc string, path array<int>, kind string")
        place = {tuple(p): 7_000_000 + i for i, p in enumerate(sorted(paths))}
        want = {place[p]: place.get(p[:-1]) if p else None for p in place}
        assert {r.block_id: r.parent_block for r in pointsto.allocate_blocks(types).collect()} == want


def test_expressions_packed_equal_those_by_joins(spark, tmp_path, monkeypatch):
    from flowgraph.operators import pointsto

    plain = pointsto.eval_expr
    monkeypatch.setattr(pointsto, "eval_expr", lambda *a: plain(*a, most=20))  # orders of few lines are packed
    _same(spark, tmp_path, "x4_eval_ops", lineitem=LINES)
