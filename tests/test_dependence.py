"""Dependence between iterations against trying all of them, and classes of equal references."""

import itertools
import random

from flowgraph.operators import depend

REFS = "loop_id long, stmt_id long, ref_id long, kind string, array string, free long, coeffs map<string, long>"
BOUNDS = "loop_id long, ivar string, level int, lower long, upper long, step long"


def test_a_value_of_the_iteration_before(spark):
    rows = [(0, 0, 0, "w", "a", 0, {"i": 1}), (0, 0, 1, "r", "a", -1, {"i": 1}), (0, 1, 2, "r", "a", 2, {"i": 1}), (0, 2, 3, "r", "b", 0, {"i": 1}), (0, 3, 4, "r", "a", None, {"i": 1})]
    refs = spark.createDataFrame(rows, REFS)
    got = {r.ref_id_2: (r.possible, r.exact, r.distances["i"], r.direction) for r in depend.carried_test(depend.reference_pairs(refs)).collect()}
    assert got == {1: (True, True, 1, "<"), 2: (True, True, -2, ">"), 4: (True, False, None, "*")}
    bounds = spark.createDataFrame([(0, "i", 0, 5, 6, 1)], BOUNDS)
    got = {r.ref_id_2: r.possible for r in depend.carried_test(depend.reference_pairs(refs), bounds).collect()}
    assert got == {1: True, 2: False, 4: True}  # two iterations are no three
    found = {(r.from_class, r.to_class, r.type, r.direction, r.distance["i"], r.n) for r in depend.carried_dependences(refs, bounds).collect()}
    assert (0, 1, "true", "<", 1, 1) in found and not any(f[2] == "output" for f in found)


def test_against_all_iterations(spark):
    rng, refs, bounds, want = random.Random(3), [], [], {}
    for loop in range(300):
        names = ["i", "j"][: 1 + loop % 2]
        limits = {v: (low := rng.randrange(-3, 4), low + rng.randrange(-1, 7), rng.randrange(1, 3)) for v in names}
        bounds += [(loop, v, level, *limits[v]) for level, v in enumerate(names)]
        sides = [({v: rng.choice([0, 0, 1, 1, 2, 3, -1]) for v in names}, rng.randrange(-6, 7)) for _ in range(2)]
        if loop % 3 == 0:
            sides[1] = (sides[0][0], sides[1][1])
        refs += [(loop, n, n, "wr"[n], "a", free, coeffs) for n, (coeffs, free) in enumerate(sides)]
        points = list(itertools.product(*[range((limits[v][1] - limits[v][0]) // limits[v][2] + 1) for v in names]))
        value = lambda side, p: side[1] + sum(side[0][v] * (limits[v][0] + limits[v][2] * t) for v, t in zip(names, p))  # noqa: B023, E731
        want[loop] = [tuple(b - a for a, b in zip(p, q)) for p in points for q in points if value(sides[0], p) == value(sides[1], q)]
    found = depend.carried_test(depend.reference_pairs(spark.createDataFrame(refs, REFS)), spark.createDataFrame(bounds, BOUNDS)).collect()
    assert len(found) == 300
    for r in found:
        meets = want[r.loop_id]
        assert r.possible or not meets
        assert not r.exact or r.possible == bool(meets)
        for at, v in enumerate(["i", "j"][: 1 + r.loop_id % 2]):
            if r.possible and r.distances[v] is not None:
                assert {m[at] for m in meets} == {r.distances[v]}
                assert r.direction == "<=>"[(r.distances[v] <= 0) + (r.distances[v] < 0)]
    assert sum(r.exact for r in found) > 100 and sum(not r.possible for r in found) > 50


def test_classes_stand_for_their_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), i, i, rng.choice("wr"), rng.choice("ab"), rng.choice([None, 0, 1]), rng.choice([{"i": 1}, {"i": 2, "j": 1}, {"j": 1, "i": 2}, {"i": None}])) for i in range(60)]
    refs = spark.createDataFrame(rows, REFS)
    classes, members = depend.reference_classes(refs)
    own = {(r.loop_id, r.ref_id): r.class_id for r in members.collect()}
    assert len(own) == 60 and all(own[r.loop_id, r.class_id] == r.class_id for r in classes.collect())
    for first, second in ("wr", "ww", "rr"):
        apart = {}
        for r in depend.reference_pairs(refs, first, second).collect():
            a, b = own[r.loop_id, r.ref_id_1], own[r.loop_id, r.ref_id_2]
            key = (r.loop_id, min(a, b), max(a, b)) if first == second else (r.loop_id, a, b)
            apart[key] = apart.get(key, 0) + 1
        assert {(r.loop_id, r.class_id_1, r.class_id_2): r.n for r in depend.class_pairs(classes, first, second).collect()} == apart
