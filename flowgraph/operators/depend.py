"""Data dependence between references of loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.operators.fixpoint import closure, cut
from flowgraph.operators.regions import forest_tree


def flatten_loops(loops: DataFrame) -> DataFrame:
    """(loop_id, root, level, depth): the outermost loop around each loop, its level below it, and the nest's highest level."""
    seed = loops.where("parent_loop is null").select("loop_id", F.col("loop_id").alias("root"), F.lit(0).alias("level"))
    down = cut(loops.where("parent_loop is not null").select(F.col("parent_loop").alias("loop_id"), F.col("loop_id").alias("__low")))
    flat = closure(seed, lambda new: new.join(down, "loop_id").select(F.col("__low").alias("loop_id"), "root", (F.col("level") + 1).alias("level")))
    return flat.join(flat.groupBy("root").agg(F.max("level").alias("depth")), "root").select("loop_id", "root", "level", "depth")


def reference_pairs(refs: DataFrame, first: str = "w", second: str = "r") -> DataFrame:
    """Pairs of references of one loop to one array, of the given kinds; of two of one kind the smaller ref_id comes first.

    Columns: loop_id, array, and those of either reference with the ending _1 or _2.
    """
    own = [c for c in refs.columns if c not in ("loop_id", "array")]
    a, b = (refs.where(F.col("kind") == kind).select("loop_id", "array", *[F.col(c).alias(f"{c}_{n}") for c in own]) for n, kind in ((1, first), (2, second)))
    pairs = a.join(b, ["loop_id", "array"])
    return pairs.where("ref_id_1 < ref_id_2") if first == second else pairs


def reference_classes(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References that are alike but for their statement, as one row: classes and members.

    classes: (loop_id, array, kind, coeffs, free, class_id, n): the least ref_id of n references of one loop, array and kind
    with equal coefficients and free part. members: (loop_id, ref_id, class_id). Pairs of classes stand for n_1 * n_2
    pairs of references, so an array that is referred to over and over in one way makes few rows.
    """
    own = ["loop_id", "array", "kind", "free", "__coeffs"]
    rows = refs.withColumn("__coeffs", F.array_sort(F.map_entries("coeffs")))
    classes = cut(rows.groupBy(*own).agg(F.min("ref_id").alias("class_id"), F.count("*").alias("n")))
    same = F.lit(True)
    for c in own:
        same = same & rows[c].eqNullSafe(classes[c])
    members = rows.join(classes, same).select(rows["loop_id"], "ref_id", "class_id")
    return classes.select("loop_id", "array", "kind", F.map_from_entries("__coeffs").alias("coeffs"), "free", "class_id", "n"), members


def class_pairs(classes: DataFrame, first: str = "w", second: str = "r") -> DataFrame:
    """Pairs of classes of one loop and array, of the given kinds, and n, the pairs of references they stand for.

    Of one kind, a class also meets itself if it has two references or more; of two, the smaller class_id comes first.
    """
    own = ["kind", "coeffs", "free", "class_id", "n"]
    a, b = (classes.where(F.col("kind") == kind).select("loop_id", "array", *[F.col(c).alias(f"{c}_{i}") for c in own]) for i, kind in ((1, first), (2, second)))
    pairs = a.join(b, ["loop_id", "array"])
    if first == second:
        pairs = pairs.where("class_id_1 < class_id_2 or (class_id_1 = class_id_2 and n_1 > 1)")
    n = F.when(F.lit(first == second) & (F.col("class_id_1") == F.col("class_id_2")), (F.col("n_1") * (F.col("n_1") - 1) / 2).cast("long")).otherwise(F.col("n_1") * F.col("n_2"))
    return pairs.withColumn("n", n).drop("n_1", "n_2")


def carried_test(pairs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """pairs with possible, exact, distances and direction: whether two references, each in an iteration of its own, meet.

    pairs: loop_id, coeffs_1, coeffs_2 (maps from variables to longs), free_1, free_2. bounds: (loop_id, ivar, level, lower,
    upper, step) of the variables around the references, the outermost of level 0; without it variables are unbounded and
    step by one. Iterations are counted from 0 at the lower bound.

    The first reference in iteration t and the second in iteration u meet where coeffs_1 * t + free_1 = coeffs_2 * u + free_2.
    Needed: the divisor of all coefficients divides the difference of the free parts, and, where bounds are known, the
    difference lies between the least and the greatest value of the left side less the right one. Where only one
    variable counts and has the same coefficient on both sides, u - t is its distance, a map of the variables' distances
    has it (null for the others), and the answer is exact. direction: < for a positive distance (the first reference's
    iteration comes first), = for none, > for a negative one, * where it is not known. An unknown coefficient or free
    part: possible, not exact.
    """
    long, zero = lambda x: x.cast("long"), F.lit(0).cast("long")
    if bounds is None:
        pairs = pairs.withColumn("__bounds", F.lit(None).cast("map<string,struct<level:int,lower:bigint,upper:bigint,step:bigint>>"))
    else:
        told = F.struct(F.col("level").cast("int").alias("level"), long(F.col("lower")).alias("lower"), long(F.col("upper")).alias("upper"), long(F.col("step")).alias("step"))
        pairs = pairs.join(bounds.groupBy("loop_id").agg(F.map_from_entries(F.collect_list(F.struct("ivar", told))).alias("__bounds")), "loop_id", "left")

    def variable(e: Column) -> Column:
        at = F.col("__bounds")[e["key"]]
        step, lower = F.coalesce(at["step"], F.lit(1).cast("long")), F.coalesce(at["lower"], zero)
        a, b = F.coalesce(e["value"]["a"], zero), F.coalesce(e["value"]["b"], zero)
        most = F.when((at["upper"] - at["lower"]) * at["step"] < 0, -1).otherwise(F.call_function("div", at["upper"] - at["lower"], at["step"]))  # -1: no iteration
        return F.struct(F.coalesce(at["level"], F.lit(0)).alias("level"), e["key"].alias("ivar"), (a * step).alias("a"), (b * step).alias("b"), ((b - a) * lower).alias("shift"), most.alias("most"))

    merged = F.map_zip_with("coeffs_1", "coeffs_2", lambda _, a, b: F.struct(a.alias("a"), b.alias("b")))
    known = ~F.exists(F.map_values("coeffs_1"), F.isnull) & ~F.exists(F.map_values("coeffs_2"), F.isnull) & F.col("free_1").isNotNull() & F.col("free_2").isNotNull()
    pairs = pairs.withColumns({"__known": known, "__vars": F.array_sort(F.transform(F.map_entries(merged), variable))})
    pairs = pairs.withColumn("__need", F.col("free_2") - F.col("free_1") + F.aggregate("__vars", zero, lambda s, v: s + v["shift"]))
    pairs = pairs.withColumn("__divisor", greatest_common_divisor(F.flatten(F.transform("__vars", lambda v: F.array(v["a"], v["b"])))))
    pairs = pairs.withColumn("__used", F.filter("__vars", lambda v: (v["a"] != 0) | (v["b"] != 0)))
    need, divisor, used = F.col("__need"), F.col("__divisor"), F.col("__used")
    fits = F.when(divisor == 0, need == 0).otherwise(need % F.when(divisor == 0, 1).otherwise(divisor) == 0)
    side = lambda v, f, g: f(zero, v["a"] * v["most"]) - g(zero, v["b"] * v["most"])
    bounded = ~F.exists("__vars", lambda v: v["most"].isNull())
    low = F.aggregate("__vars", zero, lambda s, v: s + side(v, F.least, F.greatest))
    high = F.aggregate("__vars", zero, lambda s, v: s + side(v, F.greatest, F.least))
    inside = F.when(bounded, (need >= low) & (need <= high)).otherwise(True) & ~F.exists("__vars", lambda v: F.coalesce(v["most"] < 0, F.lit(False)))
    only = F.get(used, F.lit(0))
    single = F.coalesce((F.size(used) == 1) & (only["a"] == only["b"]), F.lit(False))
    pairs = pairs.withColumn("possible", F.when(F.col("__known"), fits & inside).otherwise(True))
    distance = F.when(F.col("__known") & F.col("possible") & single, F.call_function("div", -need, F.when(single, F.get(used, F.lit(0))["a"]).otherwise(1)))
    pairs = pairs.withColumn("__distance", distance)
    names = F.transform("__vars", lambda v: v["ivar"])
    values = F.transform("__vars", lambda v: F.when(v["ivar"] == F.get(used, F.lit(0))["ivar"], F.col("__distance")))
    sign = F.when(F.col("__distance") > 0, "<").when(F.col("__distance") == 0, "=").when(F.col("__distance") < 0, ">").otherwise("*")
    exact = F.col("__known") & (~F.col("possible") | single | (F.size(used) == 0))
    pairs = pairs.withColumns({"exact": exact, "distances": F.map_from_arrays(names, values), "direction": F.when(F.col("possible"), sign)})
    return pairs.drop("__bounds", "__known", "__vars", "__need", "__divisor", "__used", "__distance")


def carried_dependences(refs: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """(loop_id, from_class, to_class, type, direction, distance, n): dependences between classes of references over all iterations.

    They go from the reference of the earlier iteration to that of the later one, which distance (a map, as in
    carried_test, but not negative) counts; where the direction is = or *, from the first reference of the pair. n pairs
    of references.
    """
    classes, _ = reference_classes(refs)
    found = None
    for first, second in (("w", "r"), ("w", "w"), ("r", "r")):
        pairs = carried_test(class_pairs(classes, first, second), bounds).where("possible")
        back = F.col("direction") == ">"
        pairs = pairs.withColumn("turned", F.when(back, F.transform_values("distances", lambda _, d: -d)).otherwise(F.col("distances")))
        rows = pairs.select(
            "loop_id", F.when(back, F.col("class_id_2")).otherwise(F.col("class_id_1")).alias("from_class"), F.when(back, F.col("class_id_1")).otherwise(F.col("class_id_2")).alias("to_class"),
            F.when(back, dependence_type(F.lit(second), F.lit(first))).otherwise(dependence_type(F.lit(first), F.lit(second))).alias("type"), F.when(back, "<").otherwise(F.col("direction")).alias("direction"), F.col("turned").alias("distance"), "n",
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def greatest_common_divisor(values: Column) -> Column:
    """Of an array of longs; 0 if all are 0. As many of Euclid's steps as the smaller value may need."""
    def pair(a: Column, b: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            return F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
        zero = F.lit(0).cast("long")
        most = F.ceil(F.log10(F.least(a, b)) * 4.8 + 2).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.when((a == zero) | (b == zero), 1).otherwise(most)), F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")), step, lambda s: s["a"])
    return F.aggregate(values, F.lit(0).cast("long"), lambda x, v: pair(x, F.abs(v)))


def gcd_test(pairs: DataFrame) -> DataFrame:
    """pairs with possible, exact and distance, for two references in the same iteration (for different ones see carried_test), from coeffs_1, coeffs_2 (maps from variables to longs) and free_1, free_2.

    A dependence needs the divisor of the coefficients' differences to divide the difference of the free parts. All
    differences 0: the free parts must be equal. An unknown coefficient or free part: possible, not exact. distance
    is told where one variable has the same coefficient other than 0 on both sides and no other has one.
    """
    merged = F.map_zip_with("coeffs_1", "coeffs_2", lambda _, a, b: F.struct(a.alias("a"), b.alias("b")))
    known = ~F.exists(F.map_values("coeffs_1"), F.isnull) & ~F.exists(F.map_values("coeffs_2"), F.isnull) & F.col("free_1").isNotNull() & F.col("free_2").isNotNull()
    zero = F.lit(0).cast("long")
    both = F.transform(F.map_values(merged), lambda x: F.struct(F.coalesce(x["a"], zero).alias("a"), F.coalesce(x["b"], zero).alias("b")))
    divisor = greatest_common_divisor(F.transform(both, lambda x: x["a"] - x["b"]))
    free = F.col("free_2") - F.col("free_1")
    fits = F.when(divisor == 0, free == 0).otherwise(free % F.when(divisor == 0, 1).otherwise(divisor) == 0)
    used = F.filter(both, lambda x: (x["a"] != 0) | (x["b"] != 0))
    single = (F.size(used) == 1) & (F.get(used, F.lit(0))["a"] == F.get(used, F.lit(0))["b"]) & (free % F.when(F.get(used, F.lit(0))["a"] == 0, 1).otherwise(F.get(used, F.lit(0))["a"]) == 0)
    return pairs.withColumns({
        "possible": F.when(known, fits).otherwise(True),
        "exact": known,
        "distance": F.when(known & fits & single, (-free / F.get(used, F.lit(0))["a"]).cast("long")),
    })


def dependence_type(kind_1: Column, kind_2: Column) -> Column:
    """True (write, then read), anti (read, then write), output (two writes) or input (two reads)."""
    return F.when(kind_1 == "w", F.when(kind_2 == "r", "true").otherwise("output")).otherwise(F.when(kind_2 == "w", "anti").otherwise("input"))


def dependence_graph(refs: DataFrame) -> DataFrame:
    """(loop_id, from_stmt, to_stmt, type, n): dependences between statements within an iteration, from the earlier one; n pairs of references.

    Dependences between iterations are in carried_dependences.

    In one statement reads come before writes.
    """
    found = None
    for first, second in (("w", "r"), ("w", "w"), ("r", "r")):
        pairs = gcd_test(reference_pairs(refs, first, second)).where("possible")
        ahead = (F.col("stmt_id_1") < F.col("stmt_id_2")) | ((F.col("stmt_id_1") == F.col("stmt_id_2")) & (F.lit(first) == F.lit(second)))
        kinds = F.when(ahead, dependence_type(F.lit(first), F.lit(second))).otherwise(dependence_type(F.lit(second), F.lit(first)))
        rows = pairs.select("loop_id", F.when(ahead, F.col("stmt_id_1")).otherwise(F.col("stmt_id_2")).alias("from_stmt"), F.when(ahead, F.col("stmt_id_2")).otherwise(F.col("stmt_id_1")).alias("to_stmt"), kinds.alias("type"))
        found = rows if found is None else found.union(rows)
    return found.groupBy("loop_id", "from_stmt", "to_stmt", "type").agg(F.count("*").alias("n"))


def iteration_points(loops: DataFrame) -> DataFrame:
    """(loop_id, point): the values of a loop's variable from lower to upper, both included, by step."""
    steps = F.when(F.col("step") > 0, F.col("lower") <= F.col("upper")).when(F.col("step") < 0, F.col("lower") >= F.col("upper")).otherwise(False)
    return loops.where(steps).select("loop_id", F.explode(F.sequence("lower", "upper", "step")).alias("point"))


def next_point(points: DataFrame, loops: DataFrame) -> DataFrame:
    """points with next, the value one step on, null behind the bound."""
    ahead = F.col("point") + F.col("step")
    inside = F.when(F.col("step") > 0, ahead <= F.col("upper")).otherwise(ahead >= F.col("upper"))
    return points.join(loops.select("loop_id", "upper", "step"), "loop_id").select("loop_id", "point", F.when(inside, ahead).alias("next"))


def nest_ranges(loops: DataFrame) -> DataFrame:
    """(loop_id, depth, ranges): lower, upper and step of all loops around each loop and its own, the outermost first.

    loops: loop_id, parent_loop (null for the outermost), lower, upper, step. A round for each level of the deepest nest,
    over loops and not over points.
    """
    loops = cut(loops.select("loop_id", "parent_loop", F.struct("lower", "upper", "step").alias("__own")))
    inner = loops.where("parent_loop is not null").select("loop_id", F.col("parent_loop").alias("__outer"), "__own")
    now, depth = cut(loops.where("parent_loop is null").select("loop_id", F.array("__own").alias("ranges"))), 1
    found = now.withColumn("depth", F.lit(depth))
    while True:
        now, depth = cut(now.withColumnRenamed("loop_id", "__outer").join(inner, "__outer").select("loop_id", F.concat("ranges", F.array("__own")).alias("ranges"))), depth + 1
        if now.isEmpty():
            return found.select("loop_id", "depth", "ranges")
        found = found.union(now.withColumn("depth", F.lit(depth)))


def range_points(ranges: DataFrame) -> DataFrame:
    """The rows of nest_ranges with point, once for each point of the loop: made in place, without a join of points."""
    found = None
    for depth in [r[0] for r in ranges.select("depth").distinct().orderBy("depth").collect()]:  # the levels of the deepest nest
        rows = ranges.where(F.col("depth") == depth).withColumn("point", F.array().cast("array<bigint>"))
        for level in range(depth):
            at = F.get("ranges", F.lit(level))
            lower, upper, step = (at[c].cast("long") for c in ("lower", "upper", "step"))
            some = F.when(step > 0, lower <= upper).when(step < 0, lower >= upper).otherwise(False)
            values = F.sequence(lower, F.when(some, upper).otherwise(lower), F.when(some, step).otherwise(F.lit(1).cast("long")))
            rows = rows.where(some).withColumn("__value", F.explode(values)).withColumn("point", F.concat("point", F.array("__value"))).drop("__value")
        found = rows if found is None else found.union(rows)
    return ranges.withColumn("point", F.array().cast("array<bigint>")).where("false") if found is None else found


def range_next(level: int) -> Column:
    """Of the rows of range_points: the point one step on along the variable at `level`, as nest_next_point has it."""
    at = F.get("ranges", F.lit(level))
    ahead = F.get("point", F.lit(level)) + at["step"]
    inside = F.when(at["step"] > 0, ahead <= at["upper"]).otherwise(ahead >= at["upper"])
    return F.when(inside, F.transform("point", lambda x, i: F.when(i == level, ahead).otherwise(x)))


def nest_points(loops: DataFrame) -> DataFrame:
    """(loop_id, point): for each loop of a nest the values of all variables around it and its own, the outermost first.

    loops: as in nest_ranges.
    """
    return range_points(nest_ranges(loops)).select("loop_id", "point")


def nest_next_point(points: DataFrame, loops: DataFrame, level: int) -> DataFrame:
    """points with next: one step on along the variable at `level` (0: the outermost), null behind its bound or without such a variable."""
    up = loops.select(F.col("loop_id").alias("node_id"), F.col("parent_loop").alias("parent"), F.lit(0).cast("long").alias("graph_id"))
    path = F.split("path", "/").cast("array<long>")
    at = forest_tree(up).select(F.col("node_id").alias("loop_id"), F.get(path, F.lit(level)).alias("__at"))
    bounds = loops.select(F.col("loop_id").alias("__at"), "upper", "step")
    ahead = F.get("point", F.lit(level)) + F.col("step")
    inside = F.when(F.col("step") > 0, ahead <= F.col("upper")).otherwise(ahead >= F.col("upper"))
    moved = F.transform("point", lambda x, i: F.when(i == level, ahead).otherwise(x))
    return points.join(at, "loop_id", "left").join(bounds, "__at", "left").select("loop_id", "point", F.when(inside, moved).alias("next"))
