"""Monotone data-flow problems over rows of facts, and the classic ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.model import NODE, Graph
from flowgraph.operators.fixpoint import closure, cut


def writes_variable(name: Column | str) -> Column:
    return F.array_contains("writes", name)


def reads_variable(name: Column | str) -> Column:
    return F.array_contains("reads", name)


def same_target(a: Column, b: Column) -> Column:
    """Whether two lists of written variables are the same, in order; null lists are never."""
    return F.coalesce(a == b, F.lit(False))


def gen_kill(stmts: DataFrame) -> dict[str, DataFrame]:
    """What the nodes' ordered statements give: uses (var read no later than first written), defs (last stmt of each var),
    kill (vars written) and reads (stmt_id and var of every read no later than the first write).

    stmts: graph_id, node_id, stmt_id, pos, writes, reads. A statement reads before it writes.
    """
    writes = stmts.select(*NODE, "stmt_id", "pos", F.explode("writes").alias("var"))
    reads = stmts.select(*NODE, "stmt_id", "pos", F.explode("reads").alias("var"))
    first = writes.groupBy(*NODE, "var").agg(F.min("pos").alias("__first"), F.max(F.struct("pos", "stmt_id"))["stmt_id"].alias("stmt_id"))
    early = reads.join(first.drop("stmt_id"), [*NODE, "var"], "left").where("__first is null or pos <= __first")
    return {"uses": early.select(*NODE, "var").distinct(), "reads": early.select(*NODE, "stmt_id", "var").distinct(), "defs": first.select(*NODE, "stmt_id", "var"), "kill": first.select(*NODE, "var")}


def solve(g: Graph, gen: DataFrame, kill: DataFrame, direction: str = "forward", meet: str = "union", universe: DataFrame | None = None) -> DataFrame:
    """(graph_id, node_id, fact columns): facts that hold behind each node in the direction of the flow.

    gen: node and fact columns. kill: node and some of the fact columns; a fact that comes into the node and agrees
    with a row of it ends there. direction: forward, backward or both (a fact flows along and against edges). With
    meet `union` a fact holds if it holds on some way, with `intersect` if on all ways: from the start, or (backward)
    to a node without out-edges. For that universe lists the facts (graph_id, fact columns) and what does not hold is
    solved as a union problem; nodes that no such way meets hold everything.
    """
    facts = [c for c in gen.columns if c not in NODE]
    keys = [c for c in kill.columns if c not in NODE]
    steps = []
    if direction in ("forward", "both"):
        steps.append(("src", "dst"))
    if direction in ("backward", "both"):
        steps.append(("dst", "src"))
    edges = g.edges.select("graph_id", F.col(steps[0][0]).alias("node_id"), F.col(steps[0][1]).alias("__to"))
    for a, b in steps[1:]:
        edges = edges.union(g.edges.select("graph_id", F.col(a), F.col(b)))
    edges = cut(edges.distinct())

    def move(new: DataFrame) -> DataFrame:
        return new.join(edges, NODE).select("graph_id", F.col("__to").alias("node_id"), *facts)

    if meet == "union":
        kill = cut(kill.distinct())
        return closure(gen.select(*NODE, *facts), lambda new: move(new).join(kill, [*NODE, *keys], "left_anti"))
    gen = cut(gen.select(*NODE, *facts).distinct())
    if direction == "forward":
        ends = g.starts.select("graph_id", F.col("start").alias("node_id"))
    else:
        ends = g.nodes.select(*NODE).join(g.edges.select("graph_id", F.col("src").alias("node_id")), NODE, "left_anti")
    everywhere = g.nodes.select(*NODE).join(universe, "graph_id")
    seed = ends.join(universe, "graph_id").select(*NODE, *facts).union(everywhere.join(kill, [*NODE, *keys], "left_semi").select(*NODE, *facts))
    missing = closure(seed.join(gen, [*NODE, *facts], "left_anti"), lambda new: move(new).join(gen, [*NODE, *facts], "left_anti"))
    return everywhere.join(missing, [*NODE, *facts], "left_anti").select(*NODE, *facts)


def _packed(rows: DataFrame, index: DataFrame, facts: list[str]) -> DataFrame:
    """(graph_id, node_id, part.., word, bits) of rows (graph_id, node_id, facts)."""
    there = rows.join(index, ["graph_id", *facts])
    return there.groupBy(*NODE, "part", "word").agg(F.bit_or("bit").alias("bits"))


def solve_packed(g: Graph, gen: DataFrame, kill: DataFrame, direction: str = "forward") -> DataFrame:
    """As solve with the meet `union`, with up to 64 facts in a row as bits of a word.

    Facts are numbered within those that are killed together (of one variable, say), so a row has the facts of one node and
    variable, 64 at a time; a variable of more facts has more words, so no row grows with it. A round moves the bits that
    the last one set along the edges, takes off what is killed, joins them by bit_or and keeps those that are new; what is
    known is one row a word and not one a fact. Where the kill key is the whole fact, all facts of a graph are numbered
    together and a node's kills are a mask.
    """
    facts = [c for c in gen.columns if c not in NODE]
    keys = [c for c in kill.columns if c not in NODE]
    shared = [c for c in keys if len(keys) < len(facts)]  # facts that agree in these are killed together
    gen = cut(gen.select(*NODE, *facts).distinct())
    number = F.row_number().over(Window.partitionBy("graph_id", *shared).orderBy(*[c for c in facts if c not in shared])) - 1
    index = gen.select("graph_id", *facts).distinct().withColumn("n", number)
    index = cut(index.select("graph_id", *facts, F.struct(*shared, F.lit(0).alias("all")).alias("part"), F.floor(F.col("n") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, n % 64)").alias("bit")))
    masks = cut(_packed(kill.distinct().join(index.select("graph_id", *facts), ["graph_id", *keys]), index, facts).withColumnRenamed("bits", "mask"))
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    edges = cut(g.edges.select("graph_id", F.col(a).alias("node_id"), F.col(b).alias("__to")).distinct())
    key, none = [*NODE, "part", "word"], F.lit(0).cast("long")
    known = new = cut(_packed(gen, index, facts))
    while True:
        came = new.join(edges, NODE).select("graph_id", F.col("__to").alias("node_id"), "part", "word", "bits", none.alias("mask"), none.alias("old"))
        rows = came.union(masks.select(*key, none, "mask", none)).union(known.select(*key, none, none, "bits"))
        met = rows.groupBy(*key).agg(*[F.bit_or(c).alias(c) for c in ("bits", "mask", "old")])  # one exchange for arrivals, kills and what is known
        fresh = F.col("bits").bitwiseAND(F.bitwise_not("mask")).bitwiseAND(F.bitwise_not("old"))
        both = cut(met.select(*key, fresh.alias("fresh"), F.col("old").bitwiseOR(fresh).alias("bits")).where("bits <> 0"))
        known, new = both.select(*key, "bits"), both.where("fresh <> 0").select(*key, F.col("fresh").alias("bits"))
        if new.isEmpty():
            break
    apart = known.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).where("(shiftrightunsigned(bits, i) & 1L) = 1")
    return apart.withColumn("bit", F.expr("shiftleft(1L, i)")).join(index, ["graph_id", "part", "word", "bit"]).select(*NODE, *facts)


def on_edges(g: Graph, solved: DataFrame, direction: str = "forward") -> DataFrame:
    """The facts of each edge: those behind its source, or (backward) its target."""
    end = "src" if direction == "forward" else "dst"
    return g.edges.select("graph_id", "edge_id", F.col(end).alias("node_id")).join(solved, NODE).drop("node_id")


def fact_state(solved: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (a node or edge and fact columns) with holds, whether the fact is there."""
    keys = asked.columns
    return asked.join(solved.select(*keys).distinct().withColumn("holds", F.lit(True)), keys, "left").withColumn("holds", F.coalesce("holds", F.lit(False)))


def reaching_defs(g: Graph, stmts: DataFrame) -> DataFrame:
    """(graph_id, node_id, stmt_id, var): definitions that reach the end of each node."""
    parts = gen_kill(stmts)
    return solve_packed(g, parts["defs"], parts["kill"])


def live_vars(g: Graph, stmts: DataFrame) -> DataFrame:
    """(graph_id, node_id, var): variables live before each node."""
    parts = gen_kill(stmts)
    return solve_packed(g, parts["uses"], parts["kill"], "backward")


def upward_exposed(g: Graph, stmts: DataFrame, mode: str = "any") -> DataFrame:
    """Uses that a node's begin can still see: any: (.., stmt_id, var) on some way, so with the definitions def-use chains;
    all: (.., var) that every way on reads before it is written."""
    parts = gen_kill(stmts)
    if mode == "any":
        return solve_packed(g, parts["reads"], parts["kill"], "backward")
    universe = parts["uses"].select("graph_id", "var").distinct()
    return solve(g, parts["uses"], parts["kill"], "backward", "intersect", universe)


def latest_definition(stmts: DataFrame) -> DataFrame:
    """(graph_id, node_id, var, stmt_id, nth): the writes of each variable in a node, the last one first."""
    writes = stmts.select(*NODE, "stmt_id", "pos", F.explode("writes").alias("var"))
    return writes.withColumn("nth", F.row_number().over(Window.partitionBy(*NODE, "var").orderBy(F.desc("pos"), F.desc("stmt_id"))))
