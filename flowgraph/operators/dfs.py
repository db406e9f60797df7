"""Reachability, depth-first numbering, classes of edges, dominators and alternative regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.model import NODE, Graph
from flowgraph.operators.fixpoint import closure, cut
from flowgraph.operators.pergraph import depth_first, immediate_dominators, out_lists, per_graph


def reachable_nodes(g: Graph) -> DataFrame:
    """(graph_id, node_id) of the nodes that a path from the start reaches; a loop of joins, for graphs of any size."""
    seed = g.starts.select("graph_id", F.col("start").alias("node_id"))
    edges = cut(g.edges.select("graph_id", "src", "dst").distinct())
    return closure(seed, lambda new: new.withColumnRenamed("node_id", "src").join(edges, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id")))


def reachable_edges(g: Graph) -> DataFrame:
    """Edges whose source is reached."""
    return g.edges.join(reachable_nodes(g).withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", "edge_id")


def _analyse(nodes, edges, start):
    """Numbers of the depth-first tree and of the dominator tree of the reached nodes."""
    if start is None:
        return
    entered, left, above = depth_first([start], out_lists(edges))
    pre = {n: i for i, n in enumerate(entered)}
    rpo = {n: i for i, n in enumerate(reversed(left))}
    preds: dict[int, list[int]] = {}
    for edge in edges:
        if edge[1] in pre:
            preds.setdefault(edge[2], []).append(edge[1])
    idom = immediate_dominators(start, rpo, preds)
    below: dict[int, list[tuple[int, int]]] = {}
    for node, top in sorted(idom.items()):
        below.setdefault(top, []).append((node, 0))
    order, done, _ = depth_first([start], below)
    place = {n: i for i, n in enumerate(order)}
    size = dict.fromkeys(order, 1)
    depth = {start: 0}
    for n in done[:-1]:
        size[idom[n]] += size[n]
    for n in order[1:]:
        depth[n] = depth[idom[n]] + 1
    for n in entered:
        yield n, pre[n], rpo[n], above[n][0], above[n][1], idom.get(n), place[n], size[n], depth[n]


def dfst(g: Graph, order_col: str | None = None) -> DataFrame:
    """One row for each reached node: pre, rpo (reverse postorder), parent and parent_edge in the depth-first tree, idom,
    and dom_pre, dom_size, dom_depth: a node dominates those numbered from dom_pre to dom_pre + dom_size - 1.

    Out-edges are followed from the greatest edge_id down, or of order_col (ties: the greatest edge_id first).
    """
    if order_col:
        ranked = F.row_number().over(Window.partitionBy("graph_id").orderBy(order_col, "edge_id")).cast("long")
        renamed = cut(g.edges.withColumn("__rank", ranked))
        g = g.with_(edges=renamed.withColumns({"edge_id": F.col("__rank")}))
        ids = renamed.select("graph_id", F.col("__rank").alias("parent_edge"), F.col("edge_id").alias("__edge"))
    found = per_graph(g, _analyse, "node_id long, pre int, rpo int, parent long, parent_edge long, idom long, dom_pre int, dom_size int, dom_depth int")
    if order_col:
        found = found.join(ids, ["graph_id", "parent_edge"], "left").withColumn("parent_edge", F.col("__edge")).drop("__edge")
    return found


def edge_sorts(g: Graph, tree: DataFrame) -> DataFrame:
    """(graph_id, edge_id, sort): tree, forward, back or cross; null for an edge that is not reached. A self loop is back."""
    src = tree.select("graph_id", F.col("node_id").alias("src"), F.col("pre").alias("p1"), F.col("rpo").alias("r1"))
    dst = tree.select("graph_id", F.col("node_id").alias("dst"), F.col("pre").alias("p2"), F.col("rpo").alias("r2"), "parent_edge")
    both = g.edges.join(src, ["graph_id", "src"], "left").join(dst, ["graph_id", "dst"], "left")
    sort = F.when(F.col("p1").isNull(), None).when(F.col("parent_edge") == F.col("edge_id"), "tree").when(F.col("p1") < F.col("p2"), "forward").when(F.col("r2") <= F.col("r1"), "back").otherwise("cross")
    return both.select("graph_id", "edge_id", sort.alias("sort"))


def cycle_breakers(g: Graph) -> DataFrame:
    """Back edges of a depth-first search from every node not yet left, the greatest id first; without them no cycle is left."""
    return per_graph(g, _breakers, "edge_id long")


def _breakers(nodes, edges, start):
    entered, left, _ = depth_first(sorted(nodes, reverse=True), out_lists(edges))
    pre, post = {n: i for i, n in enumerate(entered)}, {n: i for i, n in enumerate(left)}
    for edge in edges:
        if pre[edge[2]] <= pre[edge[1]] and post[edge[2]] >= post[edge[1]]:
            yield (edge[0],)


def idom(tree: DataFrame) -> DataFrame:
    """(graph_id, node_id, idom) of the reached nodes; null for the start."""
    return tree.select(*NODE, "idom")


def breadth_first(g: Graph, max_rounds: int = 100_000) -> DataFrame:
    """(graph_id, node_id, parent, depth): a tree of fewest edges from the start; the parent is the least node one step nearer."""
    edges = cut(g.edges.select("graph_id", "src", "dst").where("src <> dst").distinct())
    new = found = cut(g.starts.select("graph_id", F.col("start").alias("node_id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")))
    for depth in range(1, max_rounds):
        ahead = new.select("graph_id", F.col("node_id").alias("src")).join(edges, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("src").alias("parent"))
        new = cut(ahead.join(found.select(*NODE), NODE, "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return found
        found = found.union(new)
        if depth % 10 == 0:
            found = cut(found)
    raise RuntimeError(f"no end in {max_rounds} rounds")


def _tops(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(graph_id, node_id, top): where the chain of pointers (graph_id, node_id, parent) of each node ends; nodes on circles, and behind them, are left out."""
    ends = parents.select("graph_id", F.col("node_id").alias("parent"), F.lit(True).alias("open"))
    now = cut(parents.join(ends, ["graph_id", "parent"], "left").select(*NODE, F.col("parent").alias("top"), F.coalesce("open", F.lit(False)).alias("open")))
    for _ in range(max_rounds):
        then = now.select("graph_id", F.col("node_id").alias("top"), F.col("top").alias("next"), F.col("open").alias("still"))
        step = cut(now.where("open").join(then, ["graph_id", "top"]).select(*NODE, F.col("next").alias("top"), F.col("still").alias("open")))
        done = now.where("not open")
        if step.where("not open").isEmpty():
            return done.select(*NODE, "top")
        now = cut(done.union(step))
    raise RuntimeError("a chain is too long")


def _spanning_tree(g: Graph) -> tuple[DataFrame, DataFrame]:
    """A tree of the reached nodes (graph_id, node_id, parent; null for the start), and the reached edges into nodes with several predecessors.

    A node with one predecessor hangs under it, so chains and trees of such nodes are found by doubling; a search in
    breadth only goes from one node with several predecessors to the next.
    """
    starts = g.starts.select("graph_id", F.col("start").alias("node_id"))
    edges = g.edges.select("graph_id", "src", F.col("dst").alias("node_id")).where("src <> node_id").distinct().join(starts, NODE, "left_anti")
    edges = cut(edges)
    counted = cut(edges.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("src").alias("parent")))
    single = cut(counted.where("n = 1").select(*NODE, "parent"))
    tops = cut(_tops(single))
    many = cut(edges.join(counted.where("n > 1").select(*NODE), NODE, "left_semi"))
    above = many.join(tops.withColumnsRenamed({"node_id": "src"}), ["graph_id", "src"], "left").select("graph_id", "src", "node_id", F.coalesce("top", "src").alias("top"))
    above = above.join(single.select("graph_id", F.col("node_id").alias("top")), ["graph_id", "top"], "left_anti")  # tops on circles are not reached
    above = cut(above)
    short = above.select("graph_id", F.col("top").alias("src"), F.col("node_id").alias("dst"), F.lit(0).alias("edge_id"), F.lit("").alias("info"))
    near = cut(breadth_first(g.with_(edges=short)))
    hung = above.join(near.select(*NODE, F.col("parent").alias("top")), [*NODE, "top"]).groupBy(*NODE).agg(F.min("src").alias("parent"))
    low = tops.join(near.select("graph_id", F.col("node_id").alias("top")), ["graph_id", "top"], "left_semi").select(*NODE).join(single, NODE)
    tree = cut(starts.select(*NODE, F.lit(None).cast("long").alias("parent")).distinct().union(hung).union(low))
    reached = many.join(tree.select("graph_id", F.col("node_id").alias("src")), ["graph_id", "src"], "left_semi")
    return tree, cut(reached.join(tree.select(*NODE), NODE, "left_semi"))


def _jumps(tree: DataFrame, max_rounds: int = 64) -> tuple[list[DataFrame], DataFrame]:
    """Tables (graph_id, node_id, up) of the node 1, 2, 4, ... steps up, for nodes as deep as that, and (graph_id, node_id, depth)."""
    up = cut(tree.where("parent is not null").select(*NODE, F.col("parent").alias("up")))
    depth, tables = cut(tree.select(*NODE, F.col("parent").isNotNull().cast("int").alias("depth"), F.col("parent").alias("at"))), [up]
    for k in range(max_rounds):
        then = depth.select("graph_id", F.col("node_id").alias("at"), F.col("depth").alias("more"), F.col("at").alias("next"))
        depth = cut(depth.where("at is not null").join(then, ["graph_id", "at"]).select(*NODE, (F.col("depth") + F.col("more")).alias("depth"), F.col("next").alias("at")).union(depth.where("at is null").select(*NODE, "depth", "at")))
        over = tables[-1].select("graph_id", F.col("node_id").alias("up"), F.col("up").alias("next"))
        far = cut(tables[-1].join(over, ["graph_id", "up"]).select(*NODE, F.col("next").alias("up")))
        if far.isEmpty():
            if depth.where("at is not null").isEmpty():
                return tables, depth.select(*NODE, "depth")
        else:
            tables.append(far)
    raise RuntimeError("the pointers have a cycle")


def _common_ancestors(pairs: DataFrame, tables: list[DataFrame], depth: DataFrame) -> DataFrame:
    """pairs (graph_id, node_id, a, b) with met and met_depth, the lowest node above or at both a and b.

    The deeper one goes up to the other's depth, then both go up together, by steps of falling powers of two. Pairs that have
    met are put aside.
    """
    for end in ("a", "b"):
        pairs = pairs.join(depth.select("graph_id", F.col("node_id").alias(end), F.col("depth").alias(f"d{end}")), ["graph_id", end])
    low = F.col("da") >= F.col("db")  # a becomes the deeper one
    pairs = pairs.select(*NODE, F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("da", "db").alias("da"), F.least("da", "db").alias("db"))
    for k in reversed(range(len(tables))):
        up = tables[k].select("graph_id", F.col("node_id").alias("a"), "up")
        go = F.col("da") - F.col("db") >= (1 << k)
        pairs = pairs.join(up, ["graph_id", "a"], "left").select(*NODE, F.when(go, F.col("up")).otherwise(F.col("a")).alias("a"), "b", F.when(go, F.col("da") - (1 << k)).otherwise(F.col("da")).alias("da"), "db")
    pairs = cut(pairs)
    met = pairs.where("a = b").select(*NODE, F.col("a").alias("met"), F.col("da").alias("met_depth"))
    apart = pairs.where("a <> b").select(*NODE, "a", "b", F.col("da").alias("d"))
    if apart.isEmpty():
        return met
    for k in reversed(range(len(tables))):
        for end in ("a", "b"):
            apart = apart.join(tables[k].select("graph_id", F.col("node_id").alias(end), F.col("up").alias(f"{end}2")), ["graph_id", end], "left")
        go = F.coalesce(F.col("a2") != F.col("b2"), F.lit(False))
        apart = apart.select(*NODE, F.when(go, F.col("a2")).otherwise(F.col("a")).alias("a"), F.when(go, F.col("b2")).otherwise(F.col("b")).alias("b"), F.when(go, F.col("d") - (1 << k)).otherwise(F.col("d")).alias("d"))
    above = tables[0].select("graph_id", F.col("node_id").alias("a"), "up")
    return met.union(apart.join(above, ["graph_id", "a"]).select(*NODE, F.col("up").alias("met"), F.col("d") - 1))


def idom_by_joins(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(graph_id, node_id, idom) of the reached nodes, null for the start; by joins alone, for graphs of any size.

    One pointer a node: at first that of a spanning tree, whose ancestors are all that may dominate. A node with one
    predecessor keeps it. Each round moves the pointer of every other node to the lowest common ancestor of itself and
    all its predecessors, in the tree that the pointers make, until none moves. Pointers only move up, and dominators always
    stay among the ancestors, so what is left dominates. Common ancestors are found by doubling tables, whose rows are
    the nodes times the logarithm of the tree's depth; a chain takes no round at all.
    """
    tree, edges = _spanning_tree(g)
    if edges.isEmpty():
        return tree.select(*NODE, F.col("parent").alias("idom"))
    for _ in range(max_rounds):
        tables, depth = _jumps(tree)
        pairs = edges.select(*NODE, F.col("src").alias("b")).join(tree.select(*NODE, F.col("parent").alias("a")), NODE).where("a <> b")
        met = _common_ancestors(pairs, tables, depth)
        top = met.groupBy(*NODE).agg(F.min(F.struct("met_depth", "met")).alias("best")).select(*NODE, F.col("best.met").alias("met"))
        moved = cut(top.join(tree, NODE).where("met <> parent").select(*NODE, "met"))
        if moved.isEmpty():
            return tree.select(*NODE, F.col("parent").alias("idom"))
        tree = cut(tree.join(moved, NODE, "left").select(*NODE, F.coalesce("met", "parent").alias("parent")))
    raise RuntimeError(f"no end in {max_rounds} rounds")


def ancestors(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(graph_id, top, node_id, distance): every node with each of its ancestors, itself at distance 0, of a parent table.

    Round k joins the pairs of distance below 2**k with the jumps of 2**k, so each pair is made once and rounds are the
    logarithm of the depth. A node that is its own parent is a root; the pointers must have no other cycle.
    """
    up = parents.where("parent is not null and parent <> node_id").select("graph_id", F.col("node_id").alias("top"), F.col("parent").alias("next"))
    found = cut(parents.select("graph_id", F.col("node_id").alias("top"), "node_id", F.lit(0).alias("distance")))
    jumps = cut(up)
    for k in range(max_rounds):
        if jumps.isEmpty():
            return found
        more = found.join(jumps, ["graph_id", "top"]).select("graph_id", F.col("next").alias("top"), "node_id", (F.col("distance") + (1 << k)).alias("distance"))
        found = found.union(cut(more))
        after = jumps.select("graph_id", F.col("top").alias("next"), F.col("next").alias("far"))
        jumps = cut(jumps.join(after, ["graph_id", "next"]).select("graph_id", "top", F.col("far").alias("next")))
    raise RuntimeError("the pointers have a cycle")


def dominance_pairs(tree: DataFrame) -> DataFrame:
    """(graph_id, dominator, node_id, distance), reflexive: the ancestors in the dominator tree."""
    found = ancestors(tree.select(*NODE, F.col("idom").alias("parent")))
    return found.select("graph_id", F.col("top").alias("dominator"), "node_id", "distance")


def dominators(tree: DataFrame) -> DataFrame:
    """(graph_id, node_id, dominator, rank): strict dominators, the nearest of rank 1."""
    return dominance_pairs(tree).where("distance > 0").select(*NODE, "dominator", F.col("distance").alias("rank"))


def maximal_alt(g: Graph, header: DataFrame) -> DataFrame:
    """(graph_id, header, node_id): for header (graph_id, header), the largest set of reached nodes entered only through it.

    For graphs of any size: nodes that the start reaches without passing the header are outside.
    """
    edges = cut(g.edges.select("graph_id", "src", "dst").distinct())
    seed = g.starts.join(header, "graph_id").where("start <> header").select("graph_id", "header", F.col("start").alias("node_id"))
    around = closure(seed, lambda new: new.withColumnRenamed("node_id", "src").join(edges, ["graph_id", "src"]).where("dst <> header").select("graph_id", "header", F.col("dst").alias("node_id")))
    return reachable_nodes(g.with_(edges=edges.withColumns({"edge_id": F.lit(0), "info": F.lit("")}))).join(header, "graph_id").join(around, ["graph_id", "header", "node_id"], "left_anti").select("graph_id", "header", "node_id")


def alt_tree(tree: DataFrame) -> DataFrame:
    """(graph_id, header, outer, depth, size): each reached node's maximal alt inside that of its immediate dominator."""
    return tree.select("graph_id", F.col("node_id").alias("header"), F.col("idom").alias("outer"), F.col("dom_depth").alias("depth"), F.col("dom_size").alias("size"))


def subtree_members(parents: DataFrame) -> DataFrame:
    """(graph_id, top, node_id): every node with each of its ancestors and itself, for any parent table."""
    return ancestors(parents).select("graph_id", "top", "node_id")
