"""Clean-up of control flow: straight lines, unreachable and empty nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.model import NODE, Graph
from flowgraph.operators.dfs import dfst, reachable_nodes
from flowgraph.operators.fixpoint import cut, double_pointers
from flowgraph.operators.pergraph import per_graph


def _chain_edges(g: Graph) -> DataFrame:
    """Edges that are the only one out of their source and into their target, which is not the start; sources are reached."""
    outs = g.edges.groupBy("graph_id", "src").agg(F.count("*").alias("__outs"))
    ins = g.edges.groupBy("graph_id", "dst").agg(F.count("*").alias("__ins"))
    single = g.edges.join(outs.where("__outs = 1"), ["graph_id", "src"]).join(ins.where("__ins = 1"), ["graph_id", "dst"])
    single = single.join(g.starts.withColumnRenamed("start", "dst"), ["graph_id", "dst"], "left_anti")
    return single.join(reachable_nodes(g).withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", "edge_id", "src", "dst")


def straight_lines(g: Graph) -> DataFrame:
    """(graph_id, node_id, head, position): every node in its maximal chain, from 0 at the head. A circle of unreached nodes is no chain."""
    above = _chain_edges(g).select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("parent"))
    rows = double_pointers(g.nodes.select(*NODE).join(above, NODE, "left"), NODE, "parent")
    return rows.select(*NODE, F.col("root").alias("head"), F.col("depth").alias("position"))


def collapse_lines(g: Graph, separator: str = ";") -> tuple[Graph, DataFrame]:
    """Each straight line as one node, the head, with the labels along the line; and (graph_id, merged), nodes that went."""
    lines = cut(straight_lines(g))
    labels = g.nodes.join(lines, NODE).groupBy("graph_id", F.col("head").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("position", "info"))).alias("__all"))
    nodes = labels.select(*NODE, F.array_join(F.col("__all.info"), separator).alias("info"))
    heads = lines.select("graph_id", F.col("node_id").alias("src"), "head")
    edges = g.edges.join(_chain_edges(g).select("graph_id", "edge_id"), ["graph_id", "edge_id"], "left_anti").join(heads, ["graph_id", "src"])
    edges = edges.select("graph_id", "edge_id", F.col("head").alias("src"), "dst", "info")
    return g.with_(nodes=nodes, edges=edges), lines.groupBy("graph_id").agg(F.sum((F.col("position") > 0).cast("long")).alias("merged"))


def remove_unreachable(g: Graph) -> tuple[Graph, DataFrame]:
    """Without the nodes that the start does not reach, and their edges; and (graph_id, removed)."""
    reached = reachable_nodes(g)
    kept = g.with_(nodes=g.nodes.join(reached, NODE, "left_semi"), edges=g.edges.join(reached.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi"))
    gone = g.nodes.join(reached.withColumn("__hit", F.lit(0)), NODE, "left").groupBy("graph_id").agg(F.sum(F.coalesce("__hit", F.lit(1))).cast("long").alias("removed"))
    return kept, gone


def _targets(nodes, edges, start):
    """nodes: (id, empty, rpo or -1). Where each removable empty node leads; the last of a circle of them stays."""
    outs: dict[int, list[int]] = {}
    for e in edges:
        outs.setdefault(e[1], []).append(e[2])
    rpo = {n: r for n, _, r in nodes}
    nxt = {n: outs[n][0] for n, empty, _ in nodes if empty and len(outs.get(n, ())) == 1 and outs[n][0] != n}
    state: dict[int, int] = {}
    for n in sorted(nxt):
        path = []
        while n in nxt and n not in state:
            state[n] = 1
            path.append(n)
            n = nxt[n]
        if n in nxt and state[n] == 1:
            circle = path[path.index(n) :]
            del nxt[max(circle, key=lambda x: (rpo[x], x))]
        for x in path:
            state[x] = 2
    for n in nxt:
        at = nxt[n]
        while at in nxt:
            at = nxt[at]
        yield n, at


def remove_empty(g: Graph, is_empty: Column) -> tuple[Graph, DataFrame]:
    """Without empty nodes that have one out-edge, not to themselves: edges into them go on to where they lead.

    To a fixpoint; of a circle of such nodes the one of the highest reverse postorder stays (unreached ones: of the
    greatest id). A start that goes moves on. Labels of removed nodes stand before that of the node they lead to. Also
    (graph_id, removed).
    """
    tree = dfst(g).select(*NODE, "rpo")
    marked = g.nodes.join(tree, NODE, "left").select(*NODE, F.coalesce(is_empty, F.lit(False)).alias("empty"), F.coalesce("rpo", F.lit(-1)).alias("rpo"))
    to = cut(per_graph(g, _targets, "node_id long, target long", node_columns=marked))
    labels = to.join(g.nodes, NODE).groupBy("graph_id", F.col("target").alias("node_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("node_id").alias("__n"), "info"))), lambda x: x["info"]), ";").alias("__more"))
    nodes = g.nodes.join(to, NODE, "left_anti").join(labels, NODE, "left").withColumn("info", F.concat_ws(";", "__more", "info")).select(*NODE, "info")
    edges = g.edges.join(to.withColumnRenamed("node_id", "src").select("graph_id", "src"), ["graph_id", "src"], "left_anti")
    edges = edges.join(to.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left").select("graph_id", "edge_id", "src", F.coalesce("target", "dst").alias("dst"), "info")
    starts = g.starts.join(to.withColumnRenamed("node_id", "start"), ["graph_id", "start"], "left").select("graph_id", F.coalesce("target", "start").alias("start"))
    gone = g.nodes.select(*NODE).join(to, NODE, "left").groupBy("graph_id").agg(F.count("target").alias("removed"))
    return Graph(nodes, edges, starts), gone
