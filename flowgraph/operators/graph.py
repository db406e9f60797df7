"""Editing and describing tables of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.model import NODE, Graph


def _next_ids(id_col: str, order: list[str]) -> Column:
    """Ids that go on after `__last`, in the given order of each graph."""
    number = F.row_number().over(Window.partitionBy("graph_id").orderBy(*order))
    return (F.coalesce("__last", F.lit(-1)) + number).cast("long").alias(id_col)


def insert_nodes(g: Graph, rows: DataFrame, order: list[str]) -> Graph:
    """rows (graph_id, info) as new nodes; ids go on after the greatest of each graph, in the given order of columns."""
    last = g.nodes.groupBy("graph_id").agg(F.max("node_id").alias("__last"))
    new = rows.join(last, "graph_id", "left").select("graph_id", _next_ids("node_id", order), "info")
    return g.with_(nodes=g.nodes.select("graph_id", "node_id", "info").unionByName(new))


def insert_edges(g: Graph, rows: DataFrame, order: list[str]) -> Graph:
    """rows (graph_id, src, dst, info) as new edges; parallel ones are kept."""
    last = g.edges.groupBy("graph_id").agg(F.max("edge_id").alias("__last"))
    new = rows.join(last, "graph_id", "left").select("graph_id", _next_ids("edge_id", order), "src", "dst", "info")
    return g.with_(edges=g.edges.select("graph_id", "edge_id", "src", "dst", "info").unionByName(new))


def delete_edges(g: Graph, condition: Column) -> Graph:
    """Without the edges that meet the condition (a null result keeps the edge)."""
    return g.with_(edges=g.edges.where(~F.coalesce(condition, F.lit(False))))


def delete_nodes(g: Graph, condition: Column) -> Graph:
    """Without the nodes that meet the condition and all edges at them."""
    gone = g.nodes.where(F.coalesce(condition, F.lit(False))).select(*NODE)
    edges = g.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return g.with_(nodes=g.nodes.join(gone, NODE, "left_anti"), edges=edges.select(g.edges.columns))


def replace_info(table: DataFrame, updates: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table with new labels, and the updates whose item it does not have. Key and all else stay."""
    new = updates.select(*key, F.col("info").alias("__new"), F.lit(True).alias("__hit"))
    out = table.join(new, key, "left").withColumn("info", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("info")))
    return out.select(table.columns), updates.join(table.select(*key), key, "left_anti")


def compact_ids(g: Graph) -> Graph:
    """A copy with dense ids from 0, the greatest old id first."""
    node = g.nodes.withColumn("__new", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("node_id"))).cast("long") - 1)
    edge = g.edges.withColumn("edge_id", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("edge_id"))).cast("long") - 1)
    starts = g.starts
    for end in ("src", "dst"):
        edge = edge.join(node.select("graph_id", F.col("node_id").alias(end), F.col("__new").alias(f"__{end}")), ["graph_id", end])
    starts = starts.join(node.select("graph_id", F.col("node_id").alias("start"), "__new"), ["graph_id", "start"])
    return Graph(
        node.select("graph_id", F.col("__new").alias("node_id"), "info"),
        edge.select("graph_id", "edge_id", F.col("__src").alias("src"), F.col("__dst").alias("dst"), "info"),
        starts.select("graph_id", F.col("__new").alias("start")),
    )


def graph_stats(g: Graph) -> DataFrame:
    """graph_id, n_nodes, n_edges and the next unused ids."""
    nodes = g.nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), (F.max("node_id") + 1).alias("next_node"))
    edges = g.edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), (F.max("edge_id") + 1).alias("next_edge"))
    zero = F.lit(0).cast("long")
    return nodes.join(edges, "graph_id", "left").select("graph_id", "n_nodes", F.coalesce("n_edges", zero).alias("n_edges"), "next_node", F.coalesce("next_edge", zero).alias("next_edge"))


def adjacency(g: Graph) -> DataFrame:
    """Each node with its in- and out-degree, parallel edges counted, and its edges' ids, the latest first."""
    out = g.nodes.select(*NODE)
    for end, name in (("src", "out"), ("dst", "in")):
        own = g.edges.groupBy("graph_id", F.col(end).alias("node_id")).agg(F.sort_array(F.collect_list("edge_id"), asc=False).alias(f"{name}_edges"))
        out = out.join(own, NODE, "left").withColumn(f"{name}_edges", F.coalesce(f"{name}_edges", F.array().cast("array<bigint>")))
    return out.select(*NODE, F.size("out_edges").cast("long").alias("out_degree"), F.size("in_edges").cast("long").alias("in_degree"), "out_edges", "in_edges")


def pred_succ(g: Graph) -> DataFrame:
    """Distinct (graph_id, src, dst): dst is a successor of src, src a predecessor of dst."""
    return g.edges.select("graph_id", "src", "dst").distinct()


def exit_nodes(g: Graph) -> DataFrame:
    """Nodes without an out-edge."""
    return g.nodes.select(*NODE).join(g.edges.select("graph_id", F.col("src").alias("node_id")), NODE, "left_anti")


def single_exit(g: Graph, info: str = "exit") -> Graph:
    """With a new last node in each graph that has exits, and an edge to it from each of them."""
    exits = exit_nodes(g)
    new = exits.select("graph_id").distinct().withColumn("info", F.lit(info))
    grown = insert_nodes(g, new, ["info"])
    last = grown.nodes.groupBy("graph_id").agg(F.max("node_id").alias("dst"))
    rows = exits.join(last, "graph_id").select("graph_id", F.col("node_id").alias("src"), "dst", F.lit(info).alias("info"))
    return insert_edges(grown, rows, ["src"])


def order_reverse(order: DataFrame) -> DataFrame:
    """(graph_id, node_id, number) with the numbers of each graph mirrored between its first and last."""
    ends = order.groupBy("graph_id").agg((F.min("number") + F.max("number")).alias("__both"))
    return order.join(ends, "graph_id").select(*NODE, (F.col("__both") - F.col("number")).alias("number"))


def order_normalize(order: DataFrame) -> DataFrame:
    """With the numbers of each graph moved to begin at 0."""
    first = order.groupBy("graph_id").agg(F.min("number").alias("__first"))
    return order.join(first, "graph_id").select(*NODE, (F.col("number") - F.col("__first")).alias("number"))


def order_lookup(order: DataFrame, numbers: DataFrame) -> DataFrame:
    """(graph_id, number, node_id) for asked numbers; node_id is null outside the order."""
    return numbers.join(order.select("graph_id", "number", "node_id"), ["graph_id", "number"], "left")
