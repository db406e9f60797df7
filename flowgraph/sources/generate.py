"""Random graphs whose rows depend on the seed and their ids only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.model import Graph


def spread(*parts: Column | int) -> Column:
    """A number from 0 to 2147483646, scattered by whole-number arithmetic that any SQL engine repeats."""
    out: Column = F.lit(1).cast("long")
    for p in parts:
        value = F.lit(p).cast("long") if isinstance(p, int) else p.cast("long")
        out = (out * 48271 + value * 69621 + 12345) % 2147483647
        out = (out * 16807 + 7) % 2147483647
    return out


def _nodes(graphs: DataFrame) -> DataFrame:
    return graphs.select("graph_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("node_id")).withColumn("info", F.col("node_id").cast("string"))


def random_digraph(graphs: DataFrame, seed: int) -> Graph:
    """For each row of graphs (graph_id, n, m): n nodes and m edges with uniform ends; start 0. Rows with n < 1 give nothing."""
    graphs = graphs.where("n > 0")
    ids = graphs.where("m > 0").select("graph_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("edge_id"))
    edges = ids.select("graph_id", "edge_id", *[(spread(seed, F.col("graph_id"), F.col("edge_id"), k) % F.col("n")).alias(c) for k, c in ((1, "src"), (2, "dst"))], F.lit("").alias("info"))
    return Graph(_nodes(graphs), edges, graphs.select("graph_id", F.lit(0).cast("long").alias("start")))


def random_cfg(graphs: DataFrame, seed: int) -> Graph:
    """As random_digraph, but every node is reached from 0: edge i - 1 leads to node i from a smaller one. Needs 0 < n <= m + 1 and m > 0."""
    if not graphs.where("not (n > 0 and m > 0 and n <= m + 1)").isEmpty():
        raise ValueError("a flow graph needs n > 0, m > 0 and n <= m + 1")
    g = random_digraph(graphs, seed)
    tree = F.col("edge_id") + 1 < F.col("n")
    rows = g.edges.join(graphs.select("graph_id", "n"), "graph_id")
    node = F.col("edge_id") + 1
    edges = rows.select("graph_id", "edge_id", F.when(tree, spread(seed, F.col("graph_id"), node, 3) % node).otherwise(F.col("src")).alias("src"), F.when(tree, node).otherwise(F.col("dst")).alias("dst"), "info")
    return g.with_(edges=edges)
