"""DOT text of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgraph.model import NODE, Graph
from flowgraph.operators.regions import forest_tree


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"')


#: In the order of a text's lines: nodes stand behind clusters, a cluster's end behind its nodes, edges behind all.
_NODES, _EDGES, _END = 1 << 61, (1 << 62) + (1 << 61), (1 << 63) - 1


def cluster_paths(clusters: DataFrame) -> DataFrame:
    """(graph_id, cluster, path): the numbers of the clusters around each one and its own, the outermost first.

    clusters: (graph_id, cluster, parent), parent null for the outermost.
    """
    tree = forest_tree(clusters.select("graph_id", F.col("cluster").alias("node_id"), "parent"))
    return tree.select("graph_id", F.col("node_id").alias("cluster"), F.split("path", "/").cast("array<long>").alias("path"))


def dot_lines(g: Graph, node_attrs: DataFrame | None = None, edge_attrs: DataFrame | None = None, clusters: DataFrame | None = None, cluster_tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, place, line): the statements of the text, one a row, for graphs too large for one string.

    place is an array that puts the lines in order. attrs: (graph_id, node_id or edge_id, attrs), text put behind the
    label. clusters: (graph_id, node_id, cluster), each node's innermost one; cluster_tree: (graph_id, cluster, parent)
    where clusters lie in others, also such as have no node of their own.
    """
    nodes = g.nodes
    attrs = F.lit("")
    if node_attrs is not None:
        nodes, attrs = nodes.join(node_attrs.select(*NODE, "attrs"), NODE, "left"), F.coalesce(F.concat(F.lit(", "), "attrs"), F.lit(""))
    path, frames = F.array().cast("array<long>"), None
    if clusters is not None:
        mine = clusters.select(*NODE, F.col("cluster").cast("long").alias("cluster"))
        if cluster_tree is not None:
            frames = cluster_paths(cluster_tree)
        else:
            frames = mine.join(g.nodes.select(*NODE), NODE, "left_semi").where("cluster is not null").select("graph_id", "cluster").distinct().withColumn("path", F.array("cluster"))
        nodes = nodes.join(mine, NODE, "left").join(frames.withColumnRenamed("path", "__path"), ["graph_id", "cluster"], "left")
        path = F.coalesce("__path", path)
    label = F.concat(F.lit("n"), F.col("node_id").cast("string"), F.lit(' [label="'), _quoted(F.coalesce("info", F.lit(""))), F.lit('"'), attrs, F.lit("];"))
    lines = nodes.select("graph_id", F.concat(path, F.array(_NODES - F.col("node_id"))).alias("place"), label.alias("line"))
    if frames is not None:
        begin = F.concat(F.lit("subgraph cluster_"), F.element_at("path", -1).cast("string"), F.lit(" {"))
        lines = lines.union(frames.select("graph_id", "path", begin)).union(frames.select("graph_id", F.concat("path", F.array(F.lit(_END))), F.lit("}")))
    edges, attrs = g.edges, F.lit("")
    if edge_attrs is not None:
        edges, attrs = edges.join(edge_attrs.select("graph_id", "edge_id", "attrs"), ["graph_id", "edge_id"], "left"), F.coalesce(F.concat(F.lit(", "), "attrs"), F.lit(""))
    arrow = F.concat(F.lit("n"), F.col("src").cast("string"), F.lit(" -> n"), F.col("dst").cast("string"), F.lit(' [label="'), _quoted(F.coalesce("info", F.lit(""))), F.lit('"'), attrs, F.lit("];"))
    return lines.union(edges.select("graph_id", F.array(F.lit(_EDGES), -F.col("edge_id")), arrow))


def to_dot(g: Graph, node_attrs: DataFrame | None = None, edge_attrs: DataFrame | None = None, clusters: DataFrame | None = None, cluster_tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, dot): a digraph with nodes, then edges, the greatest ids first; clusters stand before the other nodes, by number, each with those inside it."""
    lines = dot_lines(g, node_attrs, edge_attrs, clusters, cluster_tree)
    order = F.sort_array(F.collect_list(F.struct("place", "line")))
    body = lines.groupBy("graph_id").agg(F.array_join(F.transform(order, lambda x: x["line"]), "\n").alias("body"))
    return body.select("graph_id", F.concat(F.lit("digraph g"), F.col("graph_id").cast("string"), F.lit(" {\n"), "body", F.lit("\n}\n")).alias("dot"))


def loop_clusters(loops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of nodes, and of clusters, from a loop forest: a loop is named by its header, which lies in it."""
    heads = loops.where("header is not null").select("graph_id", F.col("header").alias("node_id"), F.lit(True).alias("__head")).distinct()
    both = loops.join(heads, NODE, "left")
    return both.select(*NODE, F.when(F.col("__head"), F.col("node_id")).otherwise(F.col("header")).alias("cluster")), both.where("__head").select("graph_id", F.col("node_id").alias("cluster"), F.col("header").alias("parent"))


def alt_clusters(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters of nodes, and of clusters, from maximal alternative regions of more than one node, named by their headers."""
    own = F.when(F.col("dom_size") > 1, F.col("node_id")).otherwise(F.col("idom"))
    return tree.select(*NODE, own.alias("cluster")), tree.where("dom_size > 1").select("graph_id", F.col("node_id").alias("cluster"), F.col("idom").alias("parent"))


def dominance_graph(g: Graph, tree: DataFrame) -> Graph:
    """The reached nodes with an edge from each immediate dominator; an edge has its lower end's id."""
    nodes = g.nodes.join(tree.select(*NODE), NODE, "left_semi")
    edges = tree.where("idom is not null").select("graph_id", F.col("node_id").alias("edge_id"), F.col("idom").alias("src"), F.col("node_id").alias("dst"), F.lit("").alias("info"))
    return Graph(nodes, edges, g.starts)


#: Styles of the classes of depth-first edges.
SORT_STYLES = {"tree": "color=black", "forward": "color=blue", "back": "color=red", "cross": "color=green"}


def style_sorts(sorts: DataFrame) -> DataFrame:
    """Edge attributes from the classes of edges; dashed where the edge is not reached."""
    style = F.coalesce(F.create_map(*[F.lit(x) for kv in SORT_STYLES.items() for x in kv])[F.col("sort")], F.lit("style=dashed"))
    return sorts.select("graph_id", "edge_id", style.alias("attrs"))


def style_edges(edges: DataFrame, attrs: str = "color=magenta") -> DataFrame:
    """The same attributes for a set of edges, such as a covering."""
    return edges.select("graph_id", "edge_id", F.lit(attrs).alias("attrs"))
