"""Graphs derived from the tables of events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgraph.model import Graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    node = F.concat("event_type", F.lit(":"), (k % 4).cast("string"))
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", k.alias("k"), node.alias("node"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows (graph_id, node, ...) with node_id: the nodes of a graph in the order of their names, from 0."""
    place = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("node")).cast("long") - 1
    return rows.where("graph_id is not null and node is not null").withColumn("node_id", place)


def walk(rows: DataFrame, order: list[str], edge_id: str) -> Graph:
    """rows (graph_id, node_id, node, edge_id and order columns): an edge for each two rows that follow each other."""
    w = Window.partitionBy("graph_id").orderBy(*order)
    step = rows.withColumns({"dst": F.lead("node_id").over(w), "at": F.row_number().over(w)})
    edges = step.where("dst is not null").select("graph_id", F.col(edge_id).alias("edge_id"), F.col("node_id").alias("src"), "dst", F.lit("").alias("info"))
    nodes = rows.select("graph_id", "node_id", F.col("node").alias("info")).distinct()
    return Graph(nodes, edges, step.where("at = 1").select("graph_id", F.col("node_id").alias("start")))


def user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_events(spark, sf_dir).withColumnRenamed("user_id", "graph_id"))


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph for each user: kinds of events, an edge from each event to the next."""
    return walk(user_rows(spark, sf_dir), ["ts", "event_id"], "event_id")


def user_drop_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The users' graphs without every third edge, so that parts are not reached."""
    g = user_graph(spark, sf_dir)
    return g.with_(edges=g.edges.where("edge_id % 3 <> 0"))


def day_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph for each user and day of the month."""
    rows = _events(spark, sf_dir).withColumn("graph_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return walk(numbered(rows), ["ts", "event_id"], "event_id")


_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph for each order: part keys modulo 7, an edge from each line to the next."""
    lines = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_LINES)
    rows = lines.select(F.col("l_orderkey").alias("graph_id"), (F.col("l_partkey") % 7).alias("node_id"), (F.col("l_partkey") % 7).cast("string").alias("node"), F.row_number().over(w).cast("long").alias("at"))
    return walk(rows, ["at"], "at")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """One large graph: parts, an edge for each two lines of an order that follow each other; it starts at the least part."""
    lines = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*_LINES)
    step = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.row_number().over(w).cast("long").alias("at"))
    zero = F.lit(0).cast("long").alias("graph_id")
    edges = step.where("dst is not null").select(zero, (F.col("o") * 1000 + F.col("at")).alias("edge_id"), "src", "dst", F.lit("").alias("info"))
    nodes = lines.select(zero, F.col("l_partkey").alias("node_id"), F.lit("").alias("info")).distinct()
    return Graph(nodes, edges, lines.agg(F.min("l_partkey").alias("start")).select(zero, "start"))


def customer_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """One large graph with branches, chains and circles: customers, an edge from each order's to the next order's of its day and priority; it starts at the least customer."""
    orders = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_orderpriority", F.to_date("o_orderdate")).orderBy("o_orderkey")
    step = orders.select("o_orderkey", F.col("o_custkey").alias("src"), F.lead("o_custkey").over(w).alias("dst"))
    zero = F.lit(0).cast("long").alias("graph_id")
    edges = step.where("dst is not null").select(zero, F.col("o_orderkey").alias("edge_id"), "src", "dst", F.lit("").alias("info"))
    nodes = orders.select(zero, F.col("o_custkey").alias("node_id"), F.lit("").alias("info")).distinct()
    return Graph(nodes, edges, orders.agg(F.min("o_custkey").alias("start")).select(zero, "start"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, node_id, stmt_id, pos, writes, reads): one statement for each event in its node of the users' graphs."""
    rows = user_rows(spark, sf_dir)
    x = F.floor("value").cast("int") % 6
    var, other = F.concat(F.lit("v"), x.cast("string")), F.concat(F.lit("v"), ((x + 1) % 6).cast("string"))
    none = F.array().cast("array<string>")
    writes = F.when(F.col("event_type").isin("purchase", "signup"), F.array(var)).otherwise(none)
    reads = F.when(F.col("event_type") == "purchase", F.array(other)).when(F.col("event_type").isin("click", "view"), F.array(var)).otherwise(none)
    pos = F.row_number().over(Window.partitionBy("graph_id", "node_id").orderBy("event_id"))
    return rows.select("graph_id", "node_id", F.col("event_id").alias("stmt_id"), pos.alias("pos"), writes.alias("writes"), reads.alias("reads"))
