"""Queries over graph tables, depth-first structure and dominance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgraph.operators import dfs, graph
from flowgraph.plans import sql
from flowgraph.sources import derive

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None):
    """Registers a query under a name, with its SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if text:
            SQL[name] = text
        return f

    return add


def _types(g):
    """New nodes for a graph: its kinds of events without the number."""
    return g.nodes.select("graph_id", F.split("info", ":")[0].alias("info")).distinct()


@query("g1_insert", sql.query(sql.USER, "kinds AS (SELECT DISTINCT graph_id, split_part(info, ':', 1) AS info FROM nodes)",
    "last AS (SELECT graph_id, max(node_id) AS m FROM nodes GROUP BY graph_id)", "elast AS (SELECT graph_id, max(edge_id) AS m FROM edges GROUP BY graph_id)",
    "added AS (SELECT k.graph_id, m + row_number() OVER (PARTITION BY k.graph_id ORDER BY info) AS node_id, info FROM kinds k JOIN last USING (graph_id))",
    "alln AS (SELECT graph_id, node_id, info FROM nodes UNION ALL SELECT * FROM added)",
    select="""SELECT graph_id, coalesce(m, -1) + row_number() OVER (PARTITION BY graph_id ORDER BY src) AS edge_id, src, dst FROM (
  SELECT a.graph_id, a.node_id AS src, start AS dst, m FROM alln a JOIN starts USING (graph_id) LEFT JOIN elast USING (graph_id))
UNION ALL SELECT graph_id, edge_id, src, dst FROM edges"""))
def g1_insert(spark, sf_dir):
    """A node for each kind of event and an edge from every node back to the start."""
    g = derive.user_graph(spark, sf_dir)
    g = graph.insert_nodes(g, _types(g), ["info"])
    rows = g.nodes.join(g.starts, "graph_id").select("graph_id", F.col("node_id").alias("src"), F.col("start").alias("dst"), F.lit("back").alias("info"))
    return graph.insert_edges(g, rows, ["src"]).edges.select("graph_id", "edge_id", "src", "dst")


@query("g2_delete_edges", sql.query(sql.USER, select="SELECT graph_id, edge_id, src, dst FROM edges WHERE src <> dst"))
def g2_delete_edges(spark, sf_dir):
    """Without self loops."""
    return graph.delete_edges(derive.user_graph(spark, sf_dir), F.col("src") == F.col("dst")).edges.select("graph_id", "edge_id", "src", "dst")


@query("g3_delete_nodes", sql.query(sql.USER, "gone AS (SELECT graph_id, node_id FROM nodes WHERE info LIKE 'error:%')",
    select="""SELECT graph_id, edge_id, src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.graph_id = e.graph_id AND gone.node_id IN (e.src, e.dst))"""))
def g3_delete_nodes(spark, sf_dir):
    """Without the nodes of errors."""
    return graph.delete_nodes(derive.user_graph(spark, sf_dir), F.col("info").startswith("error:")).edges.select("graph_id", "edge_id", "src", "dst")


@query("g4_replace_info", sql.query(sql.USER, select="SELECT graph_id, node_id, CASE WHEN node_id = start THEN 'start' ELSE info END AS info FROM nodes JOIN starts USING (graph_id)"))
def g4_replace_info(spark, sf_dir):
    """With the start's label changed."""
    g = derive.user_graph(spark, sf_dir)
    new = g.starts.select("graph_id", F.col("start").alias("node_id"), F.lit("start").alias("info"))
    return graph.replace_info(g.nodes, new, ["graph_id", "node_id"])[0]


_COMPACT = "c AS (SELECT graph_id, node_id, row_number() OVER (PARTITION BY graph_id ORDER BY node_id DESC) - 1 AS n FROM nodes)"


@query("g5_compact_ids", sql.query(sql.USER_DROP, _COMPACT, select="""SELECT e.graph_id, row_number() OVER (PARTITION BY e.graph_id ORDER BY edge_id DESC) - 1 AS edge_id, a.n AS src, b.n AS dst
FROM edges e JOIN c a ON a.graph_id = e.graph_id AND a.node_id = e.src JOIN c b ON b.graph_id = e.graph_id AND b.node_id = e.dst"""))
def g5_compact_ids(spark, sf_dir):
    return graph.compact_ids(derive.user_drop_graph(spark, sf_dir)).edges.select("graph_id", "edge_id", "src", "dst")


@query("g6_graph_stats", sql.query(sql.ORDER, select="""SELECT graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges, next_node, coalesce(next_edge, 0) AS next_edge
FROM (SELECT graph_id, count(*) AS n_nodes, max(node_id) + 1 AS next_node FROM nodes GROUP BY graph_id)
LEFT JOIN (SELECT graph_id, count(*) AS n_edges, max(edge_id) + 1 AS next_edge FROM edges GROUP BY graph_id) USING (graph_id)"""))
def g6_graph_stats(spark, sf_dir):
    return graph.graph_stats(derive.order_graph(spark, sf_dir))


@query("g7_adjacency", sql.query(sql.USER, select="""SELECT n.graph_id, n.node_id, coalesce(o.d, 0) AS out_degree, coalesce(i.d, 0) AS in_degree, coalesce(o.ids, '') AS out_edges, coalesce(i.ids, '') AS in_edges
FROM nodes n LEFT JOIN (SELECT graph_id, src, count(*) AS d, string_agg(edge_id, ',' ORDER BY edge_id DESC) AS ids FROM edges GROUP BY ALL) o ON o.graph_id = n.graph_id AND o.src = n.node_id
LEFT JOIN (SELECT graph_id, dst, count(*) AS d, string_agg(edge_id, ',' ORDER BY edge_id DESC) AS ids FROM edges GROUP BY ALL) i ON i.graph_id = n.graph_id AND i.dst = n.node_id"""))
def g7_adjacency(spark, sf_dir):
    rows = graph.adjacency(derive.user_graph(spark, sf_dir))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("out_edges", "in_edges")})


@query("g8_pred_succ", sql.query(sql.USER, select="SELECT DISTINCT graph_id, src, dst FROM edges"))
def g8_pred_succ(spark, sf_dir):
    return graph.pred_succ(derive.user_graph(spark, sf_dir))


@query("g9_single_exit", sql.query(sql.ORDER, "ex AS (SELECT graph_id, node_id FROM nodes ANTI JOIN edges ON edges.graph_id = nodes.graph_id AND src = node_id)",
    "l AS (SELECT graph_id, max(node_id) + 1 AS x FROM nodes GROUP BY graph_id)", "le AS (SELECT graph_id, max(edge_id) AS m FROM edges GROUP BY graph_id)",
    select="""SELECT graph_id, edge_id, src, dst FROM edges UNION ALL
SELECT graph_id, coalesce(m, -1) + row_number() OVER (PARTITION BY graph_id ORDER BY node_id), node_id, x FROM ex JOIN l USING (graph_id) LEFT JOIN le USING (graph_id)"""))
def g9_single_exit(spark, sf_dir):
    return graph.single_exit(derive.order_graph(spark, sf_dir)).edges.select("graph_id", "edge_id", "src", "dst")


@query("d1_reachable_nodes", sql.query(sql.USER_DROP, sql.REACH, select="SELECT graph_id, node_id FROM reach"))
def d1_reachable_nodes(spark, sf_dir):
    return dfs.reachable_nodes(derive.user_drop_graph(spark, sf_dir))


@query("d1_reachable_large", sql.query(sql.PART, sql.REACH, select="SELECT graph_id, node_id FROM reach"))
def d1_reachable_large(spark, sf_dir):
    """In one large graph."""
    return dfs.reachable_nodes(derive.part_graph(spark, sf_dir))


@query("d2_reachable_edges", sql.query(sql.USER_DROP, sql.REACH, select="SELECT e.graph_id, edge_id FROM edges e JOIN reach r ON r.graph_id = e.graph_id AND r.node_id = e.src"))
def d2_reachable_edges(spark, sf_dir):
    return dfs.reachable_edges(derive.user_drop_graph(spark, sf_dir))


@query("d3_d4_dfst", sql.query(sql.USER_DROP, sql.dfs(), select="SELECT graph_id, node_id, pre, rpo FROM tree"))
def d3_d4_dfst(spark, sf_dir):
    """Preorder and reverse postorder."""
    return dfs.dfst(derive.user_drop_graph(spark, sf_dir)).select("graph_id", "node_id", "pre", "rpo")


_SORTS = """SELECT e.graph_id, e.edge_id, CASE WHEN s.pre IS NULL THEN NULL WHEN d.parent_edge = e.edge_id THEN 'tree' WHEN s.pre < d.pre THEN 'forward'
  WHEN d.rpo <= s.rpo THEN 'back' ELSE 'cross' END AS sort
FROM edges e LEFT JOIN tree s ON s.graph_id = e.graph_id AND s.node_id = e.src LEFT JOIN tree d ON d.graph_id = e.graph_id AND d.node_id = e.dst"""


@query("d5_edge_sorts", sql.query(sql.USER_DROP, sql.dfs(), select=_SORTS))
def d5_edge_sorts(spark, sf_dir):
    g = derive.user_drop_graph(spark, sf_dir)
    return dfs.edge_sorts(g, dfs.dfst(g))


@query("d6_dfst_tree", sql.query(sql.USER_DROP, sql.dfs(), select="SELECT graph_id, node_id, parent, parent_edge FROM tree"))
def d6_dfst_tree(spark, sf_dir):
    return dfs.dfst(derive.user_drop_graph(spark, sf_dir)).select("graph_id", "node_id", "parent", "parent_edge")


@query("d7_dfst_ordered", sql.query(sql.USER_DROP, sql.dfs("dst DESC, edge_id DESC"), select="SELECT graph_id, node_id, pre, rpo, parent_edge FROM tree"))
def d7_dfst_ordered(spark, sf_dir):
    """Out-edges in the order of their targets, the greatest first."""
    return dfs.dfst(derive.user_drop_graph(spark, sf_dir), "dst").select("graph_id", "node_id", "pre", "rpo", "parent_edge")


@query("d8_order_rev", sql.query(sql.USER_DROP, sql.dfs(), select="SELECT graph_id, node_id, max(rpo) OVER (PARTITION BY graph_id) - rpo AS number FROM tree"))
def d8_order_rev(spark, sf_dir):
    """Postorder from reverse postorder, moved by 5 and back."""
    order = dfs.dfst(derive.user_drop_graph(spark, sf_dir)).select("graph_id", "node_id", (F.col("rpo") + 5).alias("number"))
    return graph.order_normalize(graph.order_reverse(order))


@query("d9_order_lookup", sql.query(sql.USER_DROP, sql.dfs(), select="""SELECT n.graph_id, n.node_id AS number, t.node_id FROM nodes n LEFT JOIN tree t ON t.graph_id = n.graph_id AND t.rpo = n.node_id"""))
def d9_order_lookup(spark, sf_dir):
    """The node at each number up to the number of nodes; none beyond the reached ones."""
    g = derive.user_drop_graph(spark, sf_dir)
    order = dfs.dfst(g).select("graph_id", "node_id", F.col("rpo").cast("long").alias("number"))
    return graph.order_lookup(order, g.nodes.select("graph_id", F.col("node_id").alias("number")))


@query("d10_cycle_breakers", sql.query(sql.ORDER, "rooted AS (SELECT graph_id, edge_id, src, dst FROM edges UNION ALL SELECT graph_id, node_id - 1000, -1, node_id FROM nodes)",
    "root AS (SELECT DISTINCT graph_id, CAST(-1 AS BIGINT) AS start FROM nodes)", sql.dfs(edges="rooted", starts="root"),
    select="""SELECT e.graph_id, e.edge_id FROM edges e JOIN tree s ON s.graph_id = e.graph_id AND s.node_id = e.src JOIN tree d ON d.graph_id = e.graph_id AND d.node_id = e.dst
WHERE d.pre <= s.pre AND d.rpo <= s.rpo"""))
def d10_cycle_breakers(spark, sf_dir):
    return dfs.cycle_breakers(derive.order_graph(spark, sf_dir))


@query("m1_idom", sql.query(sql.USER_DROP, sql.DOM, select="SELECT graph_id, node_id, idom FROM idom"))
def m1_idom(spark, sf_dir):
    return dfs.idom(dfs.dfst(derive.user_drop_graph(spark, sf_dir)))


@query("m1_idom_by_joins", sql.query(sql.USER_DROP, sql.DOM, select="SELECT graph_id, node_id, idom FROM idom"))
def m1_idom_by_joins(spark, sf_dir):
    """The form for graphs of any size."""
    return dfs.idom_by_joins(derive.user_drop_graph(spark, sf_dir))


@query("m1_idom_large", sql.query(sql.CUSTOMER, sql.DOM, select="SELECT graph_id, node_id, idom FROM idom"))
def m1_idom_large(spark, sf_dir):
    """In one large graph."""
    return dfs.idom_by_joins(derive.customer_graph(spark, sf_dir))


@query("m2_dom_children", sql.query(sql.USER_DROP, sql.DOM, select="SELECT graph_id, idom AS node_id, string_agg(node_id, ',' ORDER BY node_id) AS children FROM idom WHERE idom IS NOT NULL GROUP BY ALL"))
def m2_dom_children(spark, sf_dir):
    tree = dfs.idom(dfs.dfst(derive.user_drop_graph(spark, sf_dir))).where("idom is not null")
    return tree.groupBy("graph_id", F.col("idom").alias("node_id")).agg(F.array_join(F.sort_array(F.collect_list("node_id")), ",").alias("children"))


@query("m3_dominance_pairs", sql.query(sql.USER_DROP, sql.DOM, select="SELECT graph_id, dominator, node_id FROM dom"))
def m3_dominance_pairs(spark, sf_dir):
    return dfs.dominance_pairs(dfs.dfst(derive.user_drop_graph(spark, sf_dir))).drop("distance")


@query("m4_dominators", sql.query(sql.USER_DROP, sql.DOM, select="""SELECT dom.graph_id, dom.node_id, dominator, row_number() OVER (PARTITION BY dom.graph_id, dom.node_id ORDER BY depth DESC) AS rank
FROM dom JOIN depth ON depth.graph_id = dom.graph_id AND depth.node_id = dominator WHERE dominator <> dom.node_id"""))
def m4_dominators(spark, sf_dir):
    return dfs.dominators(dfs.dfst(derive.user_drop_graph(spark, sf_dir)))


@query("a1_maximal_alt", sql.query(sql.USER_DROP, sql.DOM, "h AS (SELECT graph_id, max(node_id) AS header FROM reach GROUP BY graph_id)",
    select="SELECT graph_id, header, node_id FROM dom JOIN h USING (graph_id) WHERE dominator = header"))
def a1_maximal_alt(spark, sf_dir):
    """Of the last reached node of each graph, by joins alone."""
    g = derive.user_drop_graph(spark, sf_dir)
    return dfs.maximal_alt(g, dfs.reachable_nodes(g).groupBy("graph_id").agg(F.max("node_id").alias("header")))


@query("a2_alt_tree", sql.query(sql.USER_DROP, sql.DOM, select="""SELECT graph_id, node_id AS header, idom AS outer, depth, size FROM idom JOIN depth USING (graph_id, node_id)
JOIN (SELECT graph_id, dominator AS node_id, count(*) AS size FROM dom GROUP BY ALL) USING (graph_id, node_id)""".replace(" AS outer", ' AS "outer"')))
def a2_alt_tree(spark, sf_dir):
    return dfs.alt_tree(dfs.dfst(derive.user_drop_graph(spark, sf_dir)))


@query("a3_subtree_members", sql.query(sql.USER_DROP, sql.dfs(), "up AS (SELECT graph_id, node_id AS top, node_id FROM tree UNION SELECT u.graph_id, t.parent, u.node_id FROM up u JOIN tree t ON t.graph_id = u.graph_id AND t.node_id = u.top WHERE t.parent IS NOT NULL)",
    select="SELECT graph_id, top, node_id FROM up"))
def a3_subtree_members(spark, sf_dir):
    """Of the depth-first tree."""
    return dfs.subtree_members(dfs.dfst(derive.user_drop_graph(spark, sf_dir)).select("graph_id", "node_id", "parent"))
