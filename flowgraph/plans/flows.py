"""Queries over data flow, dependence and points-to, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgraph.functions import facts
from flowgraph.operators import dataflow, depend, pointsto
from flowgraph.plans import sql
from flowgraph.plans.graphs import query
from flowgraph.sources import derive

_GK = sql.STMTS + """,
wr AS (SELECT graph_id, node_id, w AS var, min(pos) AS first, arg_max(stmt_id, pos) AS stmt_id FROM stmts WHERE w IS NOT NULL GROUP BY ALL),
rd AS (SELECT s.graph_id, s.node_id, s.stmt_id, r AS var FROM stmts s LEFT JOIN wr ON wr.graph_id = s.graph_id AND wr.node_id = s.node_id AND wr.var = s.r WHERE r IS NOT NULL AND (first IS NULL OR pos <= first)),
uses AS (SELECT DISTINCT graph_id, node_id, var FROM rd)"""
_LIVE = """live AS (SELECT graph_id, node_id, var FROM uses UNION SELECT l.graph_id, e.src, l.var FROM live l JOIN edges e ON e.graph_id = l.graph_id AND e.dst = l.node_id
  LEFT JOIN wr ON wr.graph_id = l.graph_id AND wr.node_id = e.src AND wr.var = l.var WHERE wr.var IS NULL)"""
_DEFS = """defs AS (SELECT graph_id, node_id, stmt_id, var FROM wr UNION SELECT d.graph_id, e.dst, d.stmt_id, d.var FROM defs d JOIN edges e ON e.graph_id = d.graph_id AND e.src = d.node_id
  LEFT JOIN wr ON wr.graph_id = d.graph_id AND wr.node_id = e.dst AND wr.var = d.var WHERE wr.var IS NULL)"""


def _case(spark, sf_dir):
    return derive.user_graph(spark, sf_dir), derive.statements(spark, sf_dir)


@query("f1_gen_kill", sql.query(sql.USER, _GK, select="SELECT graph_id, node_id, var, 'use' AS kind, CAST(NULL AS BIGINT) AS stmt_id FROM uses UNION ALL SELECT graph_id, node_id, var, 'def', stmt_id FROM wr"))
def f1_gen_kill(spark, sf_dir):
    parts = dataflow.gen_kill(derive.statements(spark, sf_dir))
    uses = parts["uses"].select("graph_id", "node_id", "var", F.lit("use").alias("kind"), F.lit(None).cast("long").alias("stmt_id"))
    return uses.union(parts["defs"].select("graph_id", "node_id", "var", F.lit("def"), "stmt_id"))


@query("f2_f5_reaching_defs", sql.query(sql.USER, _GK, _DEFS, select="SELECT e.graph_id, edge_id, stmt_id, var FROM edges e JOIN defs d ON d.graph_id = e.graph_id AND d.node_id = e.src"))
def f2_f5_reaching_defs(spark, sf_dir):
    """The definitions that reach each edge."""
    g, stmts = _case(spark, sf_dir)
    return dataflow.on_edges(g, dataflow.reaching_defs(g, stmts))


@query("f3_f6_live_vars", sql.query(sql.USER, _GK, _LIVE, select="SELECT e.graph_id, edge_id, var FROM edges e JOIN live l ON l.graph_id = e.graph_id AND l.node_id = e.dst"))
def f3_f6_live_vars(spark, sf_dir):
    """The variables live on each edge."""
    g, stmts = _case(spark, sf_dir)
    return dataflow.on_edges(g, dataflow.live_vars(g, stmts), "backward")


@query("f4_bidirectional", sql.query(sql.USER, _GK, """both AS (SELECT graph_id, node_id, var FROM uses UNION SELECT b.graph_id, n.node_id, b.var FROM both b
  JOIN (SELECT graph_id, src AS a, dst AS node_id FROM edges UNION SELECT graph_id, dst, src FROM edges) n ON n.graph_id = b.graph_id AND n.a = b.node_id
  LEFT JOIN wr ON wr.graph_id = b.graph_id AND wr.node_id = n.node_id AND wr.var = b.var WHERE wr.var IS NULL)""".replace("both ", "both_ ").replace("both b", "both_ b"), select="SELECT graph_id, node_id, var FROM both_"))
def f4_bidirectional(spark, sf_dir):
    """Uses that spread along and against edges up to the nodes that write their variable."""
    g, stmts = _case(spark, sf_dir)
    parts = dataflow.gen_kill(stmts)
    return dataflow.solve(g, parts["uses"], parts["kill"], "both")


@query("f7_upward_exposed", sql.query(sql.USER, _GK, """exposed AS (SELECT graph_id, node_id, stmt_id, var FROM rd UNION SELECT l.graph_id, e.src, l.stmt_id, l.var FROM exposed l JOIN edges e ON e.graph_id = l.graph_id AND e.dst = l.node_id
  LEFT JOIN wr ON wr.graph_id = l.graph_id AND wr.node_id = e.src AND wr.var = l.var WHERE wr.var IS NULL)""", select="SELECT graph_id, node_id, stmt_id, var FROM exposed"))
def f7_upward_exposed(spark, sf_dir):
    """Uses that each node's begin can see."""
    return dataflow.upward_exposed(*_case(spark, sf_dir))


_ALL = """universe AS (SELECT DISTINCT graph_id, var FROM uses),
every AS (SELECT n.graph_id, n.node_id, var FROM nodes n JOIN universe USING (graph_id)),
missing AS (SELECT v.graph_id, v.node_id, v.var FROM every v ANTI JOIN uses u ON u.graph_id = v.graph_id AND u.node_id = v.node_id AND u.var = v.var
    WHERE EXISTS (SELECT 1 FROM wr WHERE wr.graph_id = v.graph_id AND wr.node_id = v.node_id AND wr.var = v.var) OR NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph_id = v.graph_id AND e.src = v.node_id)
  UNION SELECT m.graph_id, e.src, m.var FROM missing m JOIN edges e ON e.graph_id = m.graph_id AND e.dst = m.node_id
  LEFT JOIN uses u ON u.graph_id = m.graph_id AND u.node_id = e.src AND u.var = m.var WHERE u.var IS NULL)"""


@query("f7_f8_exposed_all", sql.query(sql.USER, _GK, _ALL, select="SELECT v.graph_id, v.node_id, v.var FROM every v ANTI JOIN missing m ON m.graph_id = v.graph_id AND m.node_id = v.node_id AND m.var = v.var"))
def f7_f8_exposed_all(spark, sf_dir):
    """Variables that every way on reads first: a problem with intersection as meet."""
    return dataflow.upward_exposed(*_case(spark, sf_dir), mode="all")


@query("f8_fact_state", sql.query(sql.USER, _GK, _LIVE, select="SELECT n.graph_id, n.node_id, 'v0' AS var, EXISTS (SELECT 1 FROM live l WHERE l.graph_id = n.graph_id AND l.node_id = n.node_id AND l.var = 'v0') AS holds FROM nodes n"))
def f8_fact_state(spark, sf_dir):
    """Whether v0 is live before each node."""
    g, stmts = _case(spark, sf_dir)
    return dataflow.fact_state(dataflow.live_vars(g, stmts), g.nodes.select("graph_id", "node_id", F.lit("v0").alias("var")))


@query("f9_statement_predicates", sql.query(sql.USER, sql.STMTS, select="SELECT graph_id, stmt_id, coalesce(w = 'v1', false) AS writes_v1, coalesce(r = 'v1', false) AS reads_v1, coalesce(w, '') = coalesce(lag(w, 1, w) OVER (PARTITION BY graph_id, node_id ORDER BY pos), '') AS same_as_last FROM stmts"))
def f9_statement_predicates(spark, sf_dir):
    from pyspark.sql import Window

    last = F.lag("writes").over(Window.partitionBy("graph_id", "node_id").orderBy("pos"))
    rows = derive.statements(spark, sf_dir).withColumn("last", F.coalesce(last, "writes"))
    return rows.select("graph_id", "stmt_id", dataflow.writes_variable("v1").alias("writes_v1"), dataflow.reads_variable("v1").alias("reads_v1"), dataflow.same_target(F.col("writes"), F.col("last")).alias("same_as_last"))


_SETS = """sets AS (SELECT graph_id, node_id, list_sort(list_distinct(list(w) FILTER (w IS NOT NULL))) AS a, list_sort(list_distinct(list(r) FILTER (r IS NOT NULL))) AS b FROM stmts GROUP BY ALL),
s AS (SELECT graph_id, node_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM sets)"""


def _sets(spark, sf_dir):
    rows = derive.statements(spark, sf_dir).groupBy("graph_id", "node_id").agg(F.flatten(F.collect_list("writes")).alias("a"), F.flatten(F.collect_list("reads")).alias("b"))
    return rows.select("graph_id", "node_id", F.array_distinct("a").alias("a"), F.array_distinct("b").alias("b"))


@query("s1_facts_meet", sql.query(sql.USER, sql.STMTS, _SETS, select="SELECT graph_id, node_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS united, array_to_string(list_sort(list_intersect(a, b)), ',') AS common FROM s"))
def s1_facts_meet(spark, sf_dir):
    """Of the variables that a node writes and reads."""
    a, b = F.col("a"), F.col("b")
    return _sets(spark, sf_dir).select("graph_id", "node_id", F.array_join(facts.facts_meet(a, b), ",").alias("united"), F.array_join(facts.facts_meet(a, b, "intersect"), ",").alias("common"))


@query("s2_facts_compare", sql.query(sql.USER, sql.STMTS, _SETS, select="SELECT graph_id, node_id, CASE WHEN list_has_all(b, a) AND list_has_all(a, b) THEN 0 WHEN list_has_all(b, a) THEN -1 WHEN list_has_all(a, b) THEN 1 END AS compared, list_has_all(b, a) AND NOT list_has_all(a, b) AS less, list_has_all(a, b) AS at_least FROM s"))
def s2_facts_compare(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _sets(spark, sf_dir).select("graph_id", "node_id", facts.facts_compare(a, b).alias("compared"), facts.less(a, b).alias("less"), facts.greater(a, b, True).alias("at_least"))


_REFS = """refs AS (SELECT l_orderkey AS loop_id, l_suppkey % 3 AS arr, l_linenumber AS coeff, CAST(l_quantity AS BIGINT) AS free, CASE WHEN l_returnflag = 'R' THEN 'w' ELSE 'r' END AS kind,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS ref_id FROM lineitem)"""


def _refs(spark, sf_dir):
    from pyspark.sql import Window

    lines = derive.read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    ref = F.row_number().over(w).cast("long")
    return lines.select(F.col("l_orderkey").alias("loop_id"), ref.alias("stmt_id"), ref.alias("ref_id"), F.when(F.col("l_returnflag") == "R", "w").otherwise("r").alias("kind"), (F.col("l_suppkey") % 3).cast("string").alias("array"), F.col("l_quantity").cast("long").alias("free"), F.create_map(F.lit("i"), F.col("l_linenumber").cast("long")).alias("coeffs"))


@query("e1_flatten_loops", """SELECT CAST(1000000 + r_regionkey AS BIGINT) AS loop_id, CAST(1000000 + r_regionkey AS BIGINT) AS root, 0 AS level, 2 AS depth FROM region
UNION ALL SELECT 2000000 + n_nationkey, 1000000 + n_regionkey, 1, 2 FROM nation UNION ALL SELECT c_custkey, 1000000 + n_regionkey, 2, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def e1_flatten_loops(spark, sf_dir):
    """Loops over regions, their nations and their customers."""
    r, n, c = (derive.read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    loops = r.select((F.col("r_regionkey") + 1000000).cast("long").alias("loop_id"), F.lit(None).cast("long").alias("parent_loop"))
    loops = loops.union(n.select((F.col("n_nationkey") + 2000000).cast("long"), (F.col("n_regionkey") + 1000000).cast("long"))).union(c.select(F.col("c_custkey").cast("long"), (F.col("c_nationkey") + 2000000).cast("long")))
    return depend.flatten_loops(loops)


@query("e2_reference_pairs", sql.query(_REFS, select="SELECT a.loop_id, a.ref_id AS ref_id_1, b.ref_id AS ref_id_2 FROM refs a JOIN refs b ON b.loop_id = a.loop_id AND b.arr = a.arr WHERE a.kind = 'w' AND b.kind = 'r'"))
def e2_reference_pairs(spark, sf_dir):
    return depend.reference_pairs(_refs(spark, sf_dir)).select("loop_id", "ref_id_1", "ref_id_2")


_POSSIBLE = "CASE WHEN a.coeff = b.coeff THEN a.free = b.free ELSE (b.free - a.free) % abs(a.coeff - b.coeff) = 0 END"


@query("e3_gcd_test", sql.query(_REFS, select=f"""SELECT a.loop_id, a.ref_id AS ref_id_1, b.ref_id AS ref_id_2, {_POSSIBLE} AS possible, true AS exact,
  CASE WHEN a.coeff = b.coeff AND a.coeff <> 0 AND a.free = b.free THEN CAST(0 AS BIGINT) END AS distance
FROM refs a JOIN refs b ON b.loop_id = a.loop_id AND b.arr = a.arr WHERE a.kind = 'w' AND b.kind = 'r'"""))
def e3_gcd_test(spark, sf_dir):
    return depend.gcd_test(depend.reference_pairs(_refs(spark, sf_dir))).select("loop_id", "ref_id_1", "ref_id_2", "possible", "exact", "distance")


@query("e4_dependence_graph", sql.query(_REFS, select=f"""SELECT a.loop_id, a.ref_id AS from_stmt, b.ref_id AS to_stmt,
  CASE a.kind || b.kind WHEN 'wr' THEN 'true' WHEN 'rw' THEN 'anti' WHEN 'ww' THEN 'output' ELSE 'input' END AS type, CAST(1 AS BIGINT) AS n
FROM refs a JOIN refs b ON b.loop_id = a.loop_id AND b.arr = a.arr AND a.ref_id < b.ref_id WHERE {_POSSIBLE}"""))
def e4_dependence_graph(spark, sf_dir):
    return depend.dependence_graph(_refs(spark, sf_dir))


def _bounds(spark, sf_dir):
    lines = derive.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("loop_id")).agg(F.min(F.col("l_quantity").cast("long")).alias("lower"), F.max(F.col("l_quantity").cast("long")).alias("upper"))
    return lines.withColumn("step", F.lit(3).cast("long"))


@query("e5_iteration_points", sql.query("b AS (SELECT l_orderkey AS loop_id, min(CAST(l_quantity AS BIGINT)) AS lo, max(CAST(l_quantity AS BIGINT)) AS hi FROM lineitem GROUP BY ALL)",
    select="SELECT loop_id, point, CASE WHEN point + 3 <= hi THEN point + 3 END AS next FROM (SELECT loop_id, hi, unnest(range(lo, hi + 1, 3)) AS point FROM b)"))
def e5_iteration_points(spark, sf_dir):
    loops = _bounds(spark, sf_dir)
    return depend.next_point(depend.iteration_points(loops), loops)


_CLASSES = _REFS + """,
classes AS (SELECT loop_id, arr, kind, coeff, free, min(ref_id) AS class_id, count(*) AS n FROM refs GROUP BY ALL)"""


@query("e2_class_pairs", sql.query(_CLASSES, select="SELECT a.loop_id, a.class_id AS class_id_1, b.class_id AS class_id_2, a.n * b.n AS n FROM classes a JOIN classes b ON b.loop_id = a.loop_id AND b.arr = a.arr WHERE a.kind = 'w' AND b.kind = 'r'"))
def e2_class_pairs(spark, sf_dir):
    """Pairs of classes of equal references, with the pairs they stand for."""
    return depend.class_pairs(depend.reference_classes(_refs(spark, sf_dir))[0]).select("loop_id", "class_id_1", "class_id_2", "n")


@query("e2_class_members", sql.query(_CLASSES, select="SELECT r.loop_id, r.ref_id, c.class_id FROM refs r JOIN classes c USING (loop_id, arr, kind, coeff, free)"))
def e2_class_members(spark, sf_dir):
    return depend.reference_classes(_refs(spark, sf_dir))[1]


#: Classes of references in iterations from the least to the greatest quantity of the order by threes, and where two of them meet.
_CARRIED = _CLASSES + """,
b AS (SELECT l_orderkey AS loop_id, min(CAST(l_quantity AS BIGINT)) AS lo, max(CAST(l_quantity AS BIGINT)) AS hi FROM lineitem GROUP BY ALL),
met AS (SELECT x.loop_id, x.class_id AS c1, y.class_id AS c2, x.kind AS k1, y.kind AS k2, CASE WHEN x.class_id = y.class_id THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS n, 3 * x.coeff AS a, 3 * y.coeff AS b, (hi - lo) // 3 AS t, y.free + y.coeff * lo - x.free - x.coeff * lo AS need
  FROM classes x JOIN classes y ON y.loop_id = x.loop_id AND y.arr = x.arr JOIN b ON b.loop_id = x.loop_id
  WHERE (x.kind = 'w' AND y.kind = 'r') OR (x.kind = y.kind AND (x.class_id < y.class_id OR (x.class_id = y.class_id AND x.n > 1)))),
told AS (SELECT *, need % gcd(a, b) = 0 AND need BETWEEN -b * t AND a * t AS possible, CASE WHEN a = b THEN -need // a END AS d FROM met)"""


@query("e3_carried", sql.query(_CARRIED, select="""SELECT loop_id, c1 AS class_id_1, c2 AS class_id_2, possible, NOT possible OR a = b AS exact, CASE WHEN possible THEN d END AS distance,
  CASE WHEN possible THEN CASE WHEN d > 0 THEN '<' WHEN d = 0 THEN '=' WHEN d < 0 THEN '>' ELSE '*' END END AS direction FROM told WHERE k1 = 'w' AND k2 = 'r'"""))
def e3_carried(spark, sf_dir):
    """Whether writes and reads of different iterations meet, and how many iterations apart."""
    pairs = depend.class_pairs(depend.reference_classes(_refs(spark, sf_dir))[0])
    found = depend.carried_test(pairs, _bounds(spark, sf_dir).withColumns({"ivar": F.lit("i"), "level": F.lit(0)}))
    return found.select("loop_id", "class_id_1", "class_id_2", "possible", "exact", F.col("distances")["i"].alias("distance"), "direction")


@query("e4_carried", sql.query(_CARRIED, select="""SELECT loop_id, CASE WHEN d < 0 THEN c2 ELSE c1 END AS from_class, CASE WHEN d < 0 THEN c1 ELSE c2 END AS to_class,
  CASE CASE WHEN d < 0 THEN k2 || k1 ELSE k1 || k2 END WHEN 'wr' THEN 'true' WHEN 'rw' THEN 'anti' WHEN 'ww' THEN 'output' ELSE 'input' END AS type,
  CASE WHEN d = 0 THEN '=' WHEN d IS NULL THEN '*' ELSE '<' END AS direction, abs(d) AS distance, n FROM told WHERE possible"""))
def e4_carried(spark, sf_dir):
    """Dependences of all kinds between iterations."""
    found = depend.carried_dependences(_refs(spark, sf_dir), _bounds(spark, sf_dir).withColumns({"ivar": F.lit("i"), "level": F.lit(0)}))
    return found.withColumn("distance", F.col("distance")["i"])


def _nest(spark, sf_dir):
    """A nest of two loops for each order: by its lines' numbers, and inside by twos from the number of lines down."""
    lines = derive.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("o")).agg(F.min("l_linenumber").cast("long").alias("a"), F.max("l_linenumber").cast("long").alias("b"), F.count("*").alias("n"))
    none, long = F.lit(None).cast("long"), lambda x: F.lit(x).cast("long")
    outer = lines.select((F.col("o") * 2).alias("loop_id"), none.alias("parent_loop"), F.col("a").alias("lower"), F.col("b").alias("upper"), long(1).alias("step"))
    return outer.union(lines.select(F.col("o") * 2 + 1, F.col("o") * 2, "n", long(0), long(-2)))


@query("e5_nest_points", sql.query("b AS (SELECT CAST(l_orderkey AS BIGINT) AS o, CAST(min(l_linenumber) AS BIGINT) AS a, CAST(max(l_linenumber) AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY ALL)",
    "outer_ AS (SELECT o, n, b, unnest(range(a, b + 1)) AS x FROM b)", "inner_ AS (SELECT o, b, x, unnest(range(n, -1, -2)) AS y FROM outer_)",
    select="""SELECT o * 2 AS loop_id, CAST(x AS VARCHAR) AS point, CASE WHEN x + 1 <= b THEN CAST(x + 1 AS VARCHAR) END AS outer_next, CAST(NULL AS VARCHAR) AS inner_next FROM outer_
UNION ALL SELECT o * 2 + 1, x || ',' || y, CASE WHEN x + 1 <= b THEN (x + 1) || ',' || y END, CASE WHEN y - 2 >= 0 THEN x || ',' || (y - 2) END FROM inner_"""))
def e5_nest_points(spark, sf_dir):
    """Points of all loops of the nests, and the next ones along either variable."""
    points = depend.range_points(depend.nest_ranges(_nest(spark, sf_dir)))
    points = points.withColumns({"outer_next": depend.range_next(0), "inner_next": depend.range_next(1)})
    return points.select("loop_id", *(F.array_join(c, ",").alias(c) for c in ("point", "outer_next", "inner_next")))


def _regions(spark, sf_dir):
    """The world, its regions and their nations."""
    r, n = derive.read(spark, sf_dir, "region"), derive.read(spark, sf_dir, "nation")
    edges = r.select(F.lit(0).cast("long").alias("super"), (F.col("r_regionkey") + 1).cast("long").alias("sub")).union(n.select((F.col("n_regionkey") + 1).cast("long"), (F.col("n_nationkey") + 100).cast("long")))
    return edges.select(F.col("super").alias("region_id")).union(edges.select("sub")).distinct(), edges


def _customers(spark, sf_dir):
    """A static simple block for each customer, in the nation's region."""
    c = derive.read(spark, sf_dir, "customer")
    return c.select(F.lit(0).cast("long").alias("graph_id"), F.col("c_custkey").cast("long").alias("block_id"), (F.col("c_nationkey") + 100).cast("long").alias("region_id"), F.lit("simple").alias("kind"), F.lit("static").alias("alloc"), F.lit(None).cast("long").alias("parent_block"), F.lit(None).cast("int").alias("pos"))


@query("x1_subregions", """WITH RECURSIVE e AS (SELECT CAST(0 AS BIGINT) AS a, CAST(r_regionkey + 1 AS BIGINT) AS b FROM region UNION ALL SELECT n_regionkey + 1, n_nationkey + 100 FROM nation),
r AS (SELECT a AS super, a AS sub FROM e UNION SELECT b, b FROM e UNION SELECT r.super, e.b FROM r JOIN e ON e.a = r.sub) SELECT super, sub FROM r""")
def x1_subregions(spark, sf_dir):
    return pointsto.subregions(*_regions(spark, sf_dir))


def _order_types(spark, sf_dir):
    """The order's root and a part for each of its lines; lines are alike, so their number makes the tree."""
    lines = derive.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("owner")).agg(F.count("*").cast("int").alias("n"))
    rows = lines.select("owner", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("nth"))
    path, kind = F.when(F.col("nth") < 0, F.array().cast("array<int>")).otherwise(F.array("nth")), F.when(F.col("nth") < 0, "compound").otherwise("simple")
    return rows.select("owner", F.lit(0).cast("long").alias("region_id"), F.lit("static").alias("alloc"), path.alias("path"), kind.alias("kind"))


_BLOCKS = """n AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT o * 1000000 AS block_id, 'compound' AS kind, CAST(NULL AS BIGINT) AS parent_block, CAST(NULL AS INT) AS pos FROM n
  UNION ALL SELECT o * 1000000 + i + 1, 'simple', o * 1000000, CAST(i AS INT) FROM (SELECT o, unnest(range(n)) AS i FROM n))"""


@query("x2_allocate_blocks", sql.query(_BLOCKS, select="SELECT block_id, kind, parent_block, pos FROM b"))
def x2_allocate_blocks(spark, sf_dir):
    """A compound block for each order with a part for each line."""
    return pointsto.allocate_blocks(_order_types(spark, sf_dir)).select("block_id", "kind", "parent_block", "pos")


@query("x3_block_relation", sql.query(_BLOCKS, select="SELECT block_id AS a, block_id + 1 AS b, CASE WHEN kind = 'compound' THEN 'containing' ELSE 'different' END AS relation FROM b UNION ALL SELECT block_id, parent_block, 'nested' FROM b WHERE pos >= 0 UNION ALL SELECT block_id, block_id, 'same' FROM b"))
def x3_block_relation(spark, sf_dir):
    """Of each block with the one of the next id, with the one around it and with itself."""
    blocks = pointsto.allocate_blocks(_order_types(spark, sf_dir))
    a = F.col("block_id").alias("a")
    pairs = blocks.select(a, (F.col("block_id") + 1).alias("b")).union(blocks.where("parent_block is not null").select(a, "parent_block")).union(blocks.select(a, "block_id"))
    return pointsto.block_relation(pairs, blocks)


_STATE = "st AS (SELECT c_nationkey + 100 AS region_id, c_custkey AS block_id, lead(c_custkey, 1, -1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS v FROM customer)"


def _state(spark, sf_dir):
    """One point; each customer's block holds the next customer of the nation, the last one's is undefined."""
    from pyspark.sql import Window

    w = Window.partitionBy("region_id").orderBy("block_id")
    zero = F.lit(0).cast("long")
    return _customers(spark, sf_dir).select(zero.alias("graph_id"), F.col("region_id").alias("point"), "block_id", F.coalesce(F.lead("block_id").over(w), F.lit(-1)).cast("long").alias("value"))


@query("x4_eval_expr", sql.query(_STATE, select="SELECT DISTINCT region_id AS point, v2 AS value FROM (SELECT a.region_id, a.v AS v2 FROM st a UNION ALL SELECT region_id, -1 FROM st)"))
def x4_eval_expr(spark, sf_dir):
    """At each nation's point: what the nation's customers hold, or undefined."""
    state = _state(spark, sf_dir)
    regions = state.select("graph_id", "point").distinct()
    none = F.lit(None).cast("long")
    base = F.col("point") * 10
    node = lambda k, level, op, a=none, b=none, region=none: regions.select((base + k).alias("expr_id"), F.lit(level).alias("level"), F.lit(op).alias("op"), a.alias("arg1"), b.alias("arg2"), none.alias("block_id"), region.alias("region_id"), F.lit(None).cast("int").alias("field"))
    exprs = node(0, 0, "some", region=F.col("point")).union(node(1, 1, "value", base)).union(node(2, 0, "undef")).union(node(3, 2, "oneof", base + 1, base + 2))
    asked = regions.select("graph_id", "point", (base + 3).alias("expr_id"))
    return pointsto.eval_expr(asked, exprs, state, _customers(spark, sf_dir), pointsto.subregions(*_regions(spark, sf_dir))).select("point", "value")


@query("x5_assign_effect", sql.query(_STATE, "f AS (SELECT region_id, min(block_id) AS t, max(block_id) AS m FROM st GROUP BY ALL)", select="""SELECT region_id AS point, block_id, v AS value FROM st JOIN f USING (region_id) WHERE region_id % 2 = 1 OR block_id <> t
UNION SELECT region_id, t, m FROM f WHERE region_id % 2 = 0 UNION SELECT region_id, t, m FROM f WHERE region_id % 2 = 1 UNION SELECT region_id, m, m FROM f WHERE region_id % 2 = 1"""))
def x5_assign_effect(spark, sf_dir):
    """Nations of even ids replace their first customer's value by the last customer; others may change the first and the last."""
    state = _state(spark, sf_dir)
    ends = state.groupBy("graph_id", "point").agg(F.min("block_id").alias("lo"), F.max("block_id").alias("hi"))
    targets = ends.select("graph_id", "point", F.col("lo").alias("value")).union(ends.where("point % 2 = 1").select("graph_id", "point", "hi"))
    return pointsto.assign_effect(state, targets, ends.select("graph_id", "point", F.col("hi").alias("value")), _customers(spark, sf_dir)).select("point", "block_id", "value")


@query("x6_black_effect", sql.query(_STATE, "mid AS (SELECT region_id, CAST(floor(avg(block_id)) AS BIGINT) AS t FROM st GROUP BY ALL)", "s0 AS (SELECT region_id, min(block_id) AS t FROM st JOIN mid USING (region_id) WHERE block_id >= mid.t GROUP BY ALL)",
    "reach AS (SELECT region_id, t AS block_id FROM s0 UNION SELECT r.region_id, st.v FROM reach r JOIN st ON st.region_id = r.region_id AND st.block_id = r.block_id)",
    select="SELECT region_id AS point, block_id, v AS value FROM st UNION SELECT a.region_id, a.block_id, b.block_id FROM reach a JOIN reach b ON b.region_id = a.region_id WHERE a.block_id >= 0"))
def x6_black_effect(spark, sf_dir):
    """A call in each nation that gets a customer from the middle."""
    state = _state(spark, sf_dir)
    mid = state.groupBy("graph_id", "point").agg(F.floor(F.avg("block_id")).alias("mid"))
    seeds = state.join(mid, ["graph_id", "point"]).where("block_id >= mid").groupBy("graph_id", "point").agg(F.min("block_id").alias("value"))
    return pointsto.black_effect(state, seeds, _customers(spark, sf_dir)).select("point", "block_id", "value")


def _order_blocks(spark, sf_dir):
    """Each order as a graph: a compound block with a part for each line; parts of odd orders are dynamic."""
    blocks = pointsto.allocate_blocks(_order_types(spark, sf_dir))
    order = F.floor(F.col("block_id") / 1_000_000).cast("long")
    return blocks.select(order.alias("graph_id"), *[c for c in blocks.columns if c != "alloc"], F.when((order % 2 == 1) & F.col("parent_block").isNotNull(), "dynamic").otherwise("static").alias("alloc"))


def _order_state(blocks):
    """One point; each part holds the next one, the last one is undefined."""
    from pyspark.sql import Window

    w = Window.partitionBy("graph_id").orderBy("block_id")
    zero = F.lit(0).cast("long")
    return blocks.where("parent_block is not null").select("graph_id", zero.alias("point"), "block_id", F.coalesce(F.lead("block_id").over(w), F.lit(-1)).cast("long").alias("value"))


_ORDER_STATE = _BLOCKS + ", st AS (SELECT parent_block // 1000000 AS g, block_id AS b, pos, lead(block_id, 1, -1) OVER (PARTITION BY parent_block ORDER BY block_id) AS v FROM b WHERE pos >= 0)"


@query("x4_eval_ops", sql.query(_ORDER_STATE, select="""SELECT g AS graph_id, 0 AS k, g * 1000000 AS value FROM st WHERE pos = 0 UNION ALL SELECT g, 1, b FROM st WHERE pos = 0
UNION ALL SELECT g, 2, CASE WHEN g % 7 = 0 THEN -2 ELSE v END FROM st WHERE pos = 0
UNION ALL SELECT block_id // 1000000, 3, block_id FROM b
UNION ALL SELECT g, 4, -2 FROM st WHERE pos = 0
UNION ALL SELECT g, 5, b FROM st WHERE pos = 1 UNION ALL SELECT g, 5, -1 FROM st WHERE pos = 0
UNION ALL SELECT g, 6, v FROM st WHERE g % 7 <> 0 UNION ALL SELECT g, 6, -2 FROM st WHERE g % 7 = 0 AND pos = 0
UNION ALL (SELECT g, 7, CASE WHEN g % 7 = 0 THEN -2 ELSE v END FROM st WHERE pos = 0 UNION SELECT g, 7, b FROM st WHERE pos = 1 UNION SELECT g, 7, -1 FROM st WHERE pos = 0)"""))
def x4_eval_ops(spark, sf_dir):
    """For each order: its block, the block's first part, what that holds, all blocks of the region, anything, a second part of anything, what anything holds, one of two of them."""
    blocks = pointsto.cut(_order_blocks(spark, sf_dir))
    lost = F.col("graph_id") % 7 == 0
    state = _order_state(blocks)
    state = state.where(~lost).union(state.where(lost).select("graph_id", "point", F.lit(-2).cast("long"), F.lit(-2).cast("long")).distinct())
    roots = blocks.where("parent_block is null").select("graph_id", "block_id")
    none, base = F.lit(None).cast("long"), F.col("graph_id") * 10
    node = lambda k, level, op, a=none, b=none, block=none, field=None: roots.select((base + k).alias("expr_id"), F.lit(level).alias("level"), F.lit(op).alias("op"), a.alias("arg1"), b.alias("arg2"), block.alias("block_id"), none.alias("region_id"), F.lit(field).cast("int").alias("field"))
    rows = [node(0, 0, "block", block=F.col("block_id")), node(1, 1, "sub", base, field=0), node(2, 2, "value", base + 1), node(3, 1, "region", base), node(4, 0, "any"), node(5, 1, "sub", base + 4, field=1), node(6, 1, "value", base + 4), node(7, 3, "oneof", base + 2, base + 5)]
    exprs = rows[0]
    for row in rows[1:]:
        exprs = exprs.union(row)
    zero = F.lit(0).cast("long")
    asked = roots.select("graph_id", zero.alias("point"), F.explode(F.sequence(base, base + 7)).alias("expr_id"))
    inside = spark.range(1).select(F.col("id").alias("super"), F.col("id").alias("sub"))
    return pointsto.eval_expr(asked, exprs, state, blocks, inside).select("graph_id", (F.col("expr_id") % 10).cast("int").alias("k"), "value")


@query("x4_alloc", sql.query(_ORDER_STATE, "top AS (SELECT max(block_id) + 1 AS first FROM b)", select="""SELECT g AS graph_id, 0 AS k, first + g * 10 AS value FROM st, top WHERE pos = 0
UNION ALL SELECT g, 2, first + g * 10 FROM st, top WHERE pos = 0 UNION ALL SELECT g, 2, g * 1000000 FROM st WHERE pos = 0"""))
def x4_alloc(spark, sf_dir):
    """For each order: what an allocation gives, and one of it and the order's block."""
    blocks = pointsto.cut(_order_blocks(spark, sf_dir))
    roots = blocks.where("parent_block is null").select("graph_id", "block_id")
    none, zero, base = F.lit(None).cast("long"), F.lit(0).cast("long"), F.col("graph_id") * 10
    node = lambda k, level, op, a=none, b=none, block=none, region=none: roots.select((base + k).alias("expr_id"), F.lit(level).alias("level"), F.lit(op).alias("op"), a.alias("arg1"), b.alias("arg2"), block.alias("block_id"), region.alias("region_id"), F.lit(None).cast("int").alias("field"))
    exprs = node(0, 0, "new", region=zero).union(node(1, 0, "block", block=F.col("block_id"))).union(node(2, 1, "oneof", base, base + 1))
    uses = roots.select("graph_id", (base + 2).alias("expr_id"))
    exprs, blocks = pointsto.allocation_sites(exprs, uses, blocks)
    asked = roots.select("graph_id", zero.alias("point"), F.explode(F.array(base, base + 2)).alias("expr_id"))
    empty = asked.select("graph_id", "point", F.col("expr_id").alias("block_id"), F.col("expr_id").alias("value")).where("false")
    inside = spark.range(1).select(F.col("id").alias("super"), F.col("id").alias("sub"))
    found = pointsto.eval_expr(asked, exprs, empty, blocks, inside)
    return found.select("graph_id", (F.col("expr_id") % 10).cast("int").alias("k"), "value")


@query("x6_call_blocks", sql.query(_ORDER_STATE, "top AS (SELECT max(block_id) + 1 AS first FROM b)", select="""SELECT block_id // 1000000 AS graph_id, block_id, CAST(0 AS BIGINT) AS region_id, kind FROM b
UNION ALL SELECT DISTINCT l_orderkey, first + l_suppkey % 3, l_suppkey % 3, 'pseudo' FROM lineitem, top WHERE l_returnflag = 'R'"""))
def x6_call_blocks(spark, sf_dir):
    """The orders' blocks and those that calls, one for each returned line, may allocate in the regions of suppliers."""
    calls = derive.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("graph_id"), F.lit("black").alias("kind"), F.array((F.col("l_suppkey") % 3).cast("long")).alias("regions"))
    return pointsto.call_blocks(calls, pointsto.cut(_order_blocks(spark, sf_dir))).select("graph_id", "block_id", "region_id", "kind")


@query("x5_assign_any", sql.query(_ORDER_STATE, select="""SELECT g AS graph_id, b AS block_id, v AS value FROM st WHERE g % 3 = 0 OR (g % 3 = 2 AND (pos > 0 OR g % 2 = 1))
UNION SELECT g, b, g * 1000000 FROM st WHERE g % 3 = 0 OR (g % 3 = 2 AND pos = 0) UNION SELECT g, -2, -2 FROM st WHERE g % 3 = 1"""))
def x5_assign_any(spark, sf_dir):
    """Orders that put their block anywhere, put anything anywhere, or put their block into their first part, which is static or dynamic."""
    blocks = pointsto.cut(_order_blocks(spark, sf_dir))
    zero, any_ = F.lit(0).cast("long").alias("point"), F.lit(-2).cast("long")
    roots, kind = blocks.where("parent_block is null"), F.col("graph_id") % 3
    targets = roots.select("graph_id", zero, F.when(kind == 2, F.col("block_id") + 1).otherwise(any_).alias("value"))
    values = roots.select("graph_id", zero, F.when(kind == 1, any_).otherwise(F.col("block_id")).alias("value"))
    return pointsto.assign_effect(_order_state(blocks), targets, values, blocks).select("graph_id", "block_id", "value")


@query("x6_black_parts", sql.query(_ORDER_STATE, select="""SELECT g AS graph_id, b AS block_id, v AS value FROM st
UNION SELECT x.block_id // 1000000, x.block_id, y.value FROM b x JOIN (SELECT block_id // 1000000 AS g, block_id AS value FROM b UNION SELECT g, v FROM st) y ON y.g = x.block_id // 1000000"""))
def x6_black_parts(spark, sf_dir):
    """A call in each order that gets the order's block, and with it the parts."""
    blocks = pointsto.cut(_order_blocks(spark, sf_dir))
    seeds = blocks.where("parent_block is null").select("graph_id", F.lit(0).cast("long").alias("point"), F.col("block_id").alias("value"))
    return pointsto.black_effect(_order_state(blocks), seeds, blocks).select("graph_id", "block_id", "value")


def _each(graphs, rows, schema):
    """A few fixed rows for each graph."""
    one = lambda row: F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, (c.split() for c in schema.split(", ")))))
    return graphs.select("graph_id", F.explode(F.array(*map(one, rows))).alias("row")).select("graph_id", "row.*")


@query("x7_points_to_any")
def x7_points_to_any(spark, sf_dir):
    """Hours of users with all kinds of statements: blocks, parts, copies, targets that another slot gives, unknown calls. Too entangled for SQL; tested against a plain interpreter."""
    hour = F.col("user_id") * 10_000 + F.dayofmonth("ts") * 100 + F.hour("ts")
    rows = pointsto.cut(derive.numbered(derive._events(spark, sf_dir).withColumn("graph_id", hour)))
    g = derive.walk(rows, ["ts", "event_id"], "event_id")
    base, x, k = F.col("graph_id") * 100, F.floor("value").cast("int") % 6, F.col("k") % 4
    kinds = [(i, 1, "simple", None, None) for i in range(6)] + [(10 + i, 2, "simple", None, None) for i in range(4)] + [(20, 3, "compound", None, None), (21, 3, "simple", 20, 0), (22, 3, "simple", 20, 1)]
    graphs = g.starts.select("graph_id")
    blocks = _each(graphs, kinds, "n long, region_id long, kind string, inside long, pos int").select("graph_id", (base + F.col("n")).alias("block_id"), "region_id", "kind", F.lit("static").alias("alloc"), (base + F.col("inside")).alias("parent_block"), "pos")
    ops = [(i, 0, "block", None, i, None) for i in (*range(6), *range(10, 14), 20)] + [(30 + i, 1, "value", i, None, None) for i in range(6)] + [(40 + i, 1, "sub", 20, None, i) for i in range(2)]
    none = F.lit(None).cast("long")
    exprs = _each(graphs, ops, "n long, level int, op string, arg long, block long, field int").select((base + F.col("n")).alias("expr_id"), "level", "op", (base + F.col("arg")).alias("arg1"), none.alias("arg2"), (base + F.col("block")).alias("block_id"), none.alias("region_id"), "field")
    kind = F.col("event_type")
    lhs = F.when(kind == "view", base + 30 + x).when(kind != "error", base + x)
    rhs = F.when(kind == "purchase", base + 10 + k).when(kind == "signup", base + 40 + k % 2).when(kind != "error", base + 30 + (x + 1) % 6)
    stmts = rows.select("graph_id", "node_id", F.col("event_id").alias("stmt_id"), F.col("event_id").alias("pos"), F.when(kind == "error", "black").otherwise("assign").alias("kind"), lhs.alias("lhs"), rhs.alias("rhs"), F.lit(None).cast("array<long>").alias("regions"), F.when(kind == "error", F.array(base + x)).alias("args"))
    inside = spark.range(1, 4).select(F.col("id").alias("super"), F.col("id").alias("sub"))
    return pointsto.points_to(g, stmts, exprs, blocks, inside)


_DIRECT = """ast AS (SELECT d.graph_id, d.node_id, e.event_id AS stmt_id, row_number() OVER (PARTITION BY d.graph_id, d.node_id ORDER BY e.event_id) AS pos, CASE WHEN event_type <> 'error' THEN 'v' || x END AS target,
  CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(k + 1 AS BIGINT) END AS block_id, CASE WHEN event_type IN ('click', 'view') THEN 'v' || ((x + 1) % 6) END AS source
  FROM ev e JOIN ids d ON d.graph_id = e.user_id * 100 + day(e.ts) AND d.node = e.node),
pts AS (SELECT graph_id, node_id, -10 - node_id AS point, CAST(-1 AS BIGINT) AS pos FROM nodes UNION ALL SELECT graph_id, node_id, stmt_id, pos FROM ast),
ord AS (SELECT graph_id, node_id, point, lead(point) OVER (PARTITION BY graph_id, node_id ORDER BY pos) AS nxt FROM pts),
steps AS (SELECT graph_id, point AS a, nxt AS b FROM ord WHERE nxt IS NOT NULL UNION SELECT e.graph_id, o.point, -10 - e.dst FROM edges e JOIN ord o ON o.graph_id = e.graph_id AND o.node_id = e.src AND o.nxt IS NULL),
move AS (SELECT s.graph_id, a, b, target, block_id, source FROM steps s LEFT JOIN ast ON ast.graph_id = s.graph_id AND ast.stmt_id = s.b),
pto AS (SELECT graph_id, -10 - start AS point, 'v' || v AS slot, CAST(-1 AS BIGINT) AS value FROM starts, range(6) t(v)
  UNION SELECT graph_id, stmt_id, target, block_id FROM ast WHERE block_id IS NOT NULL
  UNION SELECT p.graph_id, m.b, CASE WHEN c THEN m.target ELSE p.slot END, p.value FROM pto p JOIN move m ON m.graph_id = p.graph_id AND m.a = p.point, (VALUES (true), (false)) t(c)
    WHERE CASE WHEN c THEN m.source = p.slot ELSE m.target IS NULL OR m.target <> p.slot END)"""


def _direct(spark, sf_dir, blocks=None):
    """Slots v0 to v5 of the users' days: purchases and signups put a customer's block there, clicks and views copy the next slot."""
    rows = pointsto.cut(derive.numbered(derive._events(spark, sf_dir).withColumn("graph_id", F.col("user_id") * 100 + F.dayofmonth("ts"))))
    g = derive.walk(rows, ["ts", "event_id"], "event_id")
    x = F.floor("value").cast("int") % 6
    slot = lambda n: F.concat(F.lit("v"), n.cast("string"))
    stmts = rows.select("graph_id", "node_id", F.col("event_id").alias("stmt_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") != "error", slot(x)).alias("target"), F.when(F.col("event_type").isin("purchase", "signup"), (F.col("k") + 1).cast("long")).alias("block_id"), F.when(F.col("event_type").isin("click", "view"), slot((x + 1) % 6)).alias("source"))
    slots = g.starts.select("graph_id", F.explode(F.array(*[F.lit(f"v{i}") for i in range(6)])).alias("slot"))
    return pointsto.points_to_states(g, stmts, slots, blocks)


@query("x7_points_to", sql.query(sql.DAY, _DIRECT, select="SELECT graph_id, point, slot, value FROM pto"))
def x7_points_to(spark, sf_dir):
    """What each slot may hold behind each statement."""
    return pointsto.held_slots(_direct(spark, sf_dir)).select("graph_id", "point", "slot", F.explode("values").alias("value"))


@query("x8_may_alias", sql.query(sql.DAY, _DIRECT, select="SELECT DISTINCT a.graph_id, a.point, a.slot AS slot_1, b.slot AS slot_2 FROM pto a JOIN pto b ON b.graph_id = a.graph_id AND b.point = a.point AND b.value = a.value AND a.slot < b.slot WHERE a.value >= 0"))
def x8_may_alias(spark, sf_dir):
    """Pairs of slots that may hold the same block."""
    some = lambda values: F.exists(values, lambda v: v >= 0)
    blocks = lambda values: F.filter(values, lambda v: v >= 0)
    return pointsto.slot_pairs(_direct(spark, sf_dir), some, lambda a, b: F.arrays_overlap(blocks(a), blocks(b))).drop("values")


@query("x9_must_alias", sql.query(sql.DAY, _DIRECT, "one AS (SELECT graph_id, point, slot, min(value) AS v FROM pto GROUP BY ALL HAVING count(*) = 1 AND min(value) >= 0)", select="SELECT a.graph_id, a.point, a.slot AS slot_1, b.slot AS slot_2 FROM one a JOIN one b ON b.graph_id = a.graph_id AND b.point = a.point AND b.v = a.v AND a.slot < b.slot JOIN customer ON c_custkey = a.v"))
def x9_must_alias(spark, sf_dir):
    """Pairs of slots that hold the same block for sure."""
    states = _direct(spark, sf_dir, _customers(spark, sf_dir))
    sure = states.withColumn("held", F.map_filter("held", lambda _, v: pointsto.one_static(v, F.col("static"))))
    return pointsto.slot_pairs(sure, lambda v: F.size(v) == 1, lambda a, b: a == b).drop("values")


@query("x10_undefined", sql.query(sql.DAY, _DIRECT, select="SELECT graph_id, point, slot, CASE WHEN min(value) < 0 AND max(value) >= 0 THEN 'may' WHEN min(value) < 0 THEN 'must' END AS state FROM pto GROUP BY graph_id, point, slot"))
def x10_undefined(spark, sf_dir):
    return pointsto.held_slots(_direct(spark, sf_dir)).select("graph_id", "point", "slot", pointsto.undefined_state(F.col("values")).alias("state"))


@query("x11_asserts", sql.query(sql.DAY, _DIRECT, "c AS (SELECT count(*) AS n FROM customer)", select="""SELECT graph_id, point, slot, CASE WHEN min(value) >= 0 AND count(c_custkey) = count(*) THEN string_agg(value, ',' ORDER BY value) END AS one_of,
  (SELECT n FROM c) - count(c_custkey) AS n_not FROM pto LEFT JOIN customer ON c_custkey = value GROUP BY graph_id, point, slot"""))
def x11_asserts(spark, sf_dir):
    blocks = _customers(spark, sf_dir)
    rows = pointsto.set_asserts(pointsto.held_slots(_direct(spark, sf_dir, blocks)), blocks)
    return rows.select("graph_id", "point", "slot", F.array_join("one_of", ",").alias("one_of"), "n_not")
