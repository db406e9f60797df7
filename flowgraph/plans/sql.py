"""SQL pieces for the oracles: derived graphs and recursive definitions, for DuckDB."""

from __future__ import annotations

_EV = """ev AS (SELECT user_id, ts, event_id, event_type, value, k, event_type || ':' || CAST(k % 4 AS VARCHAR) AS node,
  CAST(floor(value) AS INT) % 6 AS x FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events))"""


def _walk(rows: str) -> str:
    return f"""{rows},
ids AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS node_id FROM (SELECT DISTINCT graph_id, node FROM rows_)),
step AS (SELECT graph_id, edge_id, node_id, lead(node_id) OVER w AS dst, row_number() OVER w AS place FROM rows_ JOIN ids USING (graph_id, node) WINDOW w AS (PARTITION BY graph_id ORDER BY ts, edge_id)),
nodes AS (SELECT graph_id, node_id, node AS info FROM ids),
edges AS (SELECT graph_id, edge_id, node_id AS src, dst FROM step WHERE dst IS NOT NULL),
starts AS (SELECT graph_id, node_id AS start FROM step WHERE place = 1)"""


USER = _walk(f"{_EV}, rows_ AS (SELECT user_id AS graph_id, ts, event_id AS edge_id, node FROM ev)")
USER_DROP = USER.replace("WHERE dst IS NOT NULL)", "WHERE dst IS NOT NULL AND edge_id % 3 <> 0)")
DAY = _walk(f"{_EV}, rows_ AS (SELECT user_id * 100 + day(ts) AS graph_id, ts, event_id AS edge_id, node FROM ev)")

_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"
ORDER = f"""step AS (SELECT l_orderkey AS graph_id, l_partkey % 7 AS node_id, lead(l_partkey % 7) OVER w AS dst, row_number() OVER w AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES})),
nodes AS (SELECT DISTINCT graph_id, node_id, CAST(node_id AS VARCHAR) AS info FROM step),
edges AS (SELECT graph_id, place AS edge_id, node_id AS src, dst FROM step WHERE dst IS NOT NULL),
starts AS (SELECT graph_id, node_id AS start FROM step WHERE place = 1)"""
PART = f"""step AS (SELECT l_orderkey AS o, l_partkey AS src, lead(l_partkey) OVER w AS dst, row_number() OVER w AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES})),
nodes AS (SELECT DISTINCT CAST(0 AS BIGINT) AS graph_id, l_partkey AS node_id FROM lineitem),
edges AS (SELECT CAST(0 AS BIGINT) AS graph_id, o * 1000 + place AS edge_id, src, dst FROM step WHERE dst IS NOT NULL),
starts AS (SELECT CAST(0 AS BIGINT) AS graph_id, min(l_partkey) AS start FROM lineitem)"""

CUSTOMER = """step AS (SELECT o_orderkey, o_custkey AS src, lead(o_custkey) OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS dst FROM orders),
nodes AS (SELECT DISTINCT CAST(0 AS BIGINT) AS graph_id, o_custkey AS node_id FROM orders),
edges AS (SELECT CAST(0 AS BIGINT) AS graph_id, o_orderkey AS edge_id, src, dst FROM step WHERE dst IS NOT NULL),
starts AS (SELECT CAST(0 AS BIGINT) AS graph_id, min(o_custkey) AS start FROM orders)"""

STMTS = """stmts AS (SELECT user_id AS graph_id, node_id, event_id AS stmt_id, row_number() OVER (PARTITION BY user_id, node_id ORDER BY event_id) AS pos,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'v' || x END AS w,
  CASE WHEN event_type = 'purchase' THEN 'v' || ((x + 1) % 6) WHEN event_type IN ('click', 'view') THEN 'v' || x END AS r
  FROM ev JOIN ids ON ids.graph_id = ev.user_id AND ids.node = ev.node)"""

REACH = """reach AS (SELECT graph_id, start AS node_id FROM starts UNION SELECT e.graph_id, e.dst FROM reach r JOIN edges e ON e.graph_id = r.graph_id AND e.src = r.node_id)"""

_DFS = """adj AS (SELECT graph_id, src, list(dst ORDER BY {order}) AS outs, list(edge_id ORDER BY {order}) AS ids FROM {edges} GROUP BY graph_id, src),
dfs AS (
  SELECT graph_id, [start] AS stack, [start] AS seen, [CAST(NULL AS BIGINT)] AS ups, [CAST(NULL AS BIGINT)] AS by_edge, CAST([] AS BIGINT[]) AS done FROM {starts}
  UNION ALL
  SELECT graph_id, CASE WHEN nxt IS NULL THEN stack[:-2] ELSE list_append(stack, outs[nxt]) END,
    CASE WHEN nxt IS NULL THEN seen ELSE list_append(seen, outs[nxt]) END,
    CASE WHEN nxt IS NULL THEN ups ELSE list_append(ups, stack[-1]) END,
    CASE WHEN nxt IS NULL THEN by_edge ELSE list_append(by_edge, eids[nxt]) END,
    CASE WHEN nxt IS NULL THEN list_append(done, stack[-1]) ELSE done END
  FROM (SELECT d.*, a.outs, a.ids AS eids, list_filter(range(1, len(coalesce(a.outs, [])) + 1), lambda i: NOT list_contains(d.seen, a.outs[i]))[1] AS nxt
    FROM dfs d LEFT JOIN adj a ON a.graph_id = d.graph_id AND a.src = d.stack[-1] WHERE len(d.stack) > 0)
),
tree AS (SELECT graph_id, node_id, place - 1 AS pre, ups[place] AS parent, by_edge[place] AS parent_edge, len(done) - list_position(done, node_id) AS rpo
  FROM (SELECT graph_id, unnest(seen) AS node_id, unnest(range(1, len(seen) + 1)) AS place, ups, by_edge, done FROM dfs WHERE len(stack) = 0))"""


def dfs(order: str = "edge_id DESC", edges: str = "edges", starts: str = "starts") -> str:
    """The depth-first tree by a recursive state of lists."""
    return _DFS.format(order=order, edges=edges, starts=starts)


DOM = f"""{REACH},
cuts AS (SELECT graph_id, node_id AS d FROM reach),
around AS (
  SELECT s.graph_id, c.d, s.start AS node_id FROM starts s JOIN cuts c ON c.graph_id = s.graph_id WHERE s.start <> c.d
  UNION
  SELECT a.graph_id, a.d, e.dst FROM around a JOIN edges e ON e.graph_id = a.graph_id AND e.src = a.node_id WHERE e.dst <> a.d
),
dom AS (SELECT c.graph_id, c.d AS dominator, r.node_id FROM cuts c JOIN reach r ON r.graph_id = c.graph_id
  ANTI JOIN around a ON a.graph_id = c.graph_id AND a.d = c.d AND a.node_id = r.node_id),
depth AS (SELECT graph_id, node_id, count(*) - 1 AS depth FROM dom GROUP BY graph_id, node_id),
idom AS (SELECT r.graph_id, r.node_id, p.dominator AS idom FROM depth r LEFT JOIN (
  SELECT dom.graph_id, dom.node_id, dom.dominator FROM dom JOIN depth a ON a.graph_id = dom.graph_id AND a.node_id = dom.dominator
  JOIN depth b ON b.graph_id = dom.graph_id AND b.node_id = dom.node_id AND a.depth = b.depth - 1) p ON p.graph_id = r.graph_id AND p.node_id = r.node_id)"""


def query(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
