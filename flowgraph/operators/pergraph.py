"""Sequential algorithms on one graph, run for many graphs at once: Spark packs, deals and unpacks the graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.model import Graph
from flowgraph.operators.fixpoint import merged


ROWS = 20_000  # of a batch on its way back

TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "map<string,array<long>>": pa.map_(pa.string(), pa.list_(pa.int64())), "map<long,array<long>>": pa.map_(pa.int64(), pa.list_(pa.int64()))}


def _lists(column: pa.Array) -> list[list]:
    """A column of lists as Python lists, of tuples where structs are listed; none for null."""
    flat = column.flatten()
    values = list(zip(*(f.to_pylist() for f in flat.flatten()))) if pa.types.is_struct(flat.type) else flat.to_pylist()
    ends = [0, *accumulate(n or 0 for n in pc.list_value_length(column).to_pylist())]
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def per_graph(g: Graph, run: Callable[..., Iterable[tuple]], schema: str, edge_columns: tuple[str, ...] = (), node_columns: DataFrame | None = None, more: dict[str, DataFrame] | None = None) -> DataFrame:
    """graph_id and what run(nodes, edges, start, **more) yields for each graph.

    nodes: sorted ids, or (id, further columns) of node_columns (graph_id, node_id, ...). edges: (edge_id, src, dst,
    *edge_columns), the greatest edge_id first. start: an id or None. more: further tables (graph_id, ...), whose rows
    come as sorted tuples under their names. A graph is one row on its way to Python, so
    millions of small graphs travel in batches; it must fit a task's memory.
    """

    def listed(table: DataFrame, name: str) -> DataFrame:
        rows = F.struct(*[c for c in table.columns if c != "graph_id"])
        return table.groupBy("graph_id").agg(F.sort_array(F.collect_list(rows)).alias(name))

    more = more or {}
    nodes = g.nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list("node_id")).alias("nodes")) if node_columns is None else listed(node_columns, "nodes")
    edges = g.edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("edge_id", "src", "dst", *edge_columns)), asc=False).alias("edges"))
    packed = nodes.join(merged(edges), "graph_id", "left").join(merged(g.starts.groupBy("graph_id").agg(F.min("start").alias("start"))), "graph_id", "left")
    for name, table in more.items():
        packed = packed.join(merged(listed(table, name)), "graph_id", "left")
    names = ["graph_id", *[c.split()[0] for c in schema.split(", ")]]
    own = tuple(more)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in names]
        done = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, starts = part.column("graph_id").to_pylist(), part.column("start").to_pylist()
                tables = [_lists(part.column(name)) for name in ("nodes", "edges", *own)]
                for graph, start, members, out_edges, *rest in zip(ids, starts, *tables):
                    for out in run(members, out_edges, start, **dict(zip(own, rest))):
                        columns[0].append(graph)
                        for c, v in zip(columns[1:], out):
                            c.append(v)
                        if len(columns[0]) >= ROWS:
                            yield done()
                            columns = [[] for _ in names]
        yield done()

    types = [pa.int64(), *[TYPES[c.split()[1]] for c in schema.split(", ")]]
    return packed.mapInArrow(tasks, f"graph_id long, {schema}")


def out_lists(edges: list[tuple]) -> dict[int, list[tuple[int, int]]]:
    """(dst, edge_id) of each source in the edges' order."""
    out: dict[int, list[tuple[int, int]]] = {}
    for edge in edges:
        out.setdefault(edge[1], []).append((edge[2], edge[0]))
    return out


def depth_first(roots: Iterable[int], outs: dict[int, list[tuple[int, int]]]) -> tuple[list[int], list[int], dict[int, tuple[int | None, int | None]]]:
    """Nodes as they are entered, as they are left, and each one's parent and edge, from the roots in turn."""
    entered: list[int] = []
    left: list[int] = []
    above: dict[int, tuple[int | None, int | None]] = {}
    for root in roots:
        if root in above:
            continue
        above[root] = (None, None)
        entered.append(root)
        stack = [(root, iter(outs.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            for dst, edge in rest:
                if dst not in above:
                    above[dst] = (node, edge)
                    entered.append(dst)
                    stack.append((dst, iter(outs.get(dst, ()))))
                    break
            else:
                left.append(node)
                stack.pop()
    return entered, left, above


def immediate_dominators(start: int, rpo: dict[int, int], preds: dict[int, list[int]]) -> dict[int, int]:
    """The closest strict dominator of every reached node but the start, by intersecting predecessors in reverse postorder."""
    above = {start: start}
    order = sorted(rpo, key=rpo.__getitem__)
    changed = True
    while changed:
        changed = False
        for node in order:
            if node == start:
                continue
            best = None
            for p in preds.get(node, ()):
                if p in above:
                    if best is None:
                        best = p
                        continue
                    a, b = p, best
                    while a != b:
                        if rpo[a] > rpo[b]:
                            a = above[a]
                        else:
                            b = above[b]
                    best = a
            if above.get(node) != best:
                above[node] = best
                changed = True
    del above[start]
    return above
