"""The tables of a set of graphs."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

NODE = ["graph_id", "node_id"]
#: Columns that each table must have; further ones are payload.
COLUMNS = {"nodes": {"graph_id", "node_id", "info"}, "edges": {"graph_id", "edge_id", "src", "dst", "info"}, "starts": {"graph_id", "start"}}


@dataclass(frozen=True)
class Graph:
    """Many labelled directed multigraphs, told apart by graph_id.

    nodes: graph_id, node_id, info. edges: graph_id, edge_id, src, dst, info. starts: graph_id, start. Ids are longs
    and unique in a graph; info is payload and never a key. Parallel edges and self loops are allowed. Where an order
    of out-edges matters it is edge_id descending.
    """

    nodes: DataFrame
    edges: DataFrame
    starts: DataFrame

    def __post_init__(self) -> None:
        for name, needed in COLUMNS.items():
            missing = needed - set(getattr(self, name).columns)
            if missing:
                raise ValueError(f"{name} lacks {sorted(missing)}")

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)
