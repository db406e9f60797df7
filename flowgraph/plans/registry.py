"""All registered queries of the library and their SQL."""

from __future__ import annotations

from flowgraph.plans import flows, graphs, shapes  # noqa: F401  each adds to the tables of the first

QUERIES, ORACLE_SQL = graphs.QUERIES, graphs.SQL
