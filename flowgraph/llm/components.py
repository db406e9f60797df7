"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.storage import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    Each round hangs every node's larger neighbours, then all its neighbours, under the smallest one, which
    halves paths; rounds are about the logarithm of the longest path. Every round is written to the shared
    folder. Self loops and rows with a null end are ignored. Groups are only reduced by min, never gathered.
    """
    links = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m"))
    links = materialize(links.where("v is not null and m is not null and v <> m").distinct(), "links")
    for _ in range(max_rounds):
        if _stars_only(links):
            return links.select(F.col("v").alias("node"), F.col("m").alias("component")).union(
                links.select(F.col("m"), F.col("m")).distinct()
            )
        both = links.select(F.col("v").alias("u"), F.col("m").alias("w")).union(links.select(F.col("m"), F.col("v")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.first("u")).alias("low"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("low").alias("m"))
        large = large.distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        hung = large.join(least, "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        small = hung.union(least.select("v", F.col("low").alias("m"))).where("v <> m").distinct()
        links = materialize(small, "links")
    raise RuntimeError(f"no convergence in {max_rounds} rounds")


def _stars_only(links: DataFrame) -> bool:
    """Whether every node hangs once, under a node that hangs nowhere."""
    seen = links.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("m"), F.lit(0), F.lit(1))
    )
    bad = seen.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return bad.where("up > 1 or (up > 0 and down > 0)").isEmpty()
