"""Maximum-weight bipartite matching of groups of any size, by joins: bids raise prices until nobody wants to change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.operators.fixpoint import cut

#: An end of a group: (graph_id, side, id). dual is its price or profit, mate the end of the other side it is matched with.
_END = ["graph_id", "side", "id"]


def auction_matching(pairs: DataFrame, epsilon: float | None = None, shrink: int = 6, max_rounds: int = 100_000) -> DataFrame:
    """(graph_id, l, r, weight): a matching of each group of pairs (graph_id, l, r, weight), no end packed with its pairs.

    The total is the greatest one if epsilon is not given; else it falls short of it by at most epsilon for each matched
    pair, in fewer rounds. Weights are whole numbers; pairs without a positive one never count, of pairs of the same two
    ends the best one does. Weights times the ends of a group's smaller side must fit a long.

    All groups and all free ends of one side bid at once. An end looks at its partners' weights less their prices and
    offers the best one so much that it is as good as the second best, or as staying free, less a step; the highest offer
    takes the partner and frees its former mate. When no free left end has anything to gain, free right ends that still
    ask a price bid in the same way for left ends. Then prices and profits differ from an optimum of the dual problem by
    at most the step for each pair, and unmatched ends have none. Steps shrink from the greatest weight down to one,
    with weights multiplied by the number of ends plus one, so the last one is exact; each phase begins with the prices of
    the one before and frees only the ends that its smaller step finds unhappy. A round is two joins on ends and one
    reduction each for bidders and their targets; rows are the pairs of the ends that bid.
    """
    rows = pairs.where("weight > 0").groupBy("graph_id", "l", "r").agg(F.max(F.col("weight").cast("long")).alias("weight"))
    rows = cut(rows)
    sides = rows.groupBy("graph_id").agg(F.countDistinct("l").alias("n_l"), F.countDistinct("r").alias("n_r"), F.max("weight").alias("most"))
    scale = F.least("n_l", "n_r") + 1
    if epsilon is not None:
        scale = F.least(scale, F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(1.0 / epsilon))))
    sides = cut(sides.select("graph_id", scale.cast("long").alias("scale"), "most"))
    edges = cut(rows.join(sides, "graph_id").select("graph_id", "l", "r", "weight", (F.col("weight") * F.col("scale")).alias("gain"), (F.col("most") * F.col("scale")).alias("top")))
    steps = [max(1, (edges.agg(F.max("top")).first()[0] or 1) // shrink)]
    while steps[-1] > 1:
        steps.append(max(1, steps[-1] // shrink))
    left = edges.groupBy("graph_id", F.col("l").alias("id")).agg(F.max("gain").alias("dual")).withColumn("side", F.lit("l"))
    right = edges.select("graph_id", F.col("r").alias("id"), F.lit(0).cast("long").alias("dual"), F.lit("r").alias("side")).distinct()
    state = cut(left.unionByName(right).select(*_END, "dual", F.lit(None).cast("long").alias("mate")))
    for number, step in enumerate(steps):
        if number:
            state = _unsettled(state, edges)
        for side in ("l", "r"):
            for _ in range(max_rounds):
                bids = cut(_bids(state, edges, side, step))
                if bids.isEmpty():
                    break
                state = cut(_sold(state, bids, side))
            else:
                raise RuntimeError(f"no end of bids in {max_rounds} rounds")
    won = state.where("side = 'l' and mate is not null").select("graph_id", F.col("id").alias("l"), F.col("mate").alias("r"))
    return won.join(rows, ["graph_id", "l", "r"]).select("graph_id", "l", "r", "weight")


def _facing(state: DataFrame, edges: DataFrame, side: str, own: DataFrame) -> DataFrame:
    """own (graph_id, id, ...) with each partner and what it is worth: the gain less the partner's dual."""
    other = "r" if side == "l" else "l"
    prices = state.where(F.col("side") == other).select("graph_id", F.col("id").alias("partner"), F.col("dual").alias("price"))
    mine = edges.select("graph_id", F.col(side).alias("id"), F.col(other).alias("partner"), "gain", "top")
    return own.join(mine, ["graph_id", "id"]).join(prices, ["graph_id", "partner"]).withColumn("worth", F.col("gain") - F.col("price"))


def _bids(state: DataFrame, edges: DataFrame, side: str, step: int) -> DataFrame:
    """(graph_id, id, partner, keeps, offer) of the free ends of a side that have something to gain; partner is null for those that give up.

    keeps is the bidder's new dual if it gets the partner, offer the partner's. Steps are cut to a group's greatest gain.
    """
    free = state.where((F.col("side") == side) & F.col("mate").isNull() & (F.col("dual") > 0)).select("graph_id", "id")
    facing = _facing(state, edges, side, free)
    best = Window.partitionBy("graph_id", "id").orderBy(F.desc("worth"), F.xxhash64("partner", "id"))
    two = facing.withColumn("place", F.row_number().over(best)).where("place <= 2")
    own = two.groupBy("graph_id", "id").agg(F.max(F.when(F.col("place") == 1, F.struct("partner", "worth", "gain", "top"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("worth"))).alias("second"))
    zero = F.lit(0).cast("long")
    small = F.least(F.lit(step).cast("long"), F.greatest(F.col("first.top").cast("long"), F.lit(1).cast("long")))
    keeps = F.greatest(F.coalesce("second", zero) - small, zero)
    wants = F.col("first.worth") > 0
    return own.select("graph_id", "id", F.when(wants, F.col("first.partner")).alias("partner"), F.when(wants, keeps).otherwise(zero).alias("keeps"), F.when(wants, F.col("first.gain") - keeps).alias("offer"))


def _sold(state: DataFrame, bids: DataFrame, side: str) -> DataFrame:
    """The state after each partner went to its highest bidder."""
    other = "r" if side == "l" else "l"
    won = bids.where("partner is not null").groupBy("graph_id", "partner").agg(F.max(F.struct("offer", F.xxhash64("id", "partner").alias("luck"), "id", "keeps")).alias("best"))
    won = won.select("graph_id", "partner", "best.offer", "best.id", "best.keeps")
    got = won.select("graph_id", F.lit(side).alias("side"), "id", F.col("keeps").alias("new"), F.col("partner").alias("to"))
    sold = won.select("graph_id", F.lit(other).alias("side"), F.col("partner").alias("id"), F.col("offer").alias("new"), F.col("id").alias("to"))
    gone = bids.where("partner is null").select("graph_id", F.lit(side).alias("side"), "id", F.col("keeps").alias("new"), F.lit(None).cast("long").alias("to"))
    lost = state.where((F.col("side") == other) & F.col("mate").isNotNull()).select("graph_id", F.col("id").alias("partner"), "mate")
    lost = lost.join(won.select("graph_id", "partner"), ["graph_id", "partner"], "left_semi")
    left = lost.select("graph_id", F.lit(side).alias("side"), F.col("mate").alias("id"), F.lit(None).cast("long").alias("new"), F.lit(None).cast("long").alias("to"))
    changed = got.union(sold).union(gone).union(left).withColumn("changed", F.lit(True))
    now = state.join(changed, _END, "left")
    return now.select(*_END, F.coalesce("new", "dual").alias("dual"), F.when(F.col("changed"), F.col("to")).otherwise(F.col("mate")).alias("mate"))


def _unsettled(state: DataFrame, edges: DataFrame) -> DataFrame:
    """The state with every left end's profit as its best partner's worth, and freed if that is not its mate."""
    own = state.where("side = 'l'").select("graph_id", "id", "mate")
    facing = _facing(state, edges, "l", own)
    best = facing.groupBy("graph_id", "id", "mate").agg(F.greatest(F.max("worth"), F.lit(0).cast("long")).alias("dual"), F.max(F.when(F.col("partner") == F.col("mate"), F.col("worth"))).alias("held"))
    best = cut(best.select("graph_id", "id", "dual", F.when(F.col("held") >= F.col("dual"), F.col("mate")).alias("mate")))
    kept = best.where("mate is not null").select("graph_id", F.col("mate").alias("id"), F.col("id").alias("kept"))
    right = state.where("side = 'r'").join(kept, ["graph_id", "id"], "left").select(*_END, "dual", F.col("kept").alias("mate"))
    return cut(best.select("graph_id", F.lit("l").alias("side"), "id", "dual", "mate").union(right))
