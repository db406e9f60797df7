"""Minimum path coverings and maximum-weight bipartite matching."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.model import NODE, Graph
from flowgraph.operators.auction import auction_matching
from flowgraph.operators.dfs import dfst, edge_sorts
from flowgraph.operators.fixpoint import cut, double_pointers
from flowgraph.operators.pergraph import per_graph


def best_matching(pairs: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Pairs (left, right) of the greatest total weight; each end at most once. Pairs without a positive weight never count.

    Left ends come in one after another, each by the path that gains most: a left end takes a right end, whose old
    partner takes another or stays free. Paths are found as shortest ones over the pairs alone, with prices of the ends
    that keep all steps from being negative; whole numbers stay exact.
    """
    outs: dict[int, list[tuple[int, int]]] = {}
    for (left, right), weight in sorted(pairs.items()):
        if weight > 0:
            outs.setdefault(left, []).append((right, weight))
    worth = {left: max(w for _, w in own) for left, own in outs.items()}  # worth + price is never below a pair's weight
    price: dict[int, int] = {}
    owner: dict[int, int] = {}
    for root in outs:
        lost, through, came, taken, heap = {root: 0}, {}, {}, {}, []
        left, end, total, freed = root, None, worth[root], root  # the least loss yet: some left end stays free
        while True:
            for right, weight in outs[left]:
                loss = lost[left] + worth[left] + price.get(right, 0) - weight
                if right not in taken and (right not in came or loss < came[right][0]):
                    came[right] = (loss, left)
                    heappush(heap, (loss, right))
            while heap and heap[0][1] in taken:
                heappop(heap)
            if not heap or heap[0][0] >= total:
                break
            loss, right = heappop(heap)
            taken[right] = loss
            if right not in owner:
                end, total = right, loss
                break
            left = owner[right]
            lost[left], through[left] = loss, right
            if loss + worth[left] < total:
                total, freed = loss + worth[left], left
        for left, loss in lost.items():
            worth[left] -= total - loss
        for right, loss in taken.items():
            price[right] = price.get(right, 0) + total - loss
        if end is None:
            end = through.get(freed)
        while end is not None:
            left = came[end][1]
            owner[end], end = left, through.get(left)
    return sorted((left, right) for right, left in owner.items())


def components(pairs: dict[tuple[int, int], int]) -> list[dict[tuple[int, int], int]]:
    """The pairs, cut into parts that share no end."""
    above: dict[tuple[int, int], tuple[int, int]] = {}

    def top(end):
        while above.setdefault(end, end) != end:
            above[end] = end = above[above[end]]
        return end

    for left, right in pairs:
        above[top((0, left))] = top((1, right))
    parts: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
    for pair, weight in pairs.items():
        parts.setdefault(top((0, pair[0])), {})[pair] = weight
    return list(parts.values())


def _matched(nodes, edges, start):
    """The edges of a matching of sources with targets; edges: (id, src, dst, weight), one for each two ends."""
    ids = {(e[1], e[2]): e[0] for e in edges}
    for part in components({(e[1], e[2]): e[3] for e in edges}):
        for pair in best_matching(part):
            yield (ids[pair],)


def path_cover_edges(g: Graph, weight: str | None = None, tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, edge_id): edges of a minimum path covering: no back edges, at most one out of and one into each node.

    Without weights as many edges as can be, so the fewest paths; with a weight column, of the greatest total weight.
    tree: dfst(g), computed if not given.
    """
    sorts = edge_sorts(g, dfst(g) if tree is None else tree).where("coalesce(sort, '') <> 'back'")
    edges = g.edges.join(sorts.select("graph_id", "edge_id"), ["graph_id", "edge_id"], "left_semi")
    edges = edges.select("graph_id", "src", "dst", F.struct(F.col(weight).cast("long").alias("__weight") if weight else F.lit(1).cast("long").alias("__weight"), "edge_id").alias("best"))
    edges = edges.where("best.__weight > 0").groupBy("graph_id", "src", "dst").agg(F.max("best").alias("best"))  # one for parallel edges
    return per_graph(g.with_(edges=edges.select("graph_id", "best.edge_id", "src", "dst", F.lit("").alias("info"), "best.__weight")), _matched, "edge_id long", ("__weight",))


def uncovered_nodes(g: Graph, cover: DataFrame) -> DataFrame:
    """Nodes at no edge of the cover."""
    ends = g.edges.join(cover, ["graph_id", "edge_id"], "left_semi")
    used = ends.select("graph_id", F.col("src").alias("node_id")).union(ends.select("graph_id", "dst"))
    return g.nodes.select(*NODE).join(used, NODE, "left_anti")


def path_cover_paths(g: Graph, cover: DataFrame) -> DataFrame:
    """(graph_id, node_id, head, position): every node in its path, from 0 at the head; a node alone is a path.

    The cover must have no circle, which holds where circles have back edges: among reached nodes.
    """
    above = g.edges.join(cover, ["graph_id", "edge_id"], "left_semi").select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("parent"))
    rows = double_pointers(g.nodes.select(*NODE).join(above, NODE, "left"), NODE, "parent")
    return rows.select(*NODE, F.col("root").alias("head"), F.col("depth").alias("position"))


def useful_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (graph_id, l, r, weight) without those that no matching needs: at most as many for an end as the other side has ends.

    If all n ends of the other side are matched elsewhere, one of an end's n best partners is still free; so n are
    enough, and a group with few ends on one side stays small however many the other has. One pair for the same ends.
    """
    rows = pairs.where("weight > 0").groupBy("graph_id", "l", "r").agg(F.max(F.col("weight").cast("long")).alias("weight"))
    for end, other in (("r", "l"), ("l", "r")):
        ends = rows.select("graph_id", end).distinct().groupBy("graph_id").agg(F.count("*").alias("ends"))
        best = Window.partitionBy("graph_id", end).orderBy(F.desc("weight"), other)
        rows = rows.withColumn("place", F.row_number().over(best)).join(ends, "graph_id").where("place <= ends").drop("place", "ends")
    return rows


def _grouped(pairs: DataFrame, run) -> DataFrame:
    """(graph_id, l, r, weight) of run(left and right ends with weights) for each group."""

    def own(nodes, edges, start):
        weights = {(e[1], e[2]): e[3] for e in edges}
        for left, right in run(weights):
            yield left, right, weights[left, right]

    rows = useful_pairs(pairs).select("graph_id", F.lit(0).cast("long").alias("edge_id"), F.col("l").alias("src"), F.col("r").alias("dst"), F.lit("").alias("info"), F.col("weight").alias("__weight"))
    groups = rows.select("graph_id").distinct()
    zero = F.lit(0).cast("long")
    g = Graph(groups.select("graph_id", zero.alias("node_id"), F.lit("").alias("info")), rows, groups.select("graph_id", zero.alias("start")))
    return per_graph(g, own, "l long, r long, weight long", ("__weight",))


def max_matching(pairs: DataFrame, max_pairs: int = 1_000_000) -> DataFrame:
    """(graph_id, l, r, weight): a matching of the greatest total weight of each group of pairs (graph_id, l, r, weight).

    A group of at most max_pairs pairs is packed for one task, without the pairs that no matching needs; its parts that
    share no end are matched apart. Larger groups are matched by bids over joins (see auction_matching), with the same
    total. Weights are whole numbers; pairs without a positive one never count.
    """
    sizes = cut(pairs.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > max_pairs).select("graph_id"))
    run = lambda weights: [pair for part in components(weights) for pair in best_matching(part)]
    if sizes.isEmpty():
        return _grouped(pairs, run)
    packed = _grouped(pairs.join(sizes, "graph_id", "left_anti"), run)
    return packed.union(auction_matching(pairs.join(sizes, "graph_id", "left_semi")))


def exhaustive_matching(pairs: DataFrame, most: int = 8) -> DataFrame:
    """As max_matching, by trying all matchings: for checks. A part with more than `most` ends on both sides is an error."""
    return _grouped(pairs, lambda weights: [pair for part in components(weights) for pair in _tried(part, most)])


def _tried(pairs: dict[tuple[int, int], int], most: int = 8) -> list[tuple[int, int]]:
    flip = len({left for left, _ in pairs}) > len({right for _, right in pairs})
    outs: dict[int, list[tuple[int, int]]] = {}
    for (left, right), weight in pairs.items():
        outs.setdefault(right if flip else left, []).append((left if flip else right, weight))
    if len(outs) > most:
        raise ValueError(f"more than {most} ends on both sides")
    ends, best = list(outs), (0, [])

    def extend(at: int, total: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal best
        if at == len(ends):
            best = max(best, (total, chosen), key=lambda x: x[0])
            return
        extend(at + 1, total, chosen)
        for other, weight in outs[ends[at]]:
            if weight > 0 and all(other != used for _, used in chosen):
                extend(at + 1, total + weight, [*chosen, (ends[at], other)])

    extend(0, 0, [])
    return [(b, a) if flip else (a, b) for a, b in best[1]]


def exhaustive_weight(pairs: dict[tuple[int, int], int]) -> int:
    """The greatest total weight of a matching by trying all; for checks on a handful of pairs."""
    return sum(pairs[pair] for pair in _tried(pairs, len(pairs)))
