"""Regions of an order, strongly connected components, loop nests and forests, hammocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.model import NODE, Graph
from flowgraph.operators.dfs import dfst
from flowgraph.operators.fixpoint import Appended, closure, cut, double_pointers
from flowgraph.operators.pergraph import depth_first, out_lists, per_graph


def region(g: Graph, order: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(graph_id, header, node_id): the header and the nodes of greater numbers that reach it through such nodes only.

    order: (graph_id, node_id, number). headers: (graph_id, header); all nodes of the order if not given. Only headers
    of which a predecessor has a number at least as great have more than themselves in their region.
    """
    if headers is None:
        headers = order.select("graph_id", F.col("node_id").alias("header"))
    ends = order.select("graph_id", F.col("node_id").alias("src"), F.col("number").alias("__number"))
    edges = cut(g.edges.select("graph_id", "src", "dst").distinct().join(ends, ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id"), "src", "__number"))
    seed = headers.join(order.select("graph_id", F.col("node_id").alias("header"), F.col("number").alias("floor")), ["graph_id", "header"]).withColumn("node_id", F.col("header"))
    seed = seed.select("graph_id", "header", "node_id", "floor")
    return closure(seed, lambda new: new.join(edges, NODE).where("__number > floor").select("graph_id", "header", F.col("src").alias("node_id"), "floor")).drop("floor")


def scs(g: Graph, tree: DataFrame) -> DataFrame:
    """Each reached node's strongly connected subgraph: its region by reverse postorder."""
    return region(g, tree.select(*NODE, F.col("rpo").alias("number")))


def _components(nodes, edges, start):
    """Strongly connected components of the reached nodes, by Kosaraju's two searches, with the first member in reverse postorder."""
    if start is None:
        return
    _, left, reached = depth_first([start], out_lists(edges))
    back = out_lists([(e[0], e[2], e[1]) for e in edges if e[1] in reached])
    done: set[int] = set()
    for head in reversed(left):
        stack = [] if head in done else [head]
        done.add(head)
        while stack:
            node = stack.pop()
            yield node, head
            for src, _ in back.get(node, ()):
                if src not in done:
                    done.add(src)
                    stack.append(src)


def scc(g: Graph) -> DataFrame:
    """(graph_id, node_id, bivertex): the component of each reached node, named by its member of the lowest reverse postorder."""
    return per_graph(g, _components, "node_id long, bivertex long")


def _degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, n_in, n_out) of the nodes at some edge."""
    both = edges.select("graph_id", F.col("src").alias("node_id"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out")).union(edges.select("graph_id", "dst", F.lit(1), F.lit(0)))
    return both.groupBy(*NODE).agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))


def _without_chains(edges: DataFrame, found: Appended, max_rounds: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """The edges with one edge for each chain of nodes that one edge enters and one leaves; and (graph_id, node_id, head, tail) of these nodes.

    head and tail are the nodes before and behind the chain. Chains are followed by doubling, in rounds of the logarithm
    of their length. Circles of such nodes alone are components, and are added to found.
    """
    inner = cut(_degrees(edges).where("n_in = 1 and n_out = 1").select(*NODE))
    if inner.isEmpty():
        return edges, None
    onward = edges.join(inner.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("to"))
    ahead = inner.select("graph_id", F.col("node_id").alias("to"), F.lit(True).alias("open"))
    now = onward.join(ahead, ["graph_id", "to"], "left").select(*NODE, "to", F.coalesce("open", F.lit(False)).alias("open"), F.col("node_id").alias("last"), F.col("node_id").alias("low"))
    now = cut(now)
    for _ in range(max_rounds):
        then = now.select("graph_id", F.col("node_id").alias("to"), F.col("to").alias("to2"), F.col("open").alias("open2"), F.col("last").alias("last2"), F.col("low").alias("low2"))
        step = now.where("open").join(then, ["graph_id", "to"])
        step = step.select(*NODE, F.col("to2").alias("to"), F.col("open2").alias("open"), F.col("last2").alias("last"), F.least("low", "low2").alias("low"), (~F.col("open2") | (F.col("low2") < F.col("low"))).alias("moved"))
        step = cut(step)
        moved = not step.where("moved").isEmpty()
        now = now.where("not open").union(step.drop("moved"))
        if not moved:
            break
        now = cut(now)
    found.add(now.where("open").select(*NODE, F.col("low").alias("component")))
    done = cut(now.where("not open").select(*NODE, F.col("to").alias("tail"), "last"))
    into = edges.join(inner.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_anti").join(done.select("graph_id", F.col("node_id").alias("dst"), "tail", "last"), ["graph_id", "dst"])
    ends = cut(into.select("graph_id", "last", F.col("src").alias("head"), "tail"))
    for end in ("src", "dst"):
        edges = edges.join(inner.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    short = ends.where("head <> tail").select("graph_id", F.col("head").alias("src"), F.col("tail").alias("dst"))
    return cut(edges.select("graph_id", "src", "dst").union(short).distinct()), cut(done.drop("tail").join(ends, ["graph_id", "last"]).drop("last"))


def _trimmed(nodes: DataFrame, edges: DataFrame, found: Appended) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes and edges without those that no edge enters or leaves, which are added to found; and whether there were any."""
    kept = _degrees(edges).where("n_in > 0 and n_out > 0").select(*NODE, F.lit(True).alias("kept"))
    marked = cut(nodes.join(kept, NODE, "left"))
    out = marked.where("kept is null").select(*NODE, F.col("node_id").alias("component"))
    if out.isEmpty():
        return nodes, edges, False
    found.add(out)
    nodes = marked.where("kept").select(*NODE)
    for end in ("src", "dst"):
        edges = edges.join(nodes.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
    return nodes, cut(edges), True


def scc_by_joins(g: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(graph_id, node_id, component) over all nodes, for graphs of any size; component is the least member.

    Chains become single edges (a node of a chain is in the component of both its ends, or alone), and nodes that no edge
    enters or leaves are components of their own, as long as there are any; both take rounds of the logarithm of a
    chain's length. Then the rest is coloured with the least node that reaches each, and of each colour the nodes that
    reach its namesake within the colour are a component; what is left goes on. Found components are appended to a
    table, so plans do not grow.
    """
    nodes, edges = cut(g.nodes.select(*NODE)), cut(g.edges.select("graph_id", "src", "dst").where("src <> dst").distinct())
    found, chains = Appended(nodes.withColumn("component", F.col("node_id"))), []
    for _ in range(max_rounds):
        while True:
            edges, chain = _without_chains(edges, found)
            if chain is not None:
                chains.append(chain)
                circles = found.read()
                nodes = cut(nodes.join(chain.select(*NODE), NODE, "left_anti").join(circles.select(*NODE), NODE, "left_anti"))
            nodes, edges, fewer = _trimmed(nodes, edges, found)
            if not fewer and chain is None:
                break
        if nodes.isEmpty():
            break
        colour = cut(nodes.withColumn("colour", F.col("node_id")))
        while True:
            came = edges.join(colour.select("graph_id", F.col("node_id").alias("src"), F.col("colour").alias("__c")), ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("node_id")).agg(F.min("__c").alias("__c"))
            new = cut(colour.join(came, NODE, "left").select(*NODE, F.least("colour", F.coalesce("__c", "colour")).alias("colour"), (F.col("__c") < F.col("colour")).alias("moved")))
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        ends = colour.select("graph_id", F.col("node_id").alias("src"), "colour").join(edges, ["graph_id", "src"])
        inside = cut(ends.join(colour.select("graph_id", F.col("node_id").alias("dst"), "colour"), ["graph_id", "dst", "colour"]).select("graph_id", "src", "dst", "colour"))
        seed = colour.where("node_id = colour").select("graph_id", "node_id", "colour")
        took = closure(seed, lambda part: part.withColumnRenamed("node_id", "dst").join(inside, ["graph_id", "dst", "colour"]).select("graph_id", F.col("src").alias("node_id"), "colour"))
        found.add(took.withColumnRenamed("colour", "component"))
        nodes = cut(nodes.join(took, NODE, "left_anti"))
        for end in ("src", "dst"):
            edges = edges.join(nodes.withColumnRenamed("node_id", end), ["graph_id", end], "left_semi")
        edges = cut(edges)
    else:
        raise RuntimeError("no end of components")
    for chain in reversed(chains):  # the ends of a chain are known from later rounds
        known = found.read()
        for end in ("head", "tail"):
            chain = chain.join(known.select("graph_id", F.col("node_id").alias(end), F.col("component").alias(f"{end}_in")), ["graph_id", end])
        found.add(cut(chain.select(*NODE, F.when(F.col("head_in") == F.col("tail_in"), F.col("head_in")).otherwise(F.col("node_id")).alias("component"))))
    rows = found.read()
    least = rows.groupBy("graph_id", "component").agg(F.min("node_id").alias("least"))
    return rows.join(least, ["graph_id", "component"]).select(*NODE, F.col("least").alias("component"))


def loop_forest(g: Graph, tree: DataFrame) -> DataFrame:
    """(graph_id, node_id, header, has_self_loop): the innermost loop header around each reached node, null outside loops.

    A node's header is the other node of the highest reverse postorder whose region holds it, so irreducible loops
    have one too.
    """
    order = tree.select(*NODE, F.col("rpo").alias("number"))
    number = order.select("graph_id", F.col("node_id").alias("dst"), F.col("number").alias("__to"))
    back = g.edges.join(order.select("graph_id", F.col("node_id").alias("src"), F.col("number").alias("__from")), ["graph_id", "src"]).join(number, ["graph_id", "dst"]).where("__from >= __to")
    headers = back.select("graph_id", F.col("dst").alias("header")).distinct()
    inside = region(g, order, headers).where("header <> node_id").join(order.select("graph_id", F.col("node_id").alias("header"), "number"), ["graph_id", "header"])
    best = inside.groupBy(*NODE).agg(F.max(F.struct("number", "header")).alias("__best"))
    loops = g.edges.where("src = dst").select("graph_id", F.col("src").alias("node_id"), F.lit(True).alias("has_self_loop")).distinct()
    out = order.join(best, NODE, "left").join(loops, NODE, "left")
    return out.select(*NODE, F.col("__best.header").alias("header"), F.coalesce("has_self_loop", F.lit(False)).alias("has_self_loop"))


def forest_root(parents: DataFrame) -> DataFrame:
    """(graph_id, node_id, root, depth) of a parent table (graph_id, node_id, parent)."""
    return double_pointers(parents, NODE, "parent")


def forest_parent(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The parents of asked nodes; null for roots and unknown nodes."""
    return nodes.join(parents.select(*NODE, "parent"), NODE, "left")


def forest_join(parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """parents, with the root of each pair's node hung under the pair's parent (graph_id, node_id, parent).

    A pair within one tree is left out, and of several for one root that of the least parent is taken; the pairs
    together must not close a circle of trees.
    """
    roots = forest_root(parents).select(*NODE, "root")
    upper = roots.select("graph_id", F.col("node_id").alias("parent"), F.col("root").alias("other"))
    hung = pairs.join(roots, NODE).join(upper, ["graph_id", "parent"]).where("root <> other").groupBy("graph_id", F.col("root").alias("node_id")).agg(F.min("parent").alias("__new"))
    return parents.join(hung, NODE, "left").select(*NODE, F.coalesce("parent", "__new").alias("parent"))


def forest_tree(parents: DataFrame) -> DataFrame:
    """(graph_id, node_id, depth, path, is_leaf): path has the ids from the root down, with slashes."""
    seed = parents.where("parent is null").select(*NODE, F.lit(0).alias("depth"), F.col("node_id").cast("string").alias("path"))
    down = cut(parents.where("parent is not null").select("graph_id", F.col("node_id").alias("__low"), F.col("parent").alias("node_id")))
    found = closure(seed, lambda new: new.join(down, NODE).select("graph_id", F.col("__low").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", F.col("__low").cast("string")).alias("path")))
    inner = parents.select("graph_id", F.col("parent").alias("node_id"), F.lit(False).alias("__leaf")).where("node_id is not null").distinct()
    return found.join(inner, NODE, "left").select(*NODE, "depth", "path", F.coalesce("__leaf", F.lit(True)).alias("is_leaf"))


def _region_of(place: int, order: list[int], number: dict[int, int], preds: dict[int, list[int]]) -> set[int]:
    found, stack = {order[place]}, [order[place]]
    while stack:
        for p in preds.get(stack.pop(), ()):
            if p not in found and number.get(p, -1) > place:
                found.add(p)
                stack.append(p)
    return found


def _orders(nodes, edges, start):
    """K and L of one graph: see hammock_orders."""
    if start is None:
        return
    _, left, reached = depth_first([start], out_lists(edges))
    preds: dict[int, list[int]] = {}
    succs: dict[int, list[int]] = {}
    for e in edges:
        if e[1] in reached:
            preds.setdefault(e[2], []).append(e[1])
            succs.setdefault(e[1], []).append(e[2])
    order = left[::-1]
    for i in range(len(order)):
        number = {n: j for j, n in enumerate(order)}
        inside = _region_of(i, order, number, preds)
        order = order[:i] + sorted(order[i:], key=lambda n, inside=inside: n not in inside)
    k = {n: j for j, n in enumerate(order)}
    for i in range(len(order)):
        number = {n: j for j, n in enumerate(order)}
        inside = _region_of(i, order, number, preds)
        exits = [n for n in inside if any(s not in inside for s in succs.get(n, ()))]
        line, todo = set(exits), list(exits)
        while todo:
            n = todo.pop()
            for p in preds.get(n, ()):
                if p in inside and p not in line and number[p] < number[n]:
                    line.add(p)
                    todo.append(p)

        def rank(node, line=line, number=number, i=i):
            best, seen, todo = i, {node}, [node]
            while todo:
                for p in preds.get(todo.pop(), ()):
                    if p in seen:
                        continue
                    if p in line:
                        best = max(best, number[p])
                    else:
                        seen.add(p)
                        todo.append(p)
            return best

        ranked = sorted(inside, key=lambda n, number=number: (rank(n), number[n]))
        spots = sorted(number[n] for n in inside)
        for spot, n in zip(spots, ranked):
            order[spot] = n
    lnum = {n: j for j, n in enumerate(order)}
    for n in order:
        yield n, k[n], lnum[n]


def k_order(g: Graph, tree: DataFrame) -> DataFrame:
    """(graph_id, node_id, k) of the reached nodes, as hammock_orders has it, by joins: tree is dfst(g).

    Regions are nested or apart, so K sorts nodes by the reverse postorder numbers of all headers around them, the
    outermost first, and their own. A node's numbers are as many as regions are nested around it.
    """
    number = tree.select("graph_id", F.col("node_id").alias("header"), "rpo")
    around = scs(g, tree).join(number, ["graph_id", "header"]).groupBy(*NODE).agg(F.sort_array(F.collect_list("rpo")).alias("around"))
    return around.select(*NODE, (F.row_number().over(Window.partitionBy("graph_id").orderBy("around")) - 1).alias("k"))


def hammock_orders(g: Graph) -> DataFrame:
    """(graph_id, node_id, k, l) of the reached nodes.

    K begins as reverse postorder; for i = 0, 1, ... the region of node i (its nodes of greater numbers that reach it)
    moves up behind i, all else in order. L begins as K; each region in turn is sorted by rank, then number: the
    greatest number of a node of the region's line that leads to it, the line being the exits and what leads to them
    from smaller numbers. Cubic in a graph's nodes.
    """
    return per_graph(g, _orders, "node_id long, k int, l int")


def _first_below(rows: DataFrame, value: str, max_levels: int = 64) -> DataFrame:
    """(graph_id, k, stop): for each place k the first place behind it whose value is less than k, or the number of places.

    rows: (graph_id, k, value) for the places from 0 on; a null value is no less than any. The least values of stretches of
    1, 2, 4, ... places are joined, then each place goes on by falling powers of two as long as nothing less is passed.
    """
    big = F.lit(1 << 60)
    tables = [cut(rows.select("graph_id", "k", F.coalesce(F.col(value).cast("long"), big).alias("least")))]
    sizes = cut(rows.groupBy("graph_id").agg(F.count("*").alias("n")))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    while (1 << len(tables)) < longest and len(tables) < max_levels:
        half = 1 << (len(tables) - 1)
        then = tables[-1].select("graph_id", (F.col("k") - half).alias("k"), F.col("least").alias("more"))
        tables.append(cut(tables[-1].join(then, ["graph_id", "k"], "left").select("graph_id", "k", F.least("least", F.coalesce("more", big)).alias("least"))))
    now = rows.select("graph_id", "k", (F.col("k") + 1).alias("at"))
    for j in reversed(range(len(tables))):
        now = now.join(tables[j].withColumnRenamed("k", "at"), ["graph_id", "at"], "left")
        now = now.select("graph_id", "k", F.when(F.coalesce("least", big) >= F.col("k"), F.col("at") + (1 << j)).otherwise(F.col("at")).alias("at"))
    return now.join(sizes, "graph_id").select("graph_id", "k", F.least("at", "n").cast("int").alias("stop"), F.col("n").cast("int").alias("n"))


def hammocks(g: Graph, order: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(graph_id, first, last, exit): nodes K[first..last] that are entered at the first only and left to K[exit] only.

    exit is -1 where nothing leaves. order: (graph_id, node_id, k), tree: dfst(g), computed if not given. Joins and windows
    alone: a stretch of K grows from each first node up to the node that is entered from before it, which is found by
    doubling, so places that can be no part of a hammock make no rows. Running least and greatest ends of the stretch's edges
    then tell where a second exit, or an edge back before the first node, ends it, and which stretches are hammocks.
    """
    pre = (dfst(g) if tree is None else tree).select(*NODE, "pre")
    place = cut(order.select(*NODE, "k").join(pre, NODE))
    ends = g.edges.select("graph_id", "src", "dst").distinct()
    ends = ends.join(place.select("graph_id", F.col("node_id").alias("src"), F.col("k").alias("a")), ["graph_id", "src"])
    ends = cut(ends.join(place.select("graph_id", F.col("node_id").alias("dst"), F.col("k").alias("b"), F.col("pre").alias("b_pre")), ["graph_id", "dst"]).select("graph_id", "a", "b", "b_pre"))
    into = ends.groupBy("graph_id", F.col("b").alias("k")).agg(F.min("a").alias("low_in"), F.max("a").alias("high_in"))
    told = cut(place.select("graph_id", "k", "pre").join(into, ["graph_id", "k"], "left"))
    reach = _first_below(told, "low_in").join(told.select("graph_id", "k", "pre"), ["graph_id", "k"])
    steps = reach.select("graph_id", F.col("k").alias("first"), F.col("pre").alias("first_pre"), "n", F.explode(F.sequence("k", F.col("stop") - 1)).alias("k"))
    leaves = F.col("b_pre") < F.col("first_pre")
    out = steps.join(ends.withColumnRenamed("a", "k"), ["graph_id", "k"], "left").groupBy("graph_id", "first", "k", "n").agg(
        F.min(F.when(leaves, F.col("b"))).alias("exit_low"), F.max(F.when(leaves, F.col("b"))).alias("exit_high"), F.min(F.when(~leaves, F.col("b"))).alias("low_out"), F.max(F.when(~leaves, F.col("b"))).alias("high_out")
    )
    out = out.join(told.select("graph_id", "k", F.col("high_in")), ["graph_id", "k"])
    so_far = Window.partitionBy("graph_id", "first").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = F.when(F.col("k") > F.col("first"), F.col("high_in"))
    run = out.select("graph_id", "first", F.col("k").alias("last"), "n", *[f(c).over(so_far).alias(c) for f, c in ((F.min, "exit_low"), (F.max, "exit_high"), (F.min, "low_out"), (F.max, "high_out"))], F.max(inner).over(so_far).alias("high_in"))
    one = F.coalesce(F.col("exit_low") == F.col("exit_high"), F.lit(True)) & F.coalesce(F.col("low_out") >= F.col("first"), F.lit(True))
    high_out, high_in = (F.greatest("first", F.coalesce(c, "first")) for c in ("high_out", "high_in"))
    closed = high_in <= F.col("last")
    to = F.when(F.col("exit_low").isNotNull(), F.when((high_out <= F.col("last")) & closed, F.col("exit_low")))
    to = to.when(F.col("last") == F.col("n") - 1, -1).when((high_out == F.col("last") + 1) & closed, F.col("last") + 1)
    found = run.where(one).select("graph_id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), to.cast("int").alias("exit")).where("exit is not null")
    return found.join(ends.select("graph_id", F.col("a").alias("exit"), F.col("b").alias("first")), ["graph_id", "exit", "first"], "left_anti").select("graph_id", "first", "last", "exit")
