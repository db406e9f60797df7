"""A Merkle manifest of a table: leaves of rows, a tree for each group, a tree over the groups, and every row's proof.

Spark SQL alone. Aligned blocks of 8 ** 3 nodes keep each level as one string of hex digits, so a parent is the hash of a
fixed-width substring and a node's siblings are the substrings beside it. A block's root is a node of the next round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgraph.llm.storage import materialize

#: Children of a node as a power of 2 and as a number, levels that one block holds, nodes of a block, hex digits of a digest.
BITS, LEVELS, WIDTH = 3, 3, 64
FANOUT, BLOCK = 1 << BITS, 1 << BITS * LEVELS


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 in hex of the values one after another: `-` for null, else the UTF-8 bytes' count, a colon and the value as text."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """rows with place (from 0, within the group) and size (rows of the group), in the order of `order`, null first.

    The rows are dealt by ranges of group and order, so a hot group lies in many tasks; a row's place is its number in its
    task and the count of its group in the tasks before. Only one row for each task and group is ever gathered by
    group. Rows that tie in `order` must be alike, as their places are arbitrary.
    """
    spread = rows.repartitionByRange(*[F.asc(c) for c in (*group, *order)]).sortWithinPartitions(*group, *order)
    told = materialize(spread.withColumn("__n", F.monotonically_increasing_id()).withColumn("__task", F.shiftrightunsigned("__n", 33).cast("int")), name)
    parts = told.groupBy(*group, "__task").agg(F.min("__n").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*group).orderBy("__task")
    parts = parts.select(
        *[F.col(c).alias(f"__{c}") for c in group],
        F.col("__task").alias("__t"),
        (F.coalesce(F.sum("__rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(Window.partitionBy(*group)).alias("size"),
    )
    same = F.col("__task") == F.col("__t")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return told.join(parts, same).select(*rows.columns, (F.col("__n") + F.col("__shift")).alias("place"), "size")


def _parents(level: Column) -> Column:
    """The next level's string: the hash of each substring of FANOUT digests."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FANOUT * WIDTH)).cast("int"))  # of one digest at least
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * (FANOUT * WIDTH) + 1, F.lit(FANOUT * WIDTH)), 256)), "").cast("binary")


def _blocks(nodes: DataFrame, group: list[str], name: str) -> DataFrame:
    """nodes (group, place, size, digest, payload) as blocks: (group, block, size, members, level0..level3, root, done).

    members are structs (place, payload) in order. levelN are strings of digests as bytes; a level is null above the
    group's root. done tells that root is the group's root.
    """
    block = F.shiftright("place", BITS * LEVELS)
    members = F.array_sort(F.collect_list(F.struct("place", "digest", "payload"))).alias("members")
    found = nodes.groupBy(*group, block.alias("block"), "size").agg(members)
    found = found.withColumn("level0", F.array_join(F.transform("members", lambda m: m["digest"]), "").cast("binary"))
    found = found.withColumn("members", F.transform("members", lambda m: F.struct(m["place"].alias("place"), m["payload"].alias("payload"))))
    for k in range(1, LEVELS + 1):
        found = found.withColumn(f"level{k}", F.when(F.col("size") > FANOUT ** (k - 1), _parents(F.col(f"level{k - 1}"))))
    root = F.coalesce(*[F.col(f"level{k}") for k in reversed(range(LEVELS + 1))]).cast("string")
    return materialize(found.withColumns({"root": root, "done": F.col("size") <= BLOCK}), name)


def _siblings(place: Column) -> Column:
    """The digests on both sides of a node of a block in its runs, an array of structs (left, right) from the lowest level up."""
    levels = []
    for k in range(LEVELS):
        at = F.shiftright((place % BLOCK).cast("int"), BITS * k)
        run, child = F.shiftright(at, BITS) * (FANOUT * WIDTH), at % FANOUT * WIDTH
        level = F.col(f"level{k}")
        left = F.substring(level, run + 1, child)
        right = F.substring(level, run + child + WIDTH + 1, F.lit((FANOUT - 1) * WIDTH) - child)
        levels.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*levels), lambda s: s.isNotNull())


def _tree(nodes: DataFrame, group: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, the lowest first, and the groups' roots (group, root).

    A round makes 512 nodes one, so rounds are the logarithm of the largest group.
    """
    rounds = []
    while True:
        blocks = _blocks(nodes, group, f"{name}{len(rounds)}")
        rounds.append(blocks)
        more = blocks.where("not done")
        if more.isEmpty():
            break
        nodes = more.select(*group, F.col("block").alias("place"), F.shiftright(F.col("size") + (BLOCK - 1), BITS * LEVELS).alias("size"), F.col("root").alias("digest"), F.lit(0).alias("payload"))
    roots = rounds[0].where("done").select(*group, "root")
    for blocks in rounds[1:]:
        roots = roots.union(blocks.where("done").select(*group, "root"))
    return rounds, roots


def _join_null_safe(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """a and b's further columns where the columns are equal, null with null."""
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(b.withColumnsRenamed({c: f"__{c}" for c in columns}), same).drop(*[f"__{c}" for c in columns])


def _paths(rounds: list[DataFrame], group: list[str], top: DataFrame) -> DataFrame:
    """(group, place, payload, path, above) of the lowest nodes: siblings of each level from the node up, then top's path.

    top: (group, path, above), one row a group. It meets the groups' last blocks alone, and each block's siblings are then
    handed down to its members, so no join has a hot key.
    """
    upper: DataFrame | None = None
    for blocks in reversed(rounds):
        ends = _join_null_safe(blocks.where("done"), top, group)
        if upper is not None:
            low = upper.select(*group, F.col("place").alias("block"), "path", "above")
            ends = ends.unionByName(_join_null_safe(blocks.where("not done"), low, [*group, "block"]))
        each = F.transform("members", lambda m: F.struct(m["place"].alias("place"), m["payload"].alias("payload"), F.concat(_siblings(m["place"]), F.col("path")).alias("path")))
        upper = ends.select(*group, "above", F.inline(each))
    return upper


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Callable[[Column], Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, folded_root): each row's leaf, its group's root, the table's root and its proof.

    A leaf hashes the row's columns (see leaf_hash). In each group, leaves stand by id; every 8 consecutive nodes, the last
    ones even if fewer or one, become the hash of their digests, until one is left: the subroot. The subroots, by
    group, the null group first and the others by bytes, become the root in the same way. path has the digests left and
    right of the node on each level, from the leaf to the root. folded_root is the root computed anew along the path
    from the leaf, or, in rows that meet `where`, from the leaf with `tampered` applied to the last of columns.

    No group is gathered: places come from dealing by ranges, and blocks hold 512 nodes, so one group may have any
    number of rows. Every round is written to the shared folder. Nulls may stand in any column; null ids come first.
    Rows that repeat an id stand by their leaves; equal rows are equal leaves. An empty table gives an empty result.
    Other columns are ignored; the given ones may have any names.
    """
    base = [F.col(c) for c in columns]
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(F.lit(True) if where is None else where, leaf_hash([*base[:-1], tampered(base[-1])]))
    hashed = docs.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).alias("id"), leaf_hash(base).alias("digest"), changed.alias("changed"))
    leaves = placed(materialize(hashed, "hashed"), ["g"], ["id", "digest"], "leaves")  # written first, as dealing by ranges reads twice
    payload = F.struct("id", F.col("digest").alias("leaf"), "changed").alias("payload")
    rounds, roots = _tree(leaves.select("g", "place", "size", "digest", payload), ["g"], "blocks")
    roots = materialize(roots.select("g", F.col("root").alias("subroot")), "subroots")
    named = placed(roots.withColumn("all", F.lit(0)), ["all"], ["g", "subroot"], "groups")
    high, top = _tree(named.select("all", "place", "size", F.col("subroot").alias("digest"), F.struct("g", "subroot").alias("payload")), ["all"], "tops")
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    over = _paths(high, ["all"], top.select("all", none.alias("path"), F.col("root").alias("above")))
    over = over.select(F.col("payload.g").alias("g"), "path", F.struct("payload.subroot", F.col("above").alias("root")).alias("above"))
    found = _paths(rounds, ["g"], over)
    first = F.coalesce("payload.changed", "payload.leaf").cast("binary")
    folded = F.aggregate("path", first, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256).cast("binary"))
    return found.select(F.col("payload.id").alias(id_col), F.col("payload.leaf").alias("leaf"), "above.subroot", "above.root", "path", folded.cast("string").alias("folded_root"))


def proof_digest(path: str = "path") -> Column:
    """SHA-256 in hex of all digests of a path, level by level from the leaf's, left to right."""
    return F.sha2(F.aggregate(path, F.lit("").cast("binary"), lambda a, s: F.concat(a, s["left"], s["right"])), 256)
