"""Groups of texts whose sets of word shingles are alike, every link confirmed on the full sets.

Candidates share a bucket. A few of each bucket are confirmed first and make groups; sketches then tell which groups may
still belong together, and these are compared whole, in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.components import connected_components
from flowgraph.llm.storage import materialize
from flowgraph.llm.textops import LOWER, gram_hashes, mix, ranges, slices, span_hashes, spans, text_bytes

NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[32, *range(9, 14)]] = False


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, bounds): 64-bit hashes of the distinct shingles of k words of each text, in order, and the n + 1 bounds between texts.

    Words are runs of bytes but space and \\t to \\r, A-Z lower-cased. A text of fewer than k words, but not none, is one
    shingle.
    """
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = spans(NOT_WHITE[data], offsets)
    words, sizes = span_hashes(data, starts, ends), np.diff(bounds)
    grams, at = gram_hashes(words, bounds, k)
    owner = np.searchsorted(bounds, at, side="right") - 1
    short = [(i, gram_hashes(words[bounds[i] : bounds[i + 1]], np.array([0, sizes[i]]), int(sizes[i]))[0]) for i in np.flatnonzero((sizes > 0) & (sizes < k))]
    if short:
        grams, owner = np.append(grams, np.concatenate([h for _, h in short])), np.append(owner, [i for i, _ in short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def set_digests(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set; equal sets have equal ones."""
    out = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    for i in range(2):
        sums = np.append(np.uint64(0), np.cumsum(mix(grams + np.uint64(7919 * i + 1))))
        out[:, i] = sums[bounds[1:]] - sums[bounds[:-1]]
    return out


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The size of the intersection of each set of a with the same row's set of b."""
    n = len(a[1]) - 1
    row = np.concatenate([np.repeat(np.arange(n), np.diff(x[1])) for x in (a, b)])
    both = np.concatenate([a[0], b[0]])
    order = np.lexsort((both, row))
    row, both = row[order], both[order]
    return np.bincount(row[1:][(row[1:] == row[:-1]) & (both[1:] == both[:-1])], minlength=n)


@dataclass(frozen=True)
class Sketches:
    """How candidates are found. All functions work on whole arrays.

    mark(grams, bounds): (sketches as rows of bytes, buckets as rows of 64-bit keys) of some sets. near(sketches, bounds,
    allowed): arrays (left, right) of rows that lie between the same bounds and are near enough to be a link;
    allowed(left, right) tells which pairs matter. agree(sketches, one): which rows are near enough to one. A pair that is
    alike must share a bucket and be near, but for a stated chance.
    """

    mark: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    near: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]
    agree: Callable[[np.ndarray, np.ndarray], np.ndarray]


def pairs_between(bounds: np.ndarray, step: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) of all pairs of rows that lie between the same bounds, some `step` at a time."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    counts = ends - np.arange(len(ends)) - 1
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        yield np.repeat(np.arange(at, to), counts[at:to]), ranges(np.arange(at, to) + 1, counts[at:to])
        at = to


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. texts: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a", 1_000_000):
            a, b = shingle_sets(batch.column("text_a"), k), shingle_sets(batch.column("text_b"), k)
            both = common(a, b)
            alike = (both > 0) & (100 * both >= percent * (np.diff(a[1]) + np.diff(b[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(alike))

    one, other = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _with_components(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return rows.withColumn("c", F.col("node"))
    return rows.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")


def _pivot_pairs(buckets: DataFrame, orders: int) -> DataFrame:
    """(a, b), for each node and each of some orders of all nodes: the node and the least of those that lead a bucket of it."""
    heads = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("rank"), "node")).alias(f"head{i}") for i in range(orders)]
    least = [F.min(f"head{i}").alias(f"head{i}") for i in range(orders)]
    chosen = buckets.join(buckets.groupBy("key").agg(*heads), "key").groupBy("node").agg(*least)
    pairs = chosen.select("node", F.explode(F.array(*[f"head{i}.node" for i in range(orders)])).alias("head")).where("node <> head")
    return pairs.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


#: Members of one part of a bucket: a cell compares two parts, or one with itself.
_PART = 512


def _cells(buckets: DataFrame, nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Rows of the cells of all buckets that hold more than one group: (key, i, j, part, node, c, n, sketch), sorted by cell."""
    rows = _with_components(buckets, groups)
    live = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    live = live.select("key", F.ceil(F.col("size") / _PART).cast("int").alias("parts"))
    rows = rows.join(live, "key").join(nodes.select("node", "n", "sketch"), "node")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "c", "n", "sketch")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _near_links(cells: DataFrame, near: Callable, percent: int) -> DataFrame:
    """(a, b): links that join all groups that near pairs join; of the groups in a batch of cells, fewer than there are groups."""

    def found(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = _changes(held, ["key", "i", "j"])
        c, n, part, whole = held["c"], held["n"], held["part"], held["i"] == held["j"]

        def allowed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            fits = 100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right])
            return (c[left] != c[right]) & (whole[left] | (part[left] != part[right])) & fits

        names, group = np.unique(c, return_inverse=True)
        labels = np.arange(len(names))
        for left, right in near(_rows_of(held["sketch"]), np.append(new, len(c)), allowed):
            left, right = group[left], group[right]
            while True:
                low = np.minimum(labels[left], labels[right])
                if (labels[left] == low).all() and (labels[right] == low).all():
                    break
                for end in (left, right):
                    np.minimum.at(labels, labels[end], low)
                    np.minimum.at(labels, end, low)
                while (labels != labels[labels]).any():
                    labels = labels[labels]
        at = np.flatnonzero(labels != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[labels[at]]), pa.array(names[at])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, ["key", "i", "j"]):
            yield found(held)

    return cells.mapInArrow(run, "a long, b long")


def _changes(held: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    """Where another key begins."""
    new = np.zeros(len(held[keys[0]]), dtype=bool)
    for key in keys:
        new[1:] |= held[key][1:] != held[key][:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _rows_of(sketches: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.tolist()), dtype=np.uint8).reshape(len(sketches), -1)


def _cluster_cells(clusters: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of the cells of clusters (node, c, cluster) that hold several groups: (cluster, i, j, guest, node, c, n, sketch, text).

    The largest group of a cluster stays in its parts; members of the others are guests of all parts as well, cut into
    parts of their own, so a cell holds at most two parts and a cluster of one large group costs little more than its rows.
    """
    sizes = clusters.groupBy("cluster", "c").agg(F.count("*").alias("size"))
    live = sizes.groupBy("cluster").agg(F.max(F.struct("size", "c")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("groups")).where("groups > 1")
    parts = lambda n: F.ceil(n / _PART).cast("int")
    live = live.select("cluster", F.col("main.c").alias("main"), parts(F.col("size")).alias("parts"), parts(F.col("size") - F.col("main.size")).alias("rest"))
    rows = clusters.join(live, "cluster").join(nodes.select("node", "n", "sketch"), "node").join(texts, "node")
    own = F.xxhash64("node")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["cluster", "i", "j", "guest", "node", "c", "n", "sketch", "text"]
    members = rows.withColumns({"i": F.pmod(own, F.col("parts")).cast("int"), "guest": F.lit(0)}).withColumn("j", every(F.col("rest"))).select(columns)
    guests = rows.where("c <> main").withColumns({"j": F.pmod(own, F.col("rest")).cast("int"), "guest": F.lit(1)}).withColumn("i", every(F.col("parts"))).select(columns)
    return members.unionByName(guests).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "guest")


def _alike_in_cells(cells: DataFrame, agree: Callable, k: int, percent: int) -> DataFrame:
    """(a, b): links between guests and members of different groups whose full sets are alike, enough to join what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, ["cluster", "i", "j"]):
            found: list[tuple[int, int]] = []
            new = _changes(held, ["cluster", "i", "j"])
            for lo, hi in zip(new, np.append(new[1:], len(held["node"]))):
                found += _alike({c: v[lo:hi] for c, v in held.items()}, agree, k, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _alike(cell: dict[str, np.ndarray], agree: Callable, k: int, percent: int) -> list[tuple[int, int]]:
    grams, bounds = shingle_sets(pa.array(cell["text"], pa.string()), k)
    sketches, sizes, split = _rows_of(cell["sketch"]), np.diff(bounds), int(np.searchsorted(cell["guest"], 1))
    _, grams = np.unique(grams, return_inverse=True)
    mine, groups = np.zeros(int(grams.max(initial=0)) + 1, dtype=bool), cell["c"].copy()
    found = []
    for at in range(split, len(sizes)):
        rows = np.flatnonzero((groups[:split] != groups[at]) & agree(sketches[:split], sketches[at]))
        rows = rows[100 * np.minimum(sizes[rows], sizes[at]) >= percent * np.maximum(sizes[rows], sizes[at])]
        if not len(rows):
            continue
        own = grams[bounds[at] : bounds[at + 1]]
        mine[own] = True
        both = np.add.reduceat(mine[grams[ranges(bounds[rows], sizes[rows])]], np.cumsum(sizes[rows]) - sizes[rows], dtype=np.int64)
        mine[own] = False
        for row in rows[100 * both >= percent * (sizes[rows] + sizes[at] - both)]:
            if groups[row] != groups[at]:
                found.append((int(cell["node"][row]), int(cell["node"][at])))
                groups[groups == groups[row]] = groups[at]
    return found


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Batches of a sorted stream as arrays, moved so that none ends inside a group of equal keys."""
    held: pa.Table | None = None
    for batch in batches:
        both = pa.Table.from_batches([batch])
        held = both if held is None else pa.concat_tables([held, both])
        if held.num_rows:
            last = np.ones(held.num_rows, dtype=bool)
            for key in keys:
                values = held.column(key).to_numpy()
                last &= values == values[-1]
            at = int(np.argmax(last))
            if at:
                yield {c: held.column(c).to_numpy() for c in held.column_names} if at == held.num_rows else {c: held.slice(0, at).column(c).to_numpy() for c in held.column_names}
                held = held.slice(at)
    if held is not None and held.num_rows:
        yield {c: held.column(c).to_numpy() for c in held.column_names}


def verified_groups(docs: DataFrame, sketches: Sketches, k: int, id_col: str, text_col: str, percent: int = 80, orders: int = 2) -> DataFrame:
    """(id, n_shingles, component_id) of verified_rows."""
    return verified_rows(docs, sketches, k, id_col, text_col, percent, orders).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def verified_rows(docs: DataFrame, sketches: Sketches, k: int, id_col: str, text_col: str, percent: int = 80, orders: int = 2) -> DataFrame:
    """(id, hash, n_shingles, component, component_id), one for each row: texts of which 100 * common shingles >= percent * all shingles, also over others, share a component.

    1. Texts are marked with sketches and buckets; equal sets are one node from here on, whatever their number.
    2. Each node is paired with the first node of its buckets in `orders` orders; confirmed pairs make groups.
    3. Buckets that still hold several groups are cut into cells. Near pairs of different groups join their groups to
       clusters; of these, links are kept and never pairs.
    4. Within a cluster, all near pairs of different groups are confirmed, but for those that others have joined before.
    So every near pair of a bucket is confirmed or lies in one group.

    Confirming compares the sets of the texts themselves; 64-bit hashes stand for shingles. Hot buckets and clusters are
    split by AQE in joins, and into cells of at most two parts of 512. component_id is the smallest id of the component; a
    null id names none. hash is the text's xxhash64. Rows that repeat an id are documents of their own. Texts without words (and null) are one component
    here, with n_shingles 0. An empty table gives an empty result; other columns are ignored. Ids must fit a long.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    read = read.withColumn("hash", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            grams, bounds = shingle_sets(batch.column("text"), k)
            digest, (marks, keys) = set_digests(grams, bounds).view(np.int64), sketches.mark(grams, bounds)
            flat = pa.array(keys.view(np.int64).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), flat)
            columns = [batch.column("id"), batch.column("hash"), pa.array(np.diff(bounds)), pa.array(digest[:, 0]), pa.array(digest[:, 1])]
            columns += [pa.array([m.tobytes() for m in marks], pa.binary()), listed]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "n", "d1", "d2", "sketch", "keys"])

    marked = materialize(read.mapInArrow(run, "id long, hash long, n long, d1 long, d2 long, sketch binary, keys array<long>"), "marked")
    nodes = marked.groupBy("d1", "d2", "n", "sketch", "keys").agg(F.min("id").alias("low"), F.min(F.struct("id", "hash")).alias("row"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = nodes.where("n > 0").select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    buckets = materialize(rows.join(shared, "key"), "buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "row.id", "row.hash"), "node").withColumnsRenamed({"id": "__id", "hash": "__hash"})
    texts = read.join(wanted, (F.col("hash") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("__id"))).groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "texts")
    links = materialize(_confirmed(_pivot_pairs(buckets, orders), texts, k, percent), "links")
    groups = connected_components(links)
    near = materialize(_near_links(_cells(buckets, nodes, groups), sketches.near, percent), "near")
    if not near.isEmpty():
        joined = connected_components(links.union(near)).withColumnRenamed("component", "cluster")
        clusters = _with_components(joined, groups)
        more = _alike_in_cells(_cluster_cells(clusters, nodes, texts), sketches.agree, k, percent)
        groups = connected_components(links.union(more))
    named = _with_components(nodes.select("d1", "d2", "n", "low", "node"), groups)
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "c").select("d1", "d2", "n", F.col("c").alias("component"), "component_id")
    return marked.select("id", "hash", "d1", "d2", "n").join(named, ["d1", "d2", "n"]).select("id", "hash", F.col("n").alias("n_shingles"), "component", "component_id")
