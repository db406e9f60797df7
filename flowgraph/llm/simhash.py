"""SimHash fingerprints and near-duplicate groups found by BK-trees over shards of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.components import connected_components
from flowgraph.llm.storage import materialize
from flowgraph.llm.textops import mix, slices
from flowgraph.llm.verified import Sketches, verified_rows

#: Shingles whose bits are counted at a time.
_STEP = 100_000


def text_fingerprint_counts(words: list[bytes], k: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes set each of the 64 bits, and the number of shingles."""
    import xxhash

    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0
    if not words:
        return counts, 0
    if len(words) < k:
        grams: Iterator[bytes] = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k))))
    while True:
        part = np.fromiter((digest(g, 42) for _, g in zip(range(_STEP), grams)), dtype=np.uint64)
        if not len(part):
            return counts, total
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(part)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each text as a signed long.

    Words are maximal runs of non-white ASCII, A-Z lower-cased; shingles of k words count as often as they
    occur and are hashed by XXH64 with seed 42. A bit is 1 if more than half the hashes set it. A text of
    fewer than k words is one shingle; null and empty texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in slices(batches, "text"):
            fps = np.zeros(batch.num_rows, dtype=np.uint64)
            for i, text in enumerate(batch.column("text")):
                counts, n = text_fingerprint_counts((text.as_py() or "").encode().lower().split(), k)
                fps[i] = bits[2 * counts > n].sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {kind}, fp long")


def distances(values: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which each row of values (64-bit words) differs from one."""
    return np.bitwise_count(values ^ one).sum(axis=1, dtype=np.int64)


class BKTree:
    """A BK-tree over rows of 64-bit words: a child hangs on the edge of its distance to the parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[list[tuple[int, int]]] = [[] for _ in values]
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            members = todo.pop()
            node, rest = int(members[0]), members[1:]
            if len(rest):
                far = distances(values[rest], values[node])
                for edge in np.unique(far):
                    below = rest[far == edge]
                    self.children[node].append((int(edge), int(below[0])))
                    todo.append(below)

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, indexes of the queries within the radius of it), following only edges that can lead there."""
        todo = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while todo:
            node, asked = todo.pop()
            far = distances(queries[asked], self.values[node])
            near = asked[far <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                go = asked[np.abs(far - edge) <= radius]
                if len(go):
                    todo.append((child, go))


#: Rows from which on a shard's first members are compared with all others before a tree is built, and so many of them.
_DENSE, _PIVOTS = 256, 16


def merge(labels: np.ndarray, members: np.ndarray) -> None:
    met = np.unique(labels[members])
    if len(met) > 1:
        labels[np.isin(labels, met)] = met[0]


def linked(values: np.ndarray, radius: int, known: np.ndarray | None = None) -> np.ndarray:
    """labels: rows within the radius of each other, also over others, have the same label, the lowest index among them.

    known: labels to start from. Where many rows are near copies of each other, a few of them reach nearly all; pairs of
    one label need not be compared any more, so the tree is asked only by rows outside the largest group.
    """
    labels = np.arange(len(values)) if known is None else known
    if len(values) > _DENSE:
        for _ in range(_PIVOTS):
            outside = np.flatnonzero(labels != _main(labels))
            if not len(outside):
                return labels
            pivot = outside[0]
            merge(labels, np.append(np.flatnonzero(distances(values, values[pivot]) <= radius), pivot))
        queries = np.flatnonzero(labels != _main(labels))
    else:
        queries = np.arange(len(values))
    for node, near in BKTree(values).within(values[queries], radius):
        merge(labels, np.append(queries[near], node))
    return labels


def _main(labels: np.ndarray) -> int:
    """The label of most rows."""
    return int(np.argmax(np.bincount(labels)))


def shard_links(rows: DataFrame, shard: list[str], radius: int, shard_rows: int, pivots: int = 64) -> DataFrame:
    """(a, b) links between representatives of fingerprints that share a shard; chains of them join all within the radius.

    rows: shard columns, fp (binary, 64-bit words), rep; a fingerprint is in a shard once. Each shard is a BK-tree that
    only its own members ask. A shard of more than shard_rows is cut into parts. About `pivots` of its members go to all
    parts; who is linked to their main group, in whatever part, is linked to all others that are. Only the rest is sent
    to all parts and asked there, so a large group of near copies costs no more than its rows, and no task holds more
    than a part and the rest.
    """
    sizes = rows.groupBy(*shard).agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("size") / shard_rows).cast("int")), "shards")
    hot = sizes.where("parts > 1")
    small = rows.join(sizes.where("parts = 1").select(*shard), shard).repartition(*shard).sortWithinPartitions(*shard, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _sorted_groups(batches, shard):
            yield from _as_links(linked(_matrix(group["fp"]), radius), group["rep"])

    found = small.mapInArrow(run, "a long, b long")
    if hot.isEmpty():
        return found.distinct()
    keys, kinds = [*shard, "part"], {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    own = rows.join(F.broadcast(hot) if hot.count() < 10_000 else hot, shard)
    own = own.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    chosen = own.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.col("size")) < pivots)
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    guests = chosen.select(*shard, "fp", "rep", "parts", everywhere, F.lit(1).alias("guest"))
    both = own.select(*shard, "fp", "rep", "parts", "part", F.lit(0).alias("guest")).unionByName(guests)
    both = both.repartition(*keys).sortWithinPartitions(*keys, "guest", "fp")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within parts and with pivots; then the members that are not linked to the pivots' main group."""
        for group in _sorted_groups(batches, keys):
            values, guest, rep = _matrix(group["fp"]), group["guest"] == 1, group["rep"]
            pivot = np.flatnonzero(guest)
            labels = np.arange(len(rep))
            if len(pivot):
                among = linked(values[pivot], radius)
                labels[pivot] = pivot[among]
                main = pivot[among[0] if len(pivot) == 1 else _main(among)]
            labels = linked(values, radius, labels)
            yield from _as_links(labels, rep, ["a", "b", *keys, "fp", "rep", "parts"], kinds)
            rest = np.flatnonzero(~guest & ((labels != labels[main]) if len(pivot) else True))
            if len(rest):
                none = pa.nulls(len(rest), pa.int64())
                columns = [none, none, *(pa.array(group[c][rest]) for c in (*keys, "fp", "rep", "parts"))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", *keys, "fp", "rep", "parts"])

    types = ", ".join(f"{c} {kinds.get(c, 'int')}" for c in (*keys, "fp", "rep", "parts"))
    told = materialize(both.mapInArrow(first, f"a long, b long, {types}"), "parts")
    rest = told.where("rep is not null").select(*shard, "fp", "rep", everywhere, F.lit(1).alias("guest"))
    if not rest.isEmpty():
        again = own.select(*shard, "fp", "rep", "part", F.lit(0).alias("guest")).join(rest.select(*shard).distinct(), shard, "left_semi")
        again = again.unionByName(rest).repartition(*keys).sortWithinPartitions(*keys, "guest", "fp")

        def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _sorted_groups(batches, keys):
                values, guest = _matrix(group["fp"]), group["guest"] == 1
                labels, asks = np.arange(len(values)), np.flatnonzero(guest)
                for node, near in BKTree(values).within(values[asks], radius):
                    merge(labels, np.append(asks[near], node))
                yield from _as_links(labels, group["rep"])

        found = found.union(again.mapInArrow(second, "a long, b long"))
    return found.union(told.where("a is not null").select("a", "b")).distinct()


def _as_links(labels: np.ndarray, rep: np.ndarray, names: list[str] | None = None, kinds: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Links of each row to the first one of its label, with nulls for further columns."""
    at = np.flatnonzero(rep[labels] != rep)
    if len(at):
        columns, names = [pa.array(rep[labels[at]]), pa.array(rep[at])], names or ["a", "b"]
        columns += [pa.nulls(len(at), _NULLS[(kinds or {}).get(c, "int")]) for c in names[2:]]
        yield pa.RecordBatch.from_arrays(columns, names=names)


_NULLS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _matrix(fps: np.ndarray) -> np.ndarray:
    """Binary fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(fps.tolist()), dtype="<u8").reshape(len(fps), -1).astype(np.uint64)


def near_links(fps: DataFrame, radius: int = 3, shard_rows: int = 20_000, full_bucket: int = 256) -> DataFrame:
    """(a, b) links between the representatives of distinct fingerprints; chains of them join all within the radius.

    fps: (fp, rep), fp distinct. The 64 bits are cut into blocks; fingerprints within the radius agree in all
    blocks but radius of them, so each choice of the other blocks makes shards that together miss no pair. The
    number of blocks grows with the table, so that a shard of unrelated fingerprints stays small.
    """
    n = fps.count()
    blocks = radius + 1
    while blocks < radius + 5 and n / 2 ** (64 * (blocks - radius) // blocks) > full_bucket:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shard = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))
    as_bytes = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    rows = fps.where("rep is not null").select("fp", "rep", shard.alias("s")).select(as_bytes.alias("fp"), "rep", "s.*")
    return shard_links(rows, ["choice", "bits"], radius, shard_rows)


def _sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key of a sorted stream, as arrays; the last group of a batch waits for the next batch."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        new = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        new[0] = not held or any(held[-1][k][-1] != cols[k][0] for k in keys)
        cuts = np.flatnonzero(new)
        for at, to in zip(np.append(0, cuts), np.append(cuts, batch.num_rows)):
            if to > at:
                held.append({c: v[at:to] for c, v in cols.items()})
            if held and to < batch.num_rows:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 3, shard_rows: int = 20_000) -> DataFrame:
    """(id, fp, component_id): documents whose fingerprints differ in at most radius bits, also over others, share a component.

    component_id is the smallest id of the component, itself included. Equal fingerprints are one node, so a large
    group of copies costs no more than one document. Repeated ids and texts are kept as rows. Null and empty texts
    have fingerprint 0 and link like any other. A null id stays in the result, with the component of its
    fingerprint, but never names one. An empty table gives an empty result; other columns are ignored.
    """
    marked = materialize(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", k), "simhash")
    fps = materialize(marked.groupBy("fp").agg(F.min("id").alias("rep")), "fps")
    groups = connected_components(near_links(fps, radius, shard_rows))
    named = fps.join(groups, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: Bits of the fingerprints of near_copy_groups, in 64-bit words; words of its shingles.
COPY_WORDS, COPY_SHINGLE = 4, 5


def copy_marks(grams: np.ndarray, bounds: np.ndarray, bands: int, values: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHashes of COPY_WORDS words over sets of shingles, as rows of bytes, and each set's shard of each band.

    A shard is named by the least hashes of the set's shingles under `values` orders, so two sets share that of a band
    with a chance of their similarity to the power of `values`.
    """
    n = np.diff(bounds)
    own = np.flatnonzero(n)
    fps, shards = np.zeros((len(n), COPY_WORDS), dtype="<u8"), np.zeros((len(n), bands), dtype=np.uint64)
    if len(own):
        first = bounds[own]
        for i in range(COPY_WORDS):
            bits = np.unpackbits(mix(grams + np.uint64(i + 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = 2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > n[own][:, None]
            fps[own, i] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
        for band in range(bands):
            key = np.full(len(own), np.uint64(band))
            for i in range(values):
                key = mix(key + np.minimum.reduceat(mix(grams + np.uint64(1000 + band * values + i)), first))
            shards[own, band] = key
    return fps.view(np.uint8).reshape(len(n), -1), shards


def copy_sketches(radius: int, bands: int, values: int) -> Sketches:
    """SimHashes that meet in the BK-trees of shards."""

    def near(marks: np.ndarray, bounds: np.ndarray, allowed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words = np.ascontiguousarray(marks).view("<u8").astype(np.uint64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            for node, close in BKTree(words[lo:hi]).within(words[lo:hi], radius):
                left, right = lo + close, np.full(len(close), lo + node)
                keep = allowed(left, right)
                yield left[keep], right[keep]

    def agree(marks: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.bitwise_count(marks ^ one).sum(axis=1, dtype=np.int64) <= radius

    return Sketches(lambda grams, bounds: copy_marks(grams, bounds, bands, values), near, agree)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 60, bands: int = 8, values: int = 2) -> DataFrame:
    """(id, hash, component, component_id): near copies by five-word shingles, every link confirmed; see near_copy_groups.

    One row for each row of docs: hash is its text's xxhash64, component the group of this very row.
    """
    return verified_rows(docs, copy_sketches(radius, bands, values), COPY_SHINGLE, id_col, text_col).drop("n_shingles")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, component_id): documents whose sets of 5-word shingles have a similarity (Jaccard) of 0.8 or more share a component.

    Candidates are read off SimHashes of 256 bits: sets of similarity 0.8 differ in 39 bits on average, with a deviation
    of 6, and `radius` is 60. Fingerprints meet in the BK-trees of shards that the texts' least shingle hashes name,
    8 bands of 2; a pair of similarity 0.8 shares none in 0.03 % of the cases. Unrelated texts share no shard, however many
    there are. A candidate is a link only if the full sets of shingles are alike (see verified_groups), so every member of
    a component is joined to the others by a chain of confirmed pairs. A text of fewer than five words is one shingle;
    texts without words are copies of each other. component_id is the smallest id of the component. Null ids stay, but name
    no component; rows that repeat an id are documents of their own; an empty table gives an empty result.
    """
    return copy_groups(docs, id_col, text_col, **options).select(F.col("id").alias(id_col), "component_id")


def keep_one_copy(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies of others: of each group, the row of the smallest id stays (of rows that repeat that id, the one of the least text hash).

    Rows with a null id stay. Rows that repeat id and text are one document and go or stay together. Other columns stay.
    """
    found = copy_groups(docs, id_col, text_col, **options).where("id is not null")
    first = found.where("id = component_id").groupBy("component").agg(F.min("hash").alias("first"))
    twins = found.where("id = component_id").join(first, "component").where("hash <> first").select("id", "hash")
    gone = found.where("id <> component_id").select("id", "hash").union(twins).distinct().withColumnsRenamed({"id": "__gone_id", "hash": "__gone_hash"})
    same = (F.col(id_col).cast("long") == F.col("__gone_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__gone_hash"))
    return docs.join(gone, same, "left_anti")


def fingerprint_hex(fp: str = "fp"):
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_duplicate_groups, **options) -> DataFrame:
    """The rows of docs whose id is the smallest of its group, as `groups` finds them; rows with a null id stay.

    Rows that repeat an id are one document: if one of them is a copy of an earlier document, all go.
    """
    found = groups(docs, id_col, text_col, **options)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
