"""Files of token ids: range-coded blocks in document order, written and read in parallel."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgraph.llm import rans
from flowgraph.llm.storage import materialize
from flowgraph.llm.textops import slices
from flowgraph.llm.tokens import encoder

#: Blocks that are coded or decoded side by side.
_TOGETHER = 32


def _ordered_ids(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int) -> DataFrame:
    """(part, before, id, ids, counts): ids of each text in ascending id order within ranges; one row of counts a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encode, end = encoder(tokenizer, spaces).encode, np.array([end_id], dtype="<u4").tobytes()
        counts = np.zeros(end_id + 1, dtype=np.int64)
        for batch in slices(batches, "text", 6_000_000):
            ids = [x + end for x in encode(batch.column("text").fill_null("").to_pylist())]
            flat = np.frombuffer(b"".join(ids), dtype="<u4")
            own = np.bincount(flat, minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
            sizes = np.array([len(x) // 4 for x in ids])
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            narrow = [x.tobytes() for x in np.split(flat.astype("<u2") if int(flat.max()) < 1 << 16 else flat, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part)), pa.array(starts), batch.column("id"), pa.array(sizes), pa.array(narrow, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names
            )
        if before:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([before]), pa.nulls(1, pa.int64()), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    names = ["part", "before", "id", "n", "ids", "counts"]
    ordered = docs.repartitionByRange("id").sortWithinPartitions("id")
    return ordered.mapInArrow(run, "part long, before long, id long, n long, ids binary, counts binary")


def _symbol_counts(coded: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                counts = np.frombuffer(raw, dtype="<i8")
                there = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["symbol", "n"])

    return coded.where("counts is not null").select("counts").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


_BLOCK = "part long, first long, n int, crc long, payload binary, states binary, places array<int>, doc_ids array<long>, doc_sizes array<long>, doc_starts array<long>"


def write_token_file(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", spaces: bool = True, end_id: int = 2) -> None:
    """Writes the ids of every text, each followed by end_id, in ascending id order below path.

    path/table holds the frequency of each symbol over all texts, in 2**20 parts; path/parts the number of ids before
    each part; path/blocks a row for each block of at most 65,536 ids: its place, its size, the CRC-32 of its ids as
    little-endian unsigned 32-bit, the coded words, the lanes' states and places in the words at every checkpoint (so
    that a reader can start there), and the documents with their sizes and the first one's offset. Blocks are coded
    independently with the shared frequencies. Spark's writer commits a task's file only once.

    Null and empty texts are the end id alone. Null ids come first. Repeated rows are each written. No document, no
    block. The table of frequencies is as large as the vocabulary and the only thing that the driver gathers, besides
    one row a part.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    coded = materialize(_ordered_ids(read, tokenizer, spaces, end_id), "ids")
    counts = _symbol_counts(coded).orderBy("symbol").toArrow()
    symbols = counts.column("symbol").to_numpy()
    freqs = rans.quantized(counts.column("n").to_numpy()) if len(symbols) else symbols
    spark.createDataFrame(list(zip(symbols.tolist(), freqs.tolist())), "symbol long, freq long").coalesce(1).write.parquet(f"{path}/table")
    parts = coded.where("counts is not null").select("part", "before").orderBy("part").collect()
    bases = [0, *accumulate(r.before for r in parts)][:-1]
    spark.createDataFrame([(r.part, b) for r, b in zip(parts, bases)], "part long, base long").coalesce(1).write.parquet(f"{path}/parts")
    table = spark.sparkContext.broadcast((symbols, freqs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rans.Table.of(*table.value)
        waiting: list[tuple] = []
        for block in _cut(batches):
            waiting.append(block)
            if len(waiting) == _TOGETHER:
                yield _coded(waiting, known)
                waiting = []
        if waiting:
            yield _coded(waiting, known)

    coded.where("counts is null").select("part", "before", "id", "n", "ids").mapInArrow(run, _BLOCK).write.parquet(f"{path}/blocks")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, first, ids, docs) of blocks; docs: (id, size, the block's offset in it). Only rows next to each other meet."""
    part, first, held, n, docs = None, 0, [], 0, []
    for batch in batches:
        for p, before, key, size, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "id", "n", "ids"))):
            ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * size else "<u4").astype(np.uint32)
            if p != part or before != first + n:
                if n:
                    yield part, first, np.concatenate(held), docs
                part, first, held, n, docs = p, before, [], 0, []
            at = 0
            while at < size:
                take = min(size - at, rans.BLOCK - n)
                held.append(ids[at : at + take])
                docs.append((key, size, at))
                n, at = n + take, at + take
                if n == rans.BLOCK:
                    yield part, first, np.concatenate(held), docs
                    first, held, n, docs = first + n, [], 0, []
    if n:
        yield part, first, np.concatenate(held), docs


def _coded(blocks: list[tuple], table: rans.Table) -> pa.RecordBatch:
    rows = [
        {"part": part, "first": first, "doc_ids": [d[0] for d in docs], "doc_sizes": [d[1] for d in docs], "doc_starts": [d[2] for d in docs]} | one
        for (part, first, _, docs), one in zip(blocks, rans.encode([b[2] for b in blocks], table))
    ]
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema(
    [("part", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("crc", pa.int64()), ("payload", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int32()))]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "doc_sizes", "doc_starts")]
)


def read_token_file(spark: SparkSession, path: str, whole_ids: bool = True) -> DataFrame:
    """(doc_id, start, size, offset, n, crc, ids): the ids of each document, in one row for every block that it lies in.

    start is the number of ids of all documents before this one, offset that of the document's ids before this row,
    n of size ids follow as little-endian unsigned 32-bit, with their CRC-32. Without whole_ids the ids of documents that
    lie in one block are null, for readers who want sums only; all ids are decoded still. A block that does not match its checksum ends the job.
    """
    rows = spark.read.parquet(f"{path}/table").toArrow()
    table = spark.sparkContext.broadcast((rows.column("symbol").to_numpy(), rows.column("freq").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rans.Table.of(*table.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                blocks = batch.slice(at, _TOGETHER).to_pylist()
                for block, ids in zip(blocks, rans.decode(blocks, known)):
                    sizes, offsets = np.array(block["doc_sizes"]), np.array(block["doc_starts"])
                    n = sizes - offsets
                    n[-1] = len(ids) - n[:-1].sum()
                    ends = np.cumsum(n)
                    start = block["base"] + block["first"] + ends - n - offsets
                    raw = [x.tobytes() for x in np.split(ids.astype("<u4"), ends[:-1])]
                    crcs = [zlib.crc32(x) for x in raw]
                    kept = [x if whole_ids or short else None for x, short in zip(raw, n < sizes)]
                    yield pa.RecordBatch.from_arrays([pa.array(block["doc_ids"], pa.int64()), pa.array(start), pa.array(sizes), pa.array(offsets), pa.array(n), pa.array(crcs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "start", "size", "offset", "n", "crc", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks").join(spark.read.parquet(f"{path}/parts"), "part")
    return blocks.mapInArrow(run, "doc_id long, start long, size long, offset long, n long, crc long, ids binary")
