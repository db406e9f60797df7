"""Bounded-space online packing of token ids into sequences of a fixed length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.storage import materialize
from flowgraph.llm.textops import slices
from flowgraph.llm.tokens import encoder

_FIELDS = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Puts pieces (doc, start, ids, doc_tokens) into at most `windows` open sequences of `size` ids.

    A piece goes where it leaves the least room. If it fits nowhere and all windows are open, the fullest one is
    emitted; if more than max_pad ids of it would be padding, the piece's head fills it first.
    """

    def __init__(self, size: int, windows: int, max_pad: int, first_id: int):
        self.size, self.windows, self.max_pad, self.next = size, windows, max_pad, first_id
        self.open: list[tuple[int, int]] = []  # (room, window), ascending
        self.held: dict[int, list[tuple]] = {}

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        while len(ids) >= 4 * self.size:
            yield from self._emit([(doc, start, ids[: 4 * self.size], total)])
            start, ids = start + self.size, ids[4 * self.size :]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.open, (n, -1))
            if at < len(self.open):
                room, window = self.open.pop(at)
            elif len(self.open) < self.windows:
                room, window = self.size, self.next
                self.next += 1
                self.held[window] = []
            else:
                room, window = self.open.pop(0)
                if room > self.max_pad:
                    self.held[window].append((doc, start, ids[: 4 * room], total))
                    start, ids = start + room, ids[4 * room :]
                yield from self._emit(self.held.pop(window), window)
                continue
            self.held[window].append((doc, start, ids, total))
            ids = b""
            if room > n:
                insort(self.open, (room - n, window))
            else:
                yield from self._emit(self.held.pop(window), window)

    def _emit(self, pieces: list[tuple], window: int | None = None) -> Iterator[tuple]:
        if window is None:
            window, self.next = self.next, self.next + 1
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids) // 4, ids, total, window, offset
            offset += len(ids) // 4

    def leftovers(self) -> Iterator[tuple]:
        """The pieces of the windows that are still open, the fullest first, without a sequence."""
        for _, window in self.open:
            for doc, start, ids, total in self.held[window]:
                yield doc, start, len(ids) // 4, ids, total, None, None

    def close(self) -> Iterator[tuple]:
        """Fills the last windows one after another, so that only the very last one is short."""
        pieces, room = [], self.size
        for doc, start, _, ids, total, _, _ in self.leftovers():
            while ids:
                part = ids[: 4 * room]
                pieces.append((doc, start, part, total))
                start, ids, room = start + len(part) // 4, ids[4 * room :], room - len(part) // 4
                if not room:
                    yield from self._emit(pieces)
                    pieces, room = [], self.size
        yield from self._emit(pieces)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", spaces: bool = False, end_id: int = 1, size: int = 2048, windows: int = 64, max_pad: int = 4, merge: int = 32) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every text's ids and end_id are cut where the packing needs it; each id is in one piece, and the pieces of a
    sequence lie side by side from offset 0 up to `size` ids or, but for the last sequence of all, max_pad fewer.
    Each partition packs online with a fixed number of open windows; what is left open is packed again, `merge`
    partitions at a time, until one task holds the last windows. A task never holds more than merge * windows
    sequences. Every step is written to the shared folder, so sequence ids do not change when an executor is lost.

    Null and empty texts are the end id alone. Null ids stay null; repeated rows are packed each. An empty table
    gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId()
        coder, end = encoder(tokenizer, spaces), np.array([end_id], dtype="<u4").tobytes()
        packer = Packer(size, windows, max_pad, own << 28)
        for batch in slices(batches, "text", 6_000_000):
            rows = []
            for key, ids in zip(batch.column("id").to_pylist(), coder.encode(batch.column("text").fill_null("").to_pylist())):
                rows += packer.add(key, 0, ids + end, len(ids) // 4 + 1)
            yield _batch(rows, own)
        coder.forget()
        yield _batch(list(packer.leftovers()), own)

    done, left = [], materialize(read.mapInArrow(first, f"{_SCHEMA}, part long, row long"), "packed")
    level = 0
    while True:
        done.append(left.where("sequence_id is not null").select(_FIELDS))
        left = left.where("sequence_id is null")
        parts = left.agg(F.countDistinct(F.floor(F.col("part") / merge)), F.count("*")).first()
        if not parts[1]:
            break
        level += 1
        last = parts[0] == 1
        again = _packed_again(size, windows, max_pad, level << 56, last)
        grouped = left.withColumn("group", F.floor(F.col("part") / merge)).groupBy("group")
        left = materialize(grouped.applyInArrow(again, f"{_SCHEMA}, part long, row long"), "packed")
        if last:
            done.append(left.select(_FIELDS))
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.withColumnRenamed("doc_id", id_col)


def _packed_again(size: int, windows: int, max_pad: int, base: int, last: bool):
    def again(key: tuple, rows: pa.Table) -> pa.Table:
        own = key[0].as_py()
        packer, out = Packer(size, windows, max_pad, base + (own << 28)), []
        rows = rows.sort_by([("part", "ascending"), ("row", "ascending")])
        for piece in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            out += packer.add(*piece)
        out += packer.close() if last else packer.leftovers()
        return pa.Table.from_batches([_batch(out, own)])

    return again


def _columns(rows: list[tuple], part: int) -> dict[str, list]:
    columns = zip(*rows) if rows else [[] for _ in _FIELDS]
    return dict(zip(_FIELDS, map(list, columns))) | {"part": [part] * len(rows), "row": list(range(len(rows)))}


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(_columns(rows, part), schema=_ARROW)


_ARROW = pa.schema([*[(c, pa.binary() if c == "ids" else pa.int64()) for c in _FIELDS], ("part", pa.int64()), ("row", pa.int64())])
