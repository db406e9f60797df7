"""Deletion of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.decontaminate import _filter_bits, _in_filter
from flowgraph.llm.storage import materialize
from flowgraph.llm.textops import slices


def line_list(text: str) -> list[str]:
    """Lines as they are compared: without the white space around them."""
    return [line.strip() for line in text.split("\n")]


def line_hash(line: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def shortest_windows(sizes: list[int], min_words: int) -> list[tuple[int, int]]:
    """(lo, hi) of the shortest runs of lines with min_words words from each line on, and up to each line.

    Every run of lines with at least min_words words is the union of such windows inside it, and the words of a window
    alone decide that it is one, so a run that stands twice has the same windows at both places.
    """
    ends = np.append(0, np.cumsum(np.array(sizes, dtype=np.int64)))
    to = np.searchsorted(ends, ends[:-1] + min_words)
    lo = np.searchsorted(ends, ends[1:] - min_words, side="right") - 1
    starts, stops = np.flatnonzero(to < len(ends)), np.flatnonzero(lo >= 0)
    return sorted({*zip(starts.tolist(), to[starts].tolist()), *zip(lo[stops].tolist(), (stops + 1).tolist())})


def minima(values: list[int], windows: list[tuple[int, int]]) -> list[int]:
    """The place of each window's least line hash, the first of equal ones: the line that winnowing selects."""
    return [min(range(lo, hi), key=values.__getitem__) for lo, hi in windows]


class _Lines:
    """The lines of a text that are not empty, their hashes, shortest windows and the windows' minima."""

    def __init__(self, text: str | None, min_words: int):
        lines = [x for x in line_list(text or "") if x]
        self.windows = shortest_windows([len(x.split()) for x in lines], min_words)
        if self.windows:
            self.hashes = b"".join(map(line_hash, lines))
            self.values = np.frombuffer(self.hashes, dtype="<u8")[::2]
            self.minima = minima(self.values.tolist(), self.windows)


def selected_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(mark, n): hashes of the lines that winnowing selects in some texts, and in how many places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            marks = [np.zeros(0, dtype="<u8")]
            for text in batch.column("text"):
                lines = _Lines(text.as_py(), min_words)
                if lines.windows:
                    marks.append(lines.values[np.unique(lines.minima)])
            found, n = np.unique(np.concatenate(marks), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["mark", "n"])

    return docs.mapInArrow(run, "mark long, n long")


def line_windows(docs: DataFrame, min_words: int, shared) -> DataFrame:
    """(h1, h2, id, hash, lo, hi, again): the shortest windows whose selected line may be selected elsewhere; the 128 bits h1, h2 stand for all lines of one.

    again tells that the window stands further up in its text too. Empty lines carry no words and are passed over:
    places count the other lines. shared: a broadcast filter of the selected lines to look for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in slices(batches, "text"):
            keys: list[bytes] = []
            out: list[list] = [[] for _ in range(5)]
            for key, mark, text in zip(batch.column("id").to_pylist(), batch.column("hash").to_pylist(), batch.column("text")):
                lines = _Lines(text.as_py(), min_words)
                if not lines.windows:
                    continue
                met, seen = _in_filter(shared.value, lines.values[lines.minima].astype(np.uint64)), set()
                for (lo, hi), known in zip(lines.windows, met.tolist()):
                    if not known:
                        continue
                    own = digest(lines.hashes[16 * lo : 16 * hi])
                    keys.append(own)
                    for c, v in zip(out, (key, mark, lo, hi, own in seen)):
                        c.append(v)
                    seen.add(own)
            both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
            columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), *(pa.array(c, t) for c, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "id", "hash", "lo", "hi", "again"])

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    return docs.mapInArrow(run, "h1 long, h2 long, id long, hash long, lo int, hi int, again boolean")


def repeated_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, hash, runs): windows of min_words words or more of each row that stand in an earlier place too, extended both ways over those they overlap.

    Of each window, winnowing selects the line of the least hash. A run that stands twice has the same windows and so the
    same selected lines at both places; only windows whose selected line is selected in another place too are looked up.
    They are joined by their whole content, so each meets the earliest place of just that window, and a frequent line
    hides none. A window goes unless its row is the one of the least id (of rows that repeat an id, of the least hash) that
    has it and it stands there for the first time.
    """
    marks = selected_lines(docs, min_words).groupBy("mark").agg(F.sum("n").alias("n")).where("n > 1")
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(materialize(marks.select("mark"), "marks"), "mark"))
    windows = materialize(line_windows(docs, min_words, shared), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "hash")).alias("e"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("h1", "h2", F.col("e.id").alias("e_id"), F.col("e.hash").alias("e_hash")), "first")  # its own table, so that a join can split a frequent window
    runs = windows.join(first, ["h1", "h2"]).where("again or id <> e_id or hash <> e_hash")
    return runs.groupBy("id", "hash").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))


def places_of(runs: list[dict] | None) -> list[int]:
    """The places of all lines in some run, in order."""
    places: list[int] = []
    to = 0
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or []):
        places.extend(range(max(lo, to), hi))
        to = max(to, hi)
    return places


def delete_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """docs with repeated runs of lines deleted, and n_lines, n_deleted (long, of lines that are not empty).

    A line goes if it lies in a run of consecutive lines of at least min_words words that also stands earlier, in a
    document of a smaller id or further up in the same one; the earliest copy of any line always stays. Shorter
    repeats stay. Lines are compared without the white space around them, and empty lines neither match nor break a
    run; they go with the run before them. Other lines stay byte for byte. No repeated run is missed: every window of
    lines that is as short as min_words allows is looked up, and a run is the union of its windows. 128-bit hashes stand
    for the lines of a window.

    Null texts stay null, with no lines. Rows with a null id stay as they are. Rows that repeat an id are texts of their
    own, in the order of their texts' hashes; rows that repeat id and text stand in one place and lose the same lines. Ids
    must fit a long. Other columns stay, whatever their names, but n_lines and n_deleted are replaced.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*inner)
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    plain = plain.withColumn(text, F.col(text).cast("string"))
    keyed = plain.select(F.col(own).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null").withColumn("hash", F.xxhash64("text"))
    gone = repeated_lines(keyed, min_words)
    joined = plain.join(gone, (F.col(own).cast("long") == F.col("id")) & (F.xxhash64(text) == F.col("hash")), "left").drop("id", "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, deleted = [], [], []
            for old, gone in zip(batch.column(text), batch.column("runs")):
                kept, n, d = without_lines(old.as_py(), places_of(gone.as_py()))
                texts.append(kept)
                counts.append(n)
                deleted.append(d)
            cols = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in inner]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())], names=[*inner, "n_lines", "n_deleted"])

    schema = plain.withColumns({"n_lines": F.lit(0).cast("long"), "n_deleted": F.lit(0).cast("long")}).schema
    stay = [F.col(c).alias(n) for c, n in zip(inner, names) if n not in ("n_lines", "n_deleted")]
    return joined.mapInArrow(run, schema).select(*stay, "n_lines", "n_deleted")


def without_lines(text: str | None, places: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the lines at these places, how many lines it has and how many went. Empty lines are not counted."""
    if text is None:
        return None, 0, 0
    if not places:
        return text, sum(1 for x in text.split("\n") if x.strip()), 0
    gone, kept, n, before = set(places), [], 0, False
    for line in text.split("\n"):
        if line.strip():
            before = n in gone
            n += 1
        if not before:
            kept.append(line)
    return "\n".join(kept), n, sum(1 for p in gone if p < n)
