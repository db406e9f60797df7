"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.textops import mix, slices, span_hashes

#: Phrases of this level and above make a fingerprint; their mean length is about 3 ** level bytes.
LEVEL = 3
#: So many least phrase hashes are kept. A likeness read off them has a standard error of at most 6 points (100 / (2 * 8)).
SKETCH = 64
#: The driver gets one border and one head for each range.
MOST_RANGES = 20_000


def toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: twice the place of the lowest bit that differs from the name before, plus that bit.

    Neighbours that differ have different results, of ever fewer values. first: the names without one before.
    """
    one = names.dtype.type(1)
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = names[first] ^ one
    differ = names ^ before
    low = differ & (~differ + one)
    return (2 * np.bitwise_count(low - one) + ((names & low) != 0)).astype(np.uint8)


def phrases(names: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level's symbols, and the n + 1 bounds of each text's.

    Repeats of a symbol become one; coin tossing then leaves labels below 6, and a phrase starts at each local
    maximum of them. Whether it does hangs on four symbols before and one after, so equal substrings have equal
    phrases but for a few at either end. A name is the hash of the phrase's symbols.
    """
    n = len(names)
    if not n:
        return names.astype(np.uint64), bounds
    head = np.zeros(n, dtype=bool)
    head[bounds[:-1][bounds[:-1] < n]] = True
    keep = head.copy()
    keep[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(keep)
    run = np.diff(np.append(at, n))
    names, head = names[at].astype(np.uint64), head[at]
    many = run > 1
    if many.any():
        names[many] = mix(names[many] * np.uint64(0x9E3779B97F4A7C15) + run[many].astype(np.uint64))
    first = np.flatnonzero(head)
    labels = names
    for _ in range(4):
        labels = toss(labels, first)
    start = head.copy()
    last = np.append(head[1:], True)
    start[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~last[1:-1]
    begin = np.flatnonzero(start)
    return span_hashes(names, begin, np.append(begin[1:], len(names))), np.searchsorted(begin, np.searchsorted(at, bounds))


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint of each text: the name of the whole text, and the least hashes of its phrases, in hex digits.

    Phrases are those of LEVEL and above, and the text's own name; a text too short for that level (some 30 bytes, or
    long runs of few signs) has only its name, and so is like nothing but itself. Equal texts have equal fingerprints; texts that
    share substrings share the phrases inside them, wherever those stand.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    names: np.ndarray = np.frombuffer(b"".join(raw), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    top = np.zeros(len(texts), dtype=np.uint64)
    owners, found, level, open_ = [], [], 0, np.arange(len(texts))
    while len(open_):
        names, bounds = phrases(names, bounds)
        level += 1
        size = np.diff(bounds)
        if level >= LEVEL:
            owners.append(np.repeat(open_, size))
            found.append(mix(names + np.uint64(level)))
        single = size <= 1
        whole = open_[size == 1]
        top[whole] = mix(names[bounds[:-1][size == 1]] + np.uint64(level << 8))
        go = np.repeat(~single, size)
        names, open_ = names[go], open_[~single]
        bounds = np.concatenate([[0], np.cumsum(size[~single])]).astype(np.int64)
    owners.append(np.flatnonzero(top))
    found.append(top[owners[-1]])
    owner, value = np.concatenate(owners), np.concatenate(found) >> np.uint64(32)
    pairs = np.unique((owner.astype(np.uint64) << np.uint64(32)) | value)
    cut = np.searchsorted(pairs >> np.uint64(32), np.arange(len(texts) + 1).astype(np.uint64))
    digits = (pairs & np.uint64(0xFFFFFFFF)).astype(">u4")
    return [f"{int(top[i]):016x}" + digits[a : min(b, a + SKETCH)].tobytes().hex() for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]


def likeness(a: str, b: str) -> float:
    """An estimate of the share of phrases that two texts have in common (Jaccard); 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(16, len(f), 8)} for f in (a, b))
    least = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in least) / len(least) if least else 0.0


def edited(text: str, other: str) -> str:
    """text with its last half (rounded down) replaced by as much of the other's beginning, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text. Null is an empty text; null ids and repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprints(batch.column("text").fill_null("").to_pylist()))], names=["id", "fingerprint"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is the one of the next smaller id, after the smallest id the one of the greatest. Rows of one
    id follow each other by text, null texts first; null ids come last. Documents are cut into ranges of ids of about
    range_bytes each (at least spark.sql.shuffle.partitions and at most MOST_RANGES of them, unless `parts` tells), and
    the first document of a range is also sent to the range before it, so no task and no window sees more than a range;
    the driver gets the ranges' borders only. A single document is its own next one.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if not parts:
        size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // range_bytes))
    shares = [i / parts for i in range(1, parts)]
    borders = np.array(sorted(set(read.agg(F.percentile_approx("id", shares or [0.5], max(10_000, 10 * parts))).first()[0] or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def larger(ids: pd.Series) -> pd.Series:
        """How many borders are larger than each id."""
        return pd.Series(len(borders) - np.searchsorted(borders, ids.to_numpy(), side="right"))

    own = larger(F.coalesce("id", F.lit(0).cast("long")))  # without nulls, which pandas would turn into doubles
    read = read.withColumn("part", F.when(F.col("id").isNull(), F.lit(len(borders))).otherwise(own))
    heads = read.groupBy("part").agg(F.max("id").alias("id")).orderBy("part").collect()
    before = [(own.part, own.id, last.part) for own, last in zip(heads, [*heads[-1:], *heads[:-1]])]
    guests = spark.createDataFrame(before, "part int, head long, last int")
    to = F.array(F.struct(F.col("part"), F.lit(False).alias("guest")))
    to = F.when(F.col("head").eqNullSafe(F.col("id")), F.array_append(to, F.struct(F.col("last").alias("part"), F.lit(True).alias("guest")))).otherwise(to)
    rows = read.join(F.broadcast(guests), "part", "left").withColumn("to", F.explode(to)).select("id", "text", F.col("to.part").alias("part"), F.col("to.guest").alias("guest"))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("id"), "text")
    return rows.mapInArrow(_report, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last document that has not met its next one
    for batch in slices(batches, "text", 500_000):
        texts = batch.column("text").fill_null("").to_pylist()
        rows = list(zip(batch.column("id").to_pylist(), texts, fingerprints(texts), batch.column("part").to_pylist(), batch.column("guest").to_pylist()))
        chain = rows if held is None else [held, *rows]
        pairs = [(a, b) for a, b in zip(chain, chain[1:]) if not a[4] and a[3] == b[3]]
        held = rows[-1]
        changed = [edited(a[1], b[1]) for a, b in pairs]
        marks = fingerprints(changed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], pa.int64()),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                pa.array([a[2] for a, _ in pairs], pa.string()),
                pa.array(marks, pa.string()),
                pa.array([likeness(a[2], m) for (a, _), m in zip(pairs, marks)], pa.float64()),
                pa.array([likeness(a[2], b[2]) for a, b in pairs], pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
