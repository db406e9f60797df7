"""Benchmark decontamination: a prefix-filtered join of document words with windows of benchmark items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.storage import materialize
from flowgraph.llm.textops import LOWER, gram_hashes, slices, span_hashes, spans, text_bytes

#: Bytes of words, once A-Z are lower-cased: digits, letters and all of non-ASCII characters.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

#: A filter has at least so many bits for each value, but no more than 2**MOST_BITS (64 MB); a false positive only costs a row in a join.
BITS_PER_VALUE, LEAST_BITS, MOST_BITS = 16, 16, 29


class _Words:
    """The words of a batch of texts."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        self.data = LOWER[data]
        self.starts, self.ends, self.bounds = spans(WORD_BYTE[self.data], offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def texts(self, at: int, to: int) -> list[str]:
        raw = self.data[self.starts[at] : self.ends[to - 1]].tobytes() if to > at else b""
        base = self.starts[at] if to > at else 0
        return [raw[s - base : e - base].decode() for s, e in zip(self.starts[at:to], self.ends[at:to])]


def _in_filter(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    found, log2_bits = np.ones(len(grams), dtype=bool), (64 * len(bits)).bit_length() - 1
    for shift in (0, log2_bits):
        at = (grams >> np.uint64(shift)) & np.uint64((1 << log2_bits) - 1)
        found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _filter_bits(df: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of a long column, as large as its distinct values ask for; at most 2**(MOST_BITS - 6) words reach the driver."""
    n = df.select(F.approx_count_distinct(column)).first()[0]
    log2_bits = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_VALUE * n).bit_length()))
    mask = (1 << log2_bits) - 1
    at = F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, log2_bits).bitwiseAND(F.lit(mask)))).alias("at")
    words = df.select(at).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (log2_bits - 6), dtype=np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item_id, start, words, size, at, gram): each window of an item once for each of its shingles, at its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 200_000):
            words = _Words(batch.column("text"))
            rows = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
                n, size = hi - lo, min(shingle, hi - lo)
                if not n:
                    continue
                grams = gram_hashes(words.hashes[lo:hi], np.array([0, n]), size)[0].view(np.int64).tolist()
                own, long = words.texts(lo, hi), min(window, n)
                for s in range(n - long + 1):
                    rows += [(item, s, own[s : s + long], size, at, grams[s + at]) for at in range(long - size + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    kind = items.schema[item_col].dataType
    names = ["item_id", "start", "words", "size", "at", "gram"]
    types = [_arrow(kind), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64()]
    read = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, f"item_id {kind.simpleString()}, start long, words array<string>, size int, at int, gram long")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _hits(docs: DataFrame, sizes: list[int], bits, window: int, counted: bool) -> DataFrame:
    """Grams of documents that the filter lets pass: counts (gram, n), or each one's place with the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            words = _Words(batch.column("text"))
            found = []
            for k in sizes:
                grams, at = gram_hashes(words.hashes, words.bounds, k)
                keep = _in_filter(bits.value, grams)
                found.append((grams[keep].view(np.int64), at[keep]))
            if counted and not found:
                continue
            if counted:
                grams, n = np.unique(np.concatenate([g for g, _ in found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])
                continue
            total = np.diff(words.bounds)
            rows: dict[str, list] = {"doc": list(range(batch.num_rows)), "gram": [None] * batch.num_rows, "at": [None] * batch.num_rows, "first": [None] * batch.num_rows, "around": [None] * batch.num_rows}
            for k, (grams, at) in zip(sizes, found):
                owner = np.searchsorted(words.bounds, at, side="right") - 1
                for g, i, d in zip(grams.tolist(), at.tolist(), owner.tolist()):
                    lo = int(words.bounds[d])
                    first = max(lo, i - max(window - k, 0))
                    rows["doc"].append(d)
                    rows["gram"].append(g)
                    rows["at"].append(i - lo)
                    rows["first"].append(first - lo)
                    rows["around"].append(words.texts(first, min(int(words.bounds[d + 1]), i + window)))
            doc = np.array(rows["doc"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc)), pa.array(total[doc]), pa.array(rows["gram"], pa.int64()), pa.array(rows["at"], pa.int64()), pa.array(rows["first"], pa.int64()), pa.array(rows["around"], pa.list_(pa.string()))],
                names=["id", "n_words", "gram", "at", "first", "around"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    out = "gram long, n long" if counted else f"id {kind}, n_words long, gram long, at long, first long, around array<string>"
    return docs.mapInArrow(run, out)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 5, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for every document: where windows of benchmark items occur in it.

    Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters. A window is `window`
    consecutive words of an item, or all words of a shorter one. A window is the set of its shingles, and containment
    is whole, so one shingle is prefix enough: the one rarest over all documents. Documents are joined on those
    shingles only; the shingle's place in the window fixes where the window would start (positional bound) and end
    (length bound), and the words there are compared one by one. Windows with a shingle that no document has are out.

    n_hit counts words inside any occurrence, spans lists the occurrences' (start, end) in words, items the sorted
    ids (as strings) that occur. The prefix table is broadcast if it measures at most broadcast_bytes, else joined by
    shuffle. Null and empty texts have no words; items without words occur nowhere; a null item id is not listed but
    its windows hit. Windows that several items have are looked for once; their items are joined last. Rows that repeat an id are one document of the longest row's n_words. Empty tables give empty
    results or documents without hits; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    windows = materialize(item_windows(items, item_col, item_text_col, window, shingle), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # 1 to shingle
    seen = _hits(docs, sizes, spark.sparkContext.broadcast(_filter_bits(windows, "gram")), window, counted=True)
    rarity = seen.groupBy("gram").agg(F.sum("n").alias("n"))
    ranked = windows.join(rarity, "gram", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("rarest"))
    prefix = ranked.where("rarest.n > 0").select(F.col("rarest.gram").alias("gram"), F.col("rarest.at").alias("place"), "words")
    prefix = materialize(prefix, "prefix")
    hits = _hits(docs, sizes, spark.sparkContext.broadcast(_filter_bits(prefix, "gram")), window, counted=False)
    size = prefix.agg(F.sum(F.lit(64) + F.length(F.concat_ws(" ", "words")))).first()[0] or 0
    side = F.broadcast(prefix) if size <= broadcast_bytes else prefix
    hits = hits.withColumn("gram", F.coalesce("gram", F.xxhash64("id")))  # documents' own rows meet no window
    start = F.col("at") - F.col("place")
    fits = (start >= F.col("first")) & (start - F.col("first") + F.size("words") <= F.size("around"))
    same = F.when(fits, F.slice("around", (start - F.col("first") + 1).cast("int"), F.size("words")) == F.col("words"))
    joined = hits.join(side, "gram", "left").withColumn("same", F.coalesce(same, F.lit(False))).where("same or around is null")
    span = F.when(F.col("same"), F.struct(start.alias("start"), (start + F.size("words")).alias("end")))
    met = materialize(joined.select("id", "n_words", span.alias("span"), F.when(F.col("same"), F.col("words")).alias("words")), "occurrences")
    owners = windows.select("words", F.col("item_id").cast("string").alias("item")).where("item is not null").distinct()
    listed = met.where("words is not null").select("id", "words").distinct().join(owners, "words").select("id", "item").distinct()
    every = met.select("id", "n_words", "span", F.lit(None).cast("string").alias("item")).unionByName(listed, allowMissingColumns=True)
    found = every.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    grown = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).cast("long").alias("n"), F.greatest(a["to"], s["end"]).cast("long").alias("to")),
        lambda a: a["n"],
    )
    return found.select(F.col("id").alias(id_col), "n_words", grown.alias("n_hit"), "items", "spans")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no window of an item occurs; all columns stay, rows with a null id too.

    Rows that repeat an id are one document: if one of them is contaminated, all go.
    """
    bad = contamination(docs, items, id_col, text_col, **options).where("n_hit > 0").select(id_col)
    return docs.join(bad, id_col, "left_anti")
