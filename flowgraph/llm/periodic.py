"""Periodic runs of words, found by the branching tandem repeats of an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.textops import ranges, slices

#: Suffixes of smaller children that are checked at a time.
_STEP = 2_000_000


def suffix_array(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """All suffixes in order, and for k = 0, 1, ... the rank of each suffix by its first 2**k words.

    words: numbers, bounds: the n + 1 ends of the texts. A suffix ends with its text, and suffixes of different texts
    have different ranks. Each round sorts only those that the last one left tied. Ranks have one more value, -1, for
    the place after the last word.
    """
    n, sizes = len(words), np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(bounds[1:], sizes)
    key = (text << 32) + words
    order = np.argsort(key, kind="stable")
    tied, key, levels, step = np.arange(n), key[order], [], 1
    rank = np.full(n + 1, -1, dtype=np.int64)
    while True:
        new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        group = np.diff(np.append(first, len(key)))
        rank[order[tied]] = np.repeat(tied[first], group)
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        tied = tied[np.repeat(group > 1, group)]
        if not len(tied):
            return order, levels
        own = order[tied]
        then = own + step
        key = rank[own] * (n + 2) + np.where(then < end[own], rank[np.minimum(then, n)] + 1, 0)
        at = np.argsort(key, kind="stable")
        order[tied], key, step = own[at], key[at], 2 * step


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each two neighbours of the suffix array have in common."""
    out = np.zeros(max(len(order) - 1, 0), dtype=np.int64)
    at = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b = order[at], order[at + 1]
    for k in reversed(range(len(levels))):
        same = levels[k][a] == levels[k][b]
        a, b = a + (same << k), b + (same << k)
    out[at] = a - order[at]
    return out


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, at, hi): the places lo..at and at + 1..hi of the suffix array are the two sides of the boundary behind at.

    All suffixes lo..hi share lcp[at] words, and two on different sides share no more. Of several boundaries with one
    value in an interval the first splits off the first child, the next one the next, so every child is a side.
    """
    at = np.flatnonzero(lcp)
    if not len(at):
        return at, at, at
    edge = np.flatnonzero(np.append(True, np.append(np.diff(at) > 1, True)))
    longest = int(np.diff(edge).max())
    least = [lcp.astype(np.int32)]
    while (2 << (len(least) - 1)) <= longest:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    depth, lo, hi = lcp[at], at.copy(), at + 1
    for k in reversed(range(len(least))):
        there = np.flatnonzero(lo >= 1 << k)
        go = there[least[k][lo[there] - (1 << k)] > depth[there]]
        lo[go] -= 1 << k
        there = np.flatnonzero(hi + (1 << k) <= len(lcp))
        go = there[least[k][hi[there]] >= depth[there]]
        hi[go] += 1 << k
    return lo, at, hi


def branching_squares(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all squares that cannot move one word to the right: two equal halves, then a word that breaks the period.

    Such a square's halves begin suffixes that share just its period. For each boundary of that depth the suffixes of
    the smaller side are asked whether the one a period on, or back, is on the other side.
    """
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    lo, at, hi = intervals(lcp)
    left, right = at - lo + 1, hi - at
    small, begin = np.minimum(left, right), np.where(left <= right, lo, at + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ends = np.cumsum(small)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _STEP, side="right")))
        owner = np.repeat(np.arange(i, j), small[i:j])
        suffix, depth = order[ranges(begin[i:j], small[i:j])], lcp[at[owner]]
        first, last = np.where(left <= right, at + 1, lo)[owner], np.where(left <= right, hi, at)[owner]
        for way in (1, -1):
            other = suffix + way * depth
            there = np.flatnonzero((other >= 0) & (other < len(order)))
            there = there[(place[other[there]] >= first[there]) & (place[other[there]] <= last[there])]
            found.append((np.minimum(suffix[there], other[there]), depth[there]))
        i = j
    if not found:
        return lo, lo
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(words: np.ndarray, bounds: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the maximal runs in some texts, by text, start and period; start counts from the text's first word.

    words: numbers of the words of all texts, bounds: the n + 1 ends of the texts. A square that cannot move right ends a
    run; it is moved left word by word (by halving steps over ranks) to where the run begins. A run of smallest period p
    is also met with the multiples of p, which have its start and end; the smallest is kept.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(words):
        return none, none, none, none
    order, levels = suffix_array(words, bounds)
    place, period = branching_squares(order, common_prefixes(order, levels))
    text = np.searchsorted(bounds, place, side="right") - 1
    start, floor = place.copy(), bounds[text]
    for k in reversed(range(len(levels))):
        there = np.flatnonzero(start - (1 << k) >= floor)
        to = start[there] - (1 << k)
        go = levels[k][to] == levels[k][to + period[there]]
        start[there[go]] = to[go]
    end = place + 2 * period
    keep = end - start >= np.maximum(min_length, min_exponent * period)
    text, start, end, period = text[keep], start[keep], end[keep], period[keep]
    at = np.lexsort((period, end, start))
    text, start, end, period = text[at], start[at], end[at], period[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text, start, end, period = text[new], start[new], end[new], period[new]
    at = np.lexsort((period, start, text))
    return text[at], (start - bounds[text])[at], (end - start)[at], period[at]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """(id, n_words, runs, collapsed): the maximal periodic runs of words of each text, and the text with one period of each.

    Words are runs of bytes but space and \\t to \\r. A run is a stretch of words with smallest period p (words p apart are
    equal) that no neighbouring word extends, of at least min_length words and min_exponent periods (2 or more). runs
    are structs (start, length, period) of word numbers from 0, by start, then period; collapsed are the words outside
    all runs' later periods, joined by one space.

    Texts are whole and each is worked on alone: nothing is shuffled, and a long text takes some
    200 bytes of memory a word and, where much of it repeats, 4 more for each doubling of the longest repeat. Null and empty texts have no words, no runs and an empty collapsed text. Rows are kept one by one,
    so repeated and null ids stay; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text")]
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            bounds = np.append(0, np.cumsum(sizes))
            known: dict[bytes, int] = {}
            words = np.fromiter((known.setdefault(w, i) for w, i in zip((w for t in texts for w in t), count())), dtype=np.int64, count=int(bounds[-1]))
            text, start, length, period = runs_of(words, bounds, min_length, min_exponent)
            depth = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(depth, bounds[text] + start + period, 1)
            np.add.at(depth, bounds[text] + start + length, -1)
            gone = np.cumsum(depth)[:-1] > 0
            for i in np.unique(text):
                keep = ~gone[bounds[i] : bounds[i + 1]]
                texts[i] = [w for w, k in zip(texts[i], keep.tolist()) if k]
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            collapsed = pa.array([b" ".join(t) for t in texts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), structs), collapsed], names=["id", "n_words", "runs", "collapsed"])

    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = read.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
