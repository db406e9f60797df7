"""Near-duplicate groups by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgraph.llm.textops import mix
from flowgraph.llm.verified import Sketches, pairs_between, verified_groups

#: Coordinates of a sketch; they are used in bands of ROWS each.
BINS, ROWS = 160, 4
#: Coordinates of 160 in which two sketches agree at least, if they may be alike at 0.8. By Chernoff's bound, fewer happen with a chance below 1e-11.
AGREE = 88

_ROUND, _EMPTY = 0x9E3779B97F4A7C15, np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_sketches(grams: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of each set, as rows of `bins` 64-bit values; zeros for an empty set.

    Round i throws every element into a bin that a hash of (i, element) picks; an empty bin keeps the least hash of the
    first round that reaches it. `bins` rounds pick bins freely; round bins + b throws all into bin b, so that in the end
    every coordinate is filled. A set drops out as soon as it has no empty bin, mostly after few rounds. Two sets agree in a
    coordinate with the chance of their similarity, and the number of agreements is as concentrated as if coordinates were
    independent.
    """
    n = len(bounds) - 1
    out = np.full((n, bins), _EMPTY, dtype=np.uint64)
    flat = out.reshape(-1)
    sizes = np.diff(bounds)
    open_ = np.flatnonzero(sizes)
    owner, items = np.repeat(np.arange(n), sizes), grams
    for i in range(2 * bins):
        if not len(open_):
            break
        values = mix(items + np.uint64((i + 1) * _ROUND % (1 << 64)))
        at = (values >> np.uint64(40)) % np.uint64(bins) if i < bins else np.full(len(items), np.uint64(i - bins))
        cell = owner * bins + at.astype(np.int64)
        empty = flat[cell] == _EMPTY
        np.minimum.at(flat, cell[empty], np.minimum(values[empty], _EMPTY - np.uint64(1)))
        left = (out[open_] == _EMPTY).any(axis=1)
        if not left.all():
            open_ = open_[left]
            stay = np.zeros(n, dtype=bool)
            stay[open_] = True
            keep = stay[owner]
            owner, items = owner[keep], items[keep]
    out[sizes == 0] = 0
    return out


def mark(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of one byte a coordinate, and a key for each band."""
    whole = fast_sketches(grams, bounds)
    keys = np.zeros((len(whole), BINS // ROWS), dtype=np.uint64)
    for row in range(ROWS):
        keys = mix(keys + mix(whole[:, row::ROWS] + np.uint64(row)))
    return (whole & np.uint64(255)).astype(np.uint8), mix(keys + np.arange(keys.shape[1], dtype=np.uint64))


def near(sketches: np.ndarray, bounds: np.ndarray, allowed: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that agree in enough coordinates."""
    for left, right in pairs_between(bounds):
        keep = np.flatnonzero(allowed(left, right))
        left, right = left[keep], right[keep]
        keep = (sketches[left] == sketches[right]).sum(axis=1) >= AGREE
        yield left[keep], right[keep]


def agree(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Rows that agree with one in enough coordinates."""
    return (sketches == one).sum(axis=1) >= AGREE


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2) -> DataFrame:
    """(id, n_shingles, component_id): documents whose sets of k-word shingles have a similarity (Jaccard) of 0.8 or more share a component.

    Words are runs of bytes but space and \\t to \\r, A-Z lower-cased; a text of fewer than k words is one shingle. Sketches
    of 160 coordinates are banded by fours, so a pair of similarity 0.8 shares no band with a chance of 7e-10; every link
    is confirmed on the full sets (see verified_groups, also for nulls, ties and hot groups). A document without words
    is linked with nothing and names its own component.
    """
    found = verified_groups(docs, Sketches(mark, near, agree), k, id_col, text_col)
    return found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_col)))
