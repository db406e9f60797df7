"""Byte-level text helpers for Arrow batches: slicing, words and 64-bit hashes by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text column of each piece holds about max_bytes; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_lengths(array: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another as bytes, and the n + 1 offsets between them. Null is an empty text."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each text: starts, ends, and the n + 1 bounds of each text's runs."""
    n = len(mask)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = mask[edge]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = mask[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit values (one-to-one)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], the same wherever it stands; data are bytes or code points."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers = np.empty(len(data) + 1, dtype=np.uint64)
    powers[0], powers[1:] = 1, _BASE
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else mix(data.astype(np.uint64))) * powers[:-1], out=sums[1:])
    raw = sums[ends] - sums[starts]
    powers[1:] = _INVERSE
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return mix(raw * powers[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words that lie within one text, and the first word's index of each."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    out = np.full(n, _U(k), dtype=np.uint64)
    for j in range(k):
        out = out * _BASE + words[j : j + n]
    text_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + k <= text_end)
    return mix(out[at]), at


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after another."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


class HashIndex:
    """Row numbers of distinct 64-bit keys by open addressing; all look-ups of an array at once."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.rows = np.full(size, -1, dtype=np.int32)
        self.keys = keys
        todo, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.rows[at] < 0)
            self.rows[at[free]] = todo[free]  # the last of several takes the slot
            lost = self.rows[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        todo, at = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        while len(todo):
            row = self.rows[at]
            there = row >= 0
            same = there & (self.keys[row] == keys[todo])
            out[todo[same]] = row[same]
            on = there & ~same
            todo, at = todo[on], (at[on] + 1) & int(self.mask)
        return out
