"""Static range asymmetric numeral coding of token ids: shared frequencies, interleaved lanes, checkpoints."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

#: Frequencies add up to 2**SCALE; lane states stay in [LOW, LOW * 2**32).
SCALE = 20
LOW = 1 << 31
LANES, STEPS, EVERY = 64, 1024, 256
BLOCK = LANES * STEPS

_U = np.uint64
_32, _R, _MASK = _U(32), _U(SCALE), _U((1 << SCALE) - 1)


@dataclass
class Table:
    """Symbols with their frequencies and the sums before them, and the symbol of every slot."""

    freq: np.ndarray
    before: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, freqs: np.ndarray) -> Table:
        size = int(symbols.max()) + 1 if len(symbols) else 1
        freq = np.zeros(size, dtype=np.uint64)
        freq[symbols] = freqs
        return cls(freq, np.cumsum(freq) - freq, np.repeat(np.arange(size, dtype=np.uint32), freq.astype(np.int64)))


def quantized(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 in proportion to the counts, 2**SCALE in all."""
    if len(counts) > 1 << SCALE:
        raise ValueError("too many symbols for the scale")
    freqs = np.maximum(1, counts.astype(np.float64) * ((1 << SCALE) / counts.sum())).astype(np.int64)
    order, over = np.argsort(-freqs, kind="stable"), int(freqs.sum()) - (1 << SCALE)
    for i in order:
        if over == 0:
            break
        give = min(over, int(freqs[i]) - 1) if over > 0 else over
        freqs[i] -= give
        over -= give
    return freqs


def encode(blocks: list[np.ndarray], table: Table) -> list[dict]:
    """Codes blocks of at most BLOCK ids, all lanes of all blocks a step at a time, from the last step to the first.

    Id i of a block is in lane i % LANES. Each block gives n, crc, payload (words in the order that a decoder reads
    them) and, for every EVERY steps, the lanes' states and the place in the payload.
    """
    b = len(blocks)
    ids = np.zeros((b, BLOCK), dtype=np.uint32)
    sizes = np.array([len(x) for x in blocks])
    for row, x in zip(ids, blocks):
        row[: len(x)] = x
    ids = ids.reshape(b, STEPS, LANES)
    place = np.arange(BLOCK).reshape(STEPS, LANES)
    steps = -(-int(sizes.max()) // LANES)
    state = np.full((b, LANES), LOW, dtype=np.uint64)
    words, given = np.zeros((b, steps, LANES), dtype=np.uint32), np.zeros((b, steps, LANES), dtype=bool)
    states = np.zeros((b, STEPS // EVERY, LANES), dtype=np.uint64)
    for t in range(steps - 1, -1, -1):
        used = place[t] < sizes[:, None]
        f, c = table.freq[ids[:, t]], table.before[ids[:, t]]
        np.copyto(f, 1, where=~used)
        out = used & ((state >> _U(43)) >= f)
        words[:, t], given[:, t] = state & _U(0xFFFFFFFF), out
        state = np.where(out, state >> _32, state)
        high = state // f
        state = np.where(used, (high << _R) + (state - high * f) + c, state)
        if t % EVERY == 0:
            states[:, t // EVERY] = state
    coded = []
    for i, x in enumerate(blocks):
        marks = -(-len(x) // (LANES * EVERY))
        read = np.cumsum(given[i].sum(axis=1))
        coded.append(
            {
                "n": len(x),
                "crc": zlib.crc32(x.astype("<u4").tobytes()),
                "payload": words[i][given[i]].astype("<u4").tobytes(),
                "states": states[i, :marks].astype("<u8").tobytes(),
                "places": [0, *read[EVERY - 1 :: EVERY].tolist()][:marks],
            }
        )
    return coded


def decode(blocks: list[dict], table: Table) -> list[np.ndarray]:
    """The ids of each block; the stretches between checkpoints of all blocks are decoded side by side."""
    lengths = [len(x["payload"]) // 4 for x in blocks]
    stream = np.frombuffer(b"".join(x["payload"] for x in blocks) + bytes(4), dtype="<u4").astype(np.uint64)
    base = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(blocks)), [len(x["places"]) for x in blocks])
    mark = np.concatenate([np.arange(len(x["places"])) for x in blocks])
    at = base[owner] + np.concatenate([np.asarray(x["places"], dtype=np.int64) for x in blocks])
    state = np.frombuffer(b"".join(x["states"] for x in blocks), dtype="<u8").astype(np.uint64).reshape(-1, LANES)
    left = np.array([x["n"] for x in blocks])[owner] - mark * EVERY * LANES
    out = np.zeros((len(owner), EVERY, LANES), dtype=np.uint32)
    lane = np.arange(LANES)
    for t in range(EVERY):
        used = t * LANES + lane < left[:, None]
        if not used.any():
            break
        slot = state & _MASK
        ids = table.slots[slot.astype(np.int64)]
        out[:, t] = ids
        new = table.freq[ids] * (state >> _R) + slot - table.before[ids]
        new = np.where(used, new, state)
        need = new < _U(LOW)
        rank = np.cumsum(need, axis=1)
        word = stream[np.minimum(at[:, None] + rank - 1, len(stream) - 1)]
        state = np.where(need, (new << _32) | word, new)
        at = at + rank[:, -1]
    got = []
    for i, x in enumerate(blocks):
        ids = out[owner == i].reshape(-1)[: x["n"]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != x["crc"]:
            raise ValueError("a block does not match its checksum")
        got.append(ids)
    return got
