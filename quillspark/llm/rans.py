"""Static range asymmetric numeral system over many interleaved lanes, in numpy.

Symbol i of a block belongs to lane i mod lanes, so one step codes a symbol of every
lane with a few array operations. States are 64-bit and are renormalised by 32-bit
words. Encoding runs from the last step to the first; at every checkpoint the lanes'
states and the place in the word stream are kept, so that the segments of a block can be
decoded apart from each other. Each segment has a CRC-32 of its symbols.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LOW = np.uint64(1 << 31)
U32 = np.uint64(32)


class Table:
    """Frequencies of used symbols, scaled to a sum of 2**bits; every used one keeps at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols = np.asarray(symbols, dtype=np.uint32)
        self.freqs = np.asarray(freqs, dtype=np.uint64)
        total = int(self.freqs.sum())
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits or not 1 <= self.bits <= 28:
            raise ValueError("frequencies must sum to a power of two of at most 2**28")
        self.starts = np.cumsum(self.freqs, dtype=np.uint64) - self.freqs
        self.of = np.zeros(int(self.symbols.max()) + 1, dtype=np.int64)
        self.of[self.symbols] = np.arange(len(self.symbols))
        self._slots: tuple | None = None

    @classmethod
    def scaled(cls, symbols: np.ndarray, counts: np.ndarray, bits: int | None = None) -> Table:
        order = np.argsort(symbols)
        symbols, counts = np.asarray(symbols)[order], np.asarray(counts, dtype=np.float64)[order]
        bits = bits or max(16, min(28, (len(symbols) - 1).bit_length() + 3))
        freqs = np.maximum(1, np.floor(counts / counts.sum() * (1 << bits))).astype(np.int64)
        rest = (1 << bits) - int(freqs.sum())
        if rest >= 0:
            freqs[np.argmax(freqs)] += rest
        else:  # take the excess from the largest, in order, leaving each at least 1
            for i in np.argsort(-freqs, kind="stable"):
                take = min(-rest, int(freqs[i]) - 1, max(1, int(freqs[i]) // 2))
                freqs[i] -= take
                rest += take
                if not rest:
                    break
        return cls(symbols, freqs)

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By slot: symbol, frequency, slot less the symbol's start."""
        if self._slots is None:
            which = np.repeat(np.arange(len(self.symbols)), self.freqs.astype(np.int64))
            self._slots = self.symbols[which], self.freqs[which], np.arange(1 << self.bits, dtype=np.uint64) - self.starts[which]
        return self._slots


@dataclass
class Block:
    n: int
    lanes: int
    every: int  # steps from checkpoint to checkpoint
    words: bytes
    places: list[int]  # in words, by segment
    states: list[bytes]
    crcs: list[int]


def encode(ids: np.ndarray, table: Table, lanes: int = 1024, segment: int = 1 << 18) -> Block:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    every = max(1, segment // lanes)
    which = table.of[ids]
    freqs, starts, limits = table.freqs[which], table.starts[which], (table.freqs << np.uint64(63 - table.bits))[which]
    x = np.full(lanes, LOW, dtype=np.uint64)
    bits = np.uint64(table.bits)
    out: list[np.ndarray] = []
    emitted = 0
    marks: list[tuple[int, bytes]] = []
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y, f = x[: b - a], freqs[a:b]
        full = np.flatnonzero(y >= limits[a:b])
        if len(full):
            spill = y[full]
            out.append(spill.astype("<u4"))
            emitted += len(full)
            y[full] = spill >> U32
        q = y // f
        y[:] = (q << bits) + (y - q * f) + starts[a:b]
        if t % every == 0:
            marks.append((emitted, x.astype("<u8").tobytes()))
    marks.reverse()
    words = np.concatenate(out[::-1]).tobytes() if out else b""
    parts = [zlib.crc32(np.ascontiguousarray(ids[s * lanes : (s + every) * lanes], dtype="<u4")) for s in range(0, steps, every)]
    return Block(n, lanes, every, words, [emitted - e for e, _ in marks], [s for _, s in marks], parts)


def decode_segment(block: Block, k: int, table: Table) -> np.ndarray:
    """The symbols of segment k, from its checkpoint. Raises ValueError if its checksum differs."""
    symbols, freqs, offsets = table.slots()
    words = np.frombuffer(block.words, dtype="<u4")
    x = np.frombuffer(block.states[k], dtype="<u8").astype(np.uint64)
    first, last = k * block.every * block.lanes, min(block.n, (k + 1) * block.every * block.lanes)
    out = np.empty(last - first, dtype=np.uint32)
    at, mask, bits = block.places[k], np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    for a in range(0, last - first, block.lanes):
        b = min(last - first, a + block.lanes)
        y = x[: b - a]
        slot = (y & mask).astype(np.int64)
        out[a:b] = symbols[slot]
        y[:] = freqs[slot] * (y >> bits) + offsets[slot]
        low = np.flatnonzero(y < LOW)
        if len(low):
            y[low] = (y[low] << U32) | words[at : at + len(low)].astype(np.uint64)
            at += len(low)
    if zlib.crc32(out.astype("<u4").tobytes()) != block.crcs[k]:
        raise ValueError(f"segment {k}: checksum differs")
    return out


def decode(block: Block, table: Table) -> np.ndarray:
    parts = [decode_segment(block, k, table) for k in range(len(block.places))]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint32)
