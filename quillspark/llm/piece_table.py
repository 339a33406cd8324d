"""Token ids of whole columns of texts: pieces hashed and looked up by numpy, misses by the library.

A byte-level BPE sets a border wherever a blank follows a non-blank, and between an ASCII
letter and a full stop or comma that ends a word. Texts are cut at all of these, so that
pieces lie end to end and carry their blanks; a piece alone has the ids that it has inside
its text. All pieces of a chunk are hashed at once (a prefix sum of a polynomial with
random coefficients) and looked up in an open-addressing table, which checks their length
and first eight bytes too. What is not found is encoded by the tokenizers library and
added. A LengthTable keeps the ids' number alone. Texts with blanks whose class is in doubt, or an added token's string, are encoded
whole by the library. The table is of fixed size; it starts afresh when the new pieces of
a chunk might fill it beyond seven tenths. What has no room even then is encoded and not kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .pretokens import Library

#: Bytes of a chunk: what is hashed at once.
CHUNK = 1 << 18
#: Slots of a worker's table, as a power of two (28 bytes each).
SLOT_BITS = 21
#: Bytes above which a piece is encoded each time and not kept, as such hardly repeat and would fill the pool.
LONG = 1 << 12
#: Ids kept from which a table starts afresh.
POOL_IDS = 1 << 25

_rng = np.random.default_rng(987_654_321)
_COEFFICIENT = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[44, 46]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DOUBT = np.zeros(256, dtype=bool)  # ASCII separators, and lead bytes of blanks outside of ASCII
_DOUBT[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(CHUNK, base, dtype=np.uint64))])


def doubtful(raw: np.ndarray) -> np.ndarray:
    """Places of bytes that begin a blank other than the six of ASCII."""
    at = np.flatnonzero(_DOUBT[raw])
    if not len(at):
        return at
    one, two, three = raw[at], raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
    general = (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)) | (two == 0x81) & (three == 0x9F)
    bad = (one < 0x20) | (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) & ((two == 0x9A) & (three == 0x80) | (two == 0xA0) & (three == 0x8E)) | (one == 0xE2) & general
    return at[bad | (one == 0xE3) & (two == 0x80) & (three == 0x80)]


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of texts that lie end to end.

    A piece begins where a text does, at a blank after a non-blank, and at a full stop or
    comma after an ASCII letter that ends a word.
    """
    blank = _BLANK[raw]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[1:-1] = blank[1:] & ~blank[:-1]
    begins[offsets] = True
    ends_word = np.ones(len(raw), dtype=bool)
    ends_word[:-1] = begins[1:-1]
    mark = np.flatnonzero(_MARK[raw] & ends_word)
    mark = mark[(mark > 0) & ~begins[mark]]
    begins[mark[_LETTER[raw[mark - 1]]]] = True
    edges = np.flatnonzero(begins)
    return edges[:-1], edges[1:]


class LengthTable:
    """Numbers of tokens of pieces, by hash: 24 bytes a slot, and no ids.

    frequent: hashes, first bytes, sizes and numbers of tokens that it starts with.
    """

    def __init__(self, path: str, slot_bits: int = SLOT_BITS, frequent: tuple = ()):
        self.library = Library(path)
        self.dtype = self.library.dtype
        self.bits = slot_bits
        self.most = (7 << slot_bits) // 10  # pieces kept, so that a search always meets an empty slot
        self.forward, self.backward = _powers(_BASE), _powers(_INVERSE)
        self.frequent = frequent
        self.clear()
        self.begin()

    def clear(self) -> None:
        n = 1 << self.bits
        self.keys = np.zeros(n, dtype=np.uint64)
        self.heads = np.zeros(n, dtype=np.uint64)
        self.sizes = np.zeros(n, dtype=np.int32)
        self.count = np.zeros(n, dtype=np.int32)
        self.filled = 0

    def begin(self) -> None:
        """Puts in what is known from the start, as far as there is room."""
        if len(self.frequent):
            h, heads, sizes, counts = self.frequent
            new = self.new(h, np.arange(len(h)))
            self.put(h[new], heads[new], sizes[new], counts[new])

    def put(self, h, heads, sizes, counts) -> tuple[np.ndarray, np.ndarray]:
        """Distinct new hashes, for which there is room; gives slots, and which of them each is for."""
        self.filled += len(h)
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(h))
        slots, own = [], []
        while len(open_):
            s = slot[open_]
            empty = self.keys[s] == 0
            self.keys[s[empty]] = h[open_[empty]]
            mine = empty & (self.keys[s] == h[open_])  # of several for one slot the last is in
            put, to = open_[mine], s[mine]
            self.heads[to], self.sizes[to], self.count[to] = heads[put], sizes[put], counts[put]
            slots.append(to)
            own.append(put)
            open_ = open_[~mine]
            slot[open_] = (slot[open_] + 1) & mask
        none = np.zeros(0, np.int64)
        return (np.concatenate(slots), np.concatenate(own)) if slots else (none, none)

    def find(self, h: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of pieces, -1 for those not there."""
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        out = np.where(hit, slot, -1)
        open_ = np.flatnonzero(~hit & (key != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = slot[open_[hit]]
            open_ = open_[~hit & (key != 0)]
        wrong = (self.heads[out] != heads) | (self.sizes[out] != sizes)
        out[wrong & (out >= 0)] = -2  # another piece of the same hash
        return out

    def new(self, h: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """One place of each missing hash, as many as there is room for."""
        _, index = np.unique(h[missing], return_index=True)
        return missing[index[: max(0, self.most - self.filled)]]

    def entries(self, pieces: list[bytes]) -> tuple:
        """Hashes, first bytes, sizes and numbers of tokens of pieces, as ``frequent`` takes them; of pieces that are kept."""
        pieces = [p for p in pieces if 0 < len(p) <= LONG]
        parts, at = [], 0
        while at < len(pieces):  # in chunks, as a hash needs the powers of its places
            end = at + max(1, CHUNK // LONG)
            sizes = np.array([len(p) for p in pieces[at:end]])
            raw = np.frombuffer(b"".join(pieces[at:end]), np.uint8)
            parts.append((*self.hashes(raw, np.cumsum(sizes) - sizes, np.cumsum(sizes)), self._counts(pieces[at:end])))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def values(self, pieces: list[bytes]) -> list[bytes]:
        """The library's ids of pieces: plain ones many at a time, the rest one by one."""
        library, out = self.library, [b""] * len(pieces)
        texts = [p.decode("utf-8") for p in pieces]
        plain, keys = [], []
        for i, t in enumerate(texts):
            body = t[1:] if t[0] in " \n" else t
            if body and body.split() == [body]:
                plain.append(i)
                keys.append(t[1:] if t[0] == " " else "\n" + body)
        for i, t, v in zip(plain, (texts[i] for i in plain), library.pieces(keys), strict=True):
            out[i] = v if t[0] in " \n" else v[library.width :]
        rest = sorted(set(range(len(pieces))).difference(plain))
        for i, v in zip(rest, library.encoded([texts[i] for i in rest]), strict=True):
            out[i] = v
        return out

    def _frame(self, column: pa.StringArray):
        """Bytes and offsets of a column that lie end to end, and which texts the library has to see whole."""
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        whole = np.zeros(n, dtype=bool)
        whole[np.searchsorted(offsets, doubtful(raw), side="right") - 1] = True
        everything = raw.tobytes()
        for s in self.library.specials:
            mark, k = s.encode("utf-8"), -1
            while (k := everything.find(mark, k + 1)) >= 0:
                whole[np.searchsorted(offsets, k, side="right") - 1] = True
        again = np.flatnonzero(whole & (np.diff(offsets) > 0)).tolist()
        return raw, offsets, everything, again

    def _chunks(self, starts, stops):
        """Ranges of pieces that fit a chunk, and whether they do: a piece longer than one stands alone."""
        at, n = 0, len(starts)
        while at < n:
            end = int(np.searchsorted(stops, starts[at] + CHUNK, side="right"))
            yield at, max(end, at + 1), end > at
            at = max(end, at + 1)

    def lengths(self, column: pa.StringArray) -> np.ndarray:
        """The number of tokens of each text (null: none)."""
        if not len(column):
            return np.zeros(0, np.int64)
        if not self.library.cuts:
            return np.array(self.library.counts([t or "" for t in column.to_pylist()]), dtype=np.int64)
        raw, offsets, everything, again = self._frame(column)
        starts, stops = cut(raw, offsets)
        counts = [np.zeros(0, np.int64)]
        for a, b, fits in self._chunks(starts, stops):
            if fits:
                slots, own = self._known(raw, everything, starts[a:b], stops[a:b])
                count = self.count[slots].astype(np.int64)
                count[own[0]] = own[1]
                counts.append(count)
            else:
                counts.append(np.array(self.library.counts([everything[starts[a] : stops[a]].decode("utf-8")])))
        before = np.append(0, np.cumsum(np.concatenate(counts)))
        out = np.diff(before[np.searchsorted(starts, offsets)])
        out[again] = self.library.counts([everything[offsets[i] : offsets[i + 1]].decode("utf-8") for i in again])
        return out

    def _known(self, raw, everything: bytes, starts, stops):
        """Slots of the pieces of a chunk, of which new ones are added; and those without a slot, with their numbers of tokens."""
        first, last = int(starts[0]), int(stops[-1])
        h, heads, sizes = self.hashes(raw[first:last], starts - first, stops - first)
        slots, missing = self._search(h, heads, sizes)
        if len(missing) and self.filled + len(missing) > self.most:
            self.clear()
            self.begin()
            slots, missing = self._search(h, heads, sizes)
        pieces = lambda at: [everything[s:e] for s, e in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
        if len(missing):
            new = self.new(h, missing)
            self.put(h[new], heads[new], sizes[new], self._counts(pieces(new)))
            slots[missing] = self.find(h[missing], heads[missing], sizes[missing])
        strange = np.flatnonzero(slots < 0)
        return slots, (strange, self._counts(pieces(strange)))

    def _counts(self, pieces: list[bytes]) -> np.ndarray:
        w = self.library.width
        return np.array([len(v) // w for v in self.values(pieces)], dtype=np.int64)

    def hashes(self, part, a, b):
        """Hash, first eight bytes and size of the pieces part[a:b]."""
        sizes = (b - a).astype(np.int32)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_COEFFICIENT[part] * self.forward[: len(part)], out=sums[1:])
            h = (sums[b] - sums[a]) * self.backward[a] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        h[h == 0] = 1
        padded = np.zeros(len(part) + 8, dtype=np.uint8)
        padded[: len(part)] = part
        words = np.ndarray((len(part) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        shift = (np.uint64(8) * (np.uint64(8) - np.minimum(sizes, 8).astype(np.uint64))).astype(np.uint64)
        return h, words[a] << shift, sizes

    def _search(self, h, heads, sizes):
        """Slots of pieces, and which of them may be added."""
        slots = self.find(h, heads, sizes)
        slots[sizes > LONG] = -2
        return slots, np.flatnonzero(slots == -1)

class PieceTable(LengthTable):
    """The ids of pieces too: a place in a pool beside each length (28 bytes a slot)."""

    def clear(self) -> None:
        super().clear()
        self.at = np.zeros(1 << self.bits, dtype=np.int32)
        self.pool = np.zeros(1 << 16, dtype=self.dtype)
        self.used = 0

    def add(self, h, heads, sizes, values: list[bytes]) -> None:
        """Distinct new hashes, for which there is room."""
        if not values:
            return
        counts = np.array([len(v) // self.library.width for v in values], dtype=np.int64)
        ids = np.frombuffer(b"".join(values), self.dtype)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.dtype)])
        self.pool[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        slots, own = self.put(h, heads, sizes, counts)
        self.at[slots] = places[own]

    def encode(self, column: pa.StringArray) -> list[bytes]:
        """The ids of each text (null: none), as little-endian bytes of dtype."""
        n = len(column)
        if not n:
            return []
        if not self.library.cuts:
            return self.library.encoded([t or "" for t in column.to_pylist()])
        raw, offsets, everything, again = self._frame(column)
        out: list[bytes] = [b""] * n
        starts, stops = cut(raw, offsets)
        ids, counts = self._lookup(raw, everything, starts, stops)
        # Tokens before each piece, and so before each text.
        before = np.append(0, np.cumsum(counts))
        cuts = before[np.searchsorted(starts, offsets)] * self.library.width
        flat = ids.tobytes()
        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            out[i] = flat[a:b]
        for i, v in zip(again, self.library.encoded([everything[offsets[i] : offsets[i + 1]].decode("utf-8") for i in again]), strict=True):
            out[i] = v
        return out

    def _lookup(self, raw, everything: bytes, starts, stops):
        parts, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for a, b, fits in self._chunks(starts, stops):
            if fits:
                p, c = self._chunk(raw, everything, starts[a:b], stops[a:b])
            else:
                p = np.frombuffer(self.library.encoded([everything[starts[a] : stops[a]].decode("utf-8")])[0], self.dtype)
                c = np.array([len(p)])
            parts.append(p)
            counts.append(c)
        return np.concatenate(parts), np.concatenate(counts)

    def _chunk(self, raw, everything: bytes, starts, stops):
        first, last = int(starts[0]), int(stops[-1])
        h, heads, sizes = self.hashes(raw[first:last], starts - first, stops - first)
        slots, missing = self._search(h, heads, sizes)
        if len(missing) and (self.used > POOL_IDS or self.filled + len(missing) > self.most):
            self.clear()
            self.begin()
            slots, missing = self._search(h, heads, sizes)
        if len(missing):
            new = self.new(h, missing)
            self.add(h[new], heads[new], sizes[new], self.values([everything[s:e] for s, e in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]))
            slots[missing] = self.find(h[missing], heads[missing], sizes[missing])
        count = self.count[slots].astype(np.int64)
        begin = self.at[slots].astype(np.int64)
        strange = np.flatnonzero(slots < 0).tolist()
        own = self.values([everything[starts[i] : stops[i]] for i in strange]) if strange else []
        for i, v in zip(strange, own, strict=True):
            count[i] = len(v) // self.library.width
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(begin - (ends - count), count) + np.arange(total)
        if strange:
            lost = np.repeat(slots < 0, count)
            take[lost] = 0
        ids = self.pool[take]
        for i, v in zip(strange, own, strict=True):
            ids[ends[i] - count[i] : ends[i]] = np.frombuffer(v, self.dtype)
        return ids, count


_WORKER: dict = {}


def release_table() -> None:
    """Frees this worker's table; stages that do not tokenise call it."""
    _WORKER.clear()


def worker_table(kind, path: str, frequent=None, run: str = ""):
    """This worker's table of a class, kept from task to task. frequent: broadcast entries of a LengthTable, named by run, or None."""
    key = kind.__name__, path, run
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = kind(path, frequent=frequent.value) if frequent is not None else kind(path)
    return _WORKER[key]
