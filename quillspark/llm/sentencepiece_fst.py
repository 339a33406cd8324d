"""SentencePiece encoding and decoding as shortest paths of weighted finite-state transducers.

A model is compiled to arrays once: the normaliser (dummy prefix, escaped spaces), the
pieces with their weights, and byte fallback, an arc for each character that is no piece.
Each input, cut into segments at borders that no piece crosses, is composed with them:
the arcs of its lattice are found for all segments of a batch at once by rolling hashes.
Segments are cut again wherever no arc of their own lattice crosses, as every path passes
there. The path of least weight in the tropical semiring (min, +) is taken position by
position, for all spans of like length at once; a long span alone, as of one character
that repeats, is walked in plain Python over its arcs, in windows of bounded size.

* Unigram models: an arc weighs its piece's negative log probability.
* BPE models: arcs weigh nothing, but the lattice is further composed with an acceptor of
  neighbouring pieces, which gives infinite weight to pairs that BPE would not leave side
  by side. A sequence of pieces is BPE's own just if all its neighbours may stand
  together, so one path alone has finite weight, and one alone for every prefix. So the
  result is the library's.

Whether two pieces may stand together is decided by undoing their merges, the later one
first, and looking whether a merge across the border would have come before.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import id_type
from .shared import raw_texts, with_arrow_columns

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Segments by places of a batch of lattices.
CELLS = 1 << 20
NONE = -1
#: Characters from which a span is walked alone, places of a window of it, and pairs of pieces remembered for it.
ALONE, WINDOW, PAIRS = 512, 4096, 1 << 20


def _fields(raw: bytes):
    """(number, value) of a protocol buffer's fields; nested ones stay bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            yield key >> 3, raw[at : at + 4]
            at += 4
        elif kind == 1:
            yield key >> 3, raw[at : at + 8]
            at += 8
        else:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Model:
    """A compiled model; plain arrays, so that it is broadcast cheaply (bounded by the vocabulary)."""

    kind: int
    prefix: bool
    squeeze: bool
    surfaces: list[bytes]  # by id, what decoding gives
    byte_ids: list[int]
    unknown: int
    fallback: bool
    order: np.ndarray  # ids of usable pieces, single characters first, then as they merge
    hashes: np.ndarray
    lengths: np.ndarray
    weights: np.ndarray
    left: np.ndarray
    right: np.ndarray
    crosses: bool  # some piece has a space after another character
    has_newline: bool
    slots: np.ndarray = field(default=None, repr=False)
    powers: np.ndarray = field(default=None, repr=False)

    def prepare(self) -> Model:
        """Rebuilds the piece table: open addressing, a power of two of slots."""
        bits = max(12, len(self.hashes).bit_length() + 3)
        self.slots = np.full((1 << bits) + 64, NONE, dtype=np.int32)
        self.shift = np.uint64(64 - bits)
        self.probes = 1
        for i, h in enumerate(self.hashes.tolist()):
            s = ((h * int(_R)) & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            n = 1
            while self.slots[s] != NONE:
                s, n = s + 1, n + 1
            self.slots[s] = i
            self.probes = max(self.probes, n)
        with np.errstate(over="ignore"):
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(64, _R))]).astype(np.uint64)
        self.longest = int(self.lengths.max(initial=1))
        return self

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of pieces with these hashes, or NONE."""
        with np.errstate(over="ignore"):
            s = ((hashes * _R) >> self.shift).astype(np.int64)
        out = np.full(len(hashes), NONE, dtype=np.int32)
        open_ = np.arange(len(hashes))
        for p in range(self.probes):
            got = self.slots[s[open_] + p]
            some = got != NONE
            open_, got = open_[some], got[some]
            hit = self.hashes[got] == hashes[open_]
            out[open_[hit]] = got[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def _hash(codes) -> int:
    h = 0
    for c in codes:
        h = (h * int(_R) + int(c) * 0xD6E8FEB86659FD93 + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def compile_model(path: str) -> Model:
    with open(path, "rb") as f:
        raw = f.read()
    pieces: list[tuple[str, float, int]] = []
    kind, unknown_surface = UNIGRAM, " ⁇ "
    prefix = squeeze = escape = True
    charsmap, fallback = b"", False
    for number, value in _fields(raw):
        if number == 1:
            text, score, type_ = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode("utf-8")
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    type_ = v
            pieces.append((text, score, type_))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    kind = v
                elif n == 35:
                    fallback = bool(v)
                elif n == 44:
                    unknown_surface = v.decode("utf-8")
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    charsmap = v
                elif n == 3:
                    prefix = bool(v)
                elif n == 4:
                    squeeze = bool(v)
                elif n == 5:
                    escape = bool(v)
    if charsmap or not escape or kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models with the identity normaliser and escaped spaces are compiled")
    if any(t == USER for _, _, t in pieces):
        raise ValueError("user-defined pieces are not compiled")
    surfaces, byte_ids, unknown = [], [0] * 256, 0
    for i, (text, _, t) in enumerate(pieces):
        if t == BYTE:
            byte_ids[int(text[3:5], 16)] = i
            surfaces.append(bytes([int(text[3:5], 16)]))
        elif t == CONTROL:
            surfaces.append(b"")
        elif t == UNKNOWN:
            unknown = i
            surfaces.append(unknown_surface.encode("utf-8"))
        else:
            surfaces.append(text.replace(SPACE, " ").encode("utf-8"))
    usable = [i for i, (_, _, t) in enumerate(pieces) if t == NORMAL]
    usable.sort(key=lambda i: (len(pieces[i][0]) > 1, -pieces[i][1], i))
    texts = [pieces[i][0] for i in usable]
    index = {t: n for n, t in enumerate(texts)}
    left, right = np.arange(len(usable)), np.arange(len(usable))
    if kind == BPE:
        for n, text in enumerate(texts):
            if len(text) > 1:
                last = _last_merge(text, index)
                if last is None:  # BPE never makes it
                    left[n] = right[n] = NONE
                else:
                    left[n], right[n] = last
    hashes = np.array([_hash(map(ord, t)) for t in texts], dtype=np.uint64)
    if len(set(hashes.tolist())) != len(texts):
        raise ValueError("two pieces have one hash")
    return Model(
        kind, prefix, squeeze, surfaces, byte_ids, unknown, fallback, np.array(usable), hashes, np.array([len(t) for t in texts]), np.array([-pieces[i][1] for i in usable], dtype=np.float64),
        left.astype(np.int64), right.astype(np.int64), any(SPACE in t.lstrip(SPACE) for t in texts), any("\n" in t for t in texts),
    )


def _last_merge(text: str, index: dict[str, int]) -> tuple[int, int] | None:
    """The two pieces that BPE merges last to make text, or None."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            n = index.get(parts[i] + parts[i + 1])
            if n is not None and (best is None or n < best):
                best, at = n, i
        if best is None:
            return None
        if len(parts) == 2:
            pair = index.get(parts[0]), index.get(parts[1])
            return None if None in pair else pair
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return None


def may_stand_together(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE leaves pieces a and b side by side. NONE stands for an unknown character or the start."""
    ok = np.ones(len(a), dtype=bool)
    open_ = np.flatnonzero((a != NONE) & (b != NONE))
    a, b = a[open_].astype(np.int64), b[open_].astype(np.int64)
    limit = np.full(len(open_), 1 << 40)
    while len(open_):
        with np.errstate(over="ignore"):
            joined = model.find(model.hashes[a] * model.powers[np.minimum(model.lengths[b], 64)] + model.hashes[b])
        wrong = (joined != NONE) & (joined < limit)
        ok[open_[wrong]] = False
        single_a, single_b = model.left[a] == a, model.left[b] == b
        undo_a = ~single_a & (single_b | (a > b))
        done = wrong | (single_a & single_b)
        # A merge on the left comes before an equal one across the border, one on the right after it.
        limit = np.where(undo_a, a, b + 1)
        a, b = np.where(undo_a, model.right[a], a), np.where(undo_a, b, model.left[b])
        stay = ~done
        open_, a, b, limit = open_[stay], a[stay], b[stay], limit[stay]
    return ok


def encode_segments(model: Model, segments: list[str]) -> list[bytes]:
    """Ids (little-endian, of id_type) of segments, in which spaces are escaped."""
    out: list[bytes] = [b""] * len(segments)
    order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
    at = 0
    while at < len(order):
        end = at + 1  # as many of like length as fit a table of bounded size; one alone in any case
        while end < len(order) and end - at < 8192 and (end + 1 - at) * (len(segments[order[end]]) + 1) <= CELLS:
            end += 1
        part = order[at:end]
        for i, v in zip(part, _shortest(model, [segments[i] for i in part]), strict=True):
            out[i] = v
        at = end
    return out


def _shortest(model: Model, segments: list[str]) -> list[bytes]:
    n = len(segments)
    codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(n), sizes)
    pos = np.arange(len(codes)) - starts[seg]
    # All arcs: at each place the hash grows by a character, as long as some piece may be that long.
    found_at, found_to, found_piece = [], [], []
    with np.errstate(over="ignore"):
        grown = codes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        here = np.arange(len(codes))
        h = np.zeros(len(codes), dtype=np.uint64)
        for length in range(1, model.longest + 1):
            here = here[pos[here] + length <= sizes[seg[here]]] if length > 1 else here
            if not len(here):
                break
            h[here] = h[here] * _R + grown[here + (length - 1)]
            piece = model.find(h[here])
            if length == 1:
                hit = np.ones(len(here), dtype=bool)  # an unknown character is an arc to bytes
            else:
                hit = piece != NONE
                if model.kind == BPE:
                    hit &= model.left[piece] != NONE
            found_at.append(here[hit].astype(np.int32))
            found_to.append((here[hit] + length).astype(np.int32))
            found_piece.append(piece[hit])
    if not found_at:
        return [b""] * n
    a, b, piece = np.concatenate(found_at), np.concatenate(found_to), np.concatenate(found_piece)
    # Borders: where a segment starts, and where no arc crosses.
    crossing = np.bincount(a + 1, minlength=len(codes) + 1) - np.bincount(b, minlength=len(codes) + 1)
    border = np.cumsum(crossing)[: len(codes)] == 0
    border[starts[sizes > 0]] = True
    begins = np.flatnonzero(border)
    lengths = np.diff(np.append(begins, len(codes)))
    span = np.cumsum(border) - 1
    order = np.lexsort((a, b))
    a, b, piece = a[order], b[order], piece[order]
    at, what = [], []  # where each piece of the best paths begins, and which it is
    for k in np.flatnonzero(lengths > ALONE).tolist():
        first, last = begins[k], begins[k] + lengths[k]
        x, y = np.searchsorted(b, (first, last), side="right")
        inside = np.arange(x, y)[a[x:y] >= first]
        where, which = _walk(model, a[inside] - first, b[inside] - first, piece[inside], int(lengths[k]))
        at.append(where + first)
        what.append(which)
    bounds = []
    for k in range(ALONE.bit_length()):  # spans of like length, as many as fit a table of bounded size
        some = np.flatnonzero((lengths >= 1 << k) & (lengths < min(2 << k, ALONE + 1)))
        most = max(1, CELLS // (2 << k))
        bounds += [some[x : x + most] for x in range(0, len(some), most)]
    for part in bounds:
        mine = np.full(len(begins), NONE, dtype=np.int64)
        mine[part] = np.arange(len(part))
        inside = np.flatnonzero(mine[span[a]] != NONE)
        offset = begins[span[a[inside]]]
        where, which = _table(model, lengths[part], mine[span[a[inside]]], a[inside] - offset, b[inside] - offset, piece[inside])
        rows, places = where
        at.append(places + begins[part][rows])
        what.append(which)
    i, p = np.concatenate(at), np.concatenate(what)
    order = np.argsort(i)
    i, p = i[order], p[order]
    rows, i = seg[i], i - starts[seg[i]]
    dtype = id_type(len(model.surfaces))
    ids = np.where(p == NONE, 0, model.order[p]).astype(dtype)
    raw, width = ids.tobytes(), np.dtype(dtype).itemsize
    ends = np.searchsorted(rows, np.arange(n), side="right") * width
    begins = np.append(0, ends[:-1])
    out = [raw[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
    for k in np.unique(rows[p == NONE]).tolist():
        mine, tokens = rows == k, []
        for q, c in zip(p[mine].tolist(), i[mine].tolist(), strict=True):
            if q != NONE:
                tokens.append(int(model.order[q]))
            elif model.fallback:
                tokens += [model.byte_ids[x] for x in segments[k][c].encode("utf-8")]
            elif not tokens or tokens[-1] != model.unknown:  # a run of unknown characters is one
                tokens.append(model.unknown)
        out[k] = np.array(tokens, dtype=dtype).tobytes()
    return out


def _table(model: Model, sizes: np.ndarray, where: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: np.ndarray):
    """Rows and places where the pieces of the shortest paths begin, and the pieces, of spans of like length and their arcs."""
    n, widest = len(sizes), int(sizes.max(initial=0))
    order = np.lexsort((begin, end)) if model.kind == UNIGRAM else np.argsort(end, kind="stable")
    where, begin, end, piece = where[order], begin[order], end[order], piece[order]
    cuts = np.searchsorted(end, np.arange(1, widest + 2))
    last = np.full((n, widest + 1), NONE, dtype=np.int64)  # piece that ends here on the best path
    back = np.full((n, widest + 1), NONE, dtype=np.int64)
    back[:, 0] = 0
    if model.kind == UNIGRAM:
        cost = np.full((n, widest + 1), np.inf)
        cost[:, 0] = 0
        strange = (model.weights.max() if len(model.weights) else 0) + 10.0
    for j in range(widest):
        s = slice(cuts[j], cuts[j + 1])
        w, i, p = where[s], begin[s], piece[s]
        if model.kind == BPE:
            reached = back[w, i] != NONE
            w, i, p = w[reached], i[reached], p[reached]
            fine = may_stand_together(model, last[w, i], p)
            w, i, p = w[fine], i[fine], p[fine]
            last[w, j + 1], back[w, j + 1] = p, i
        else:
            total = cost[w, i] + np.where(p == NONE, strange, model.weights[p])
            best = np.lexsort((i, total, w))
            w, i, p, total = w[best], i[best], p[best], total[best]
            first = np.ones(len(w), dtype=bool)
            first[1:] = w[1:] != w[:-1]
            w, i, p = w[first], i[first], p[first]
            last[w, j + 1], back[w, j + 1], cost[w, j + 1] = p, i, total[first]
    # Walk back from each end, all segments at once.
    at = sizes.copy()
    rows = np.flatnonzero(at > 0)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        p, i = last[rows, at[rows]], back[rows, at[rows]]
        if (i == NONE).any():
            raise AssertionError("a span has no path")
        steps.append((rows, p, i))
        at[rows] = i
        rows = rows[i > 0]
    rows, p, i = (np.concatenate([s[k] for s in steps]) for k in range(3))
    return (rows, i), p


def _walk(model: Model, begin: np.ndarray, end: np.ndarray, piece: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long span; arcs come by their ends. Pairs of pieces are judged a window at a time, each once."""
    last, back = [NONE] * (size + 1), [NONE] * (size + 1)
    back[0] = 0
    cost = [0.0] + [float("inf")] * size
    strange = float(model.weights.max(initial=0)) + 10.0
    fits: dict[int, bool] = {}
    n = len(model.order) + 1
    for low in range(0, size, WINDOW):
        x, y = np.searchsorted(end, (low, low + WINDOW), side="right")
        b, e, p = begin[x:y], end[x:y], piece[x:y].astype(np.int64)
        if model.kind == BPE:
            # Any piece that ends where another begins: those of the window, and those of before that reach it.
            x0 = int(np.searchsorted(end, low - model.longest, side="right"))
            ends, left = end[x0:y], piece[x0:y].astype(np.int64)
            start, stop = np.searchsorted(ends, b), np.searchsorted(ends, b, side="right")
            counts = stop - start
            total = int(counts.sum())
            index = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(total)
            codes = np.unique((left[index] + 1) * n + np.repeat(p, counts) + 1)
            if len(fits) > PAIRS:
                fits.clear()
            new = np.array([c for c in codes.tolist() if c not in fits], dtype=np.int64)
            fits.update(zip(new.tolist(), may_stand_together(model, new // n - 1, new % n - 1).tolist(), strict=True))
        weights = np.where(p == NONE, strange, model.weights[p]).tolist() if model.kind == UNIGRAM else ()
        for k, (i, j, q) in enumerate(zip(b.tolist(), e.tolist(), p.tolist(), strict=True)):
            if back[i] == NONE:
                continue
            if model.kind == UNIGRAM:
                if cost[i] + weights[k] < cost[j]:
                    cost[j], last[j], back[j] = cost[i] + weights[k], q, i
            elif i == 0 or fits[(last[i] + 1) * n + q + 1]:
                last[j], back[j] = q, i
    where, which, at = [], [], size
    while at > 0:
        if back[at] == NONE:
            raise AssertionError("a span has no path")
        which.append(last[at])
        at = back[at]
        where.append(at)
    return np.array(where[::-1], dtype=np.int64), np.array(which[::-1], dtype=np.int64)


class Coder:
    """Encodes and decodes texts with a compiled model, keeping segments in two generations."""

    def __init__(self, model: Model, entries: int = 400_000):
        self.model, self.entries = model.prepare(), entries
        self.width = np.dtype(id_type(len(model.surfaces))).itemsize
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.runs = re.compile(r"\n| *[^ \n]+| +")

    def cut(self, text: str) -> list[str]:
        """Keys whose values joined are the text's: '\\nx' for a newline and x, ' x' as it is, else x for ' x'."""
        model = self.model
        if SPACE in text:  # the same symbol as an escaped space
            text = text.replace(SPACE, " ")
        if model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        if model.crosses or model.has_newline or not model.fallback:
            return [" " + (" " if model.prefix else "") + text]
        if model.prefix and text[0] not in " \n":
            cut = text.replace("\n", " \n").split(" ")
            if "" not in cut:
                return cut
        return [s if s[0] == "\n" else " " + s for s in self.runs.findall((" " if model.prefix else "") + text)]

    def escaped(self, key: str) -> str:
        """The segment that a key stands for: ' ' leads one that is whole, without it a space is meant."""
        return (key[1:] if key[0] == " " else " " + key).replace(" ", SPACE)

    def known(self, seen: set[str]) -> dict[str, bytes]:
        if len(self.cache) > self.entries:
            self.older, self.cache = self.cache, {}
        order = list(seen)
        local = dict(zip(order, map(self.cache.get, order), strict=True))
        fresh = []
        for k in [k for k, v in local.items() if v is None]:
            if k in self.older:
                self.cache[k] = local[k] = self.older[k]
            else:
                fresh.append(k)
        if fresh:
            newline = encode_segments(self.model, ["\n"])[0] if any(k[0] == "\n" for k in fresh) else b""
            values = encode_segments(self.model, [k[1:].replace(" ", SPACE) if k[0] == "\n" else self.escaped(k) for k in fresh])
            values = [newline + v if k[0] == "\n" else v for k, v in zip(fresh, values, strict=True)]
            self.cache.update(zip(fresh, values, strict=True))
            local.update(zip(fresh, values, strict=True))
        return local

    def encode(self, texts: list[str]) -> list[bytes]:
        cuts = [self.cut(t) for t in texts]
        get = self.known(set().union(*cuts)).__getitem__
        return [b"".join(map(get, c)) for c in cuts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, one a byte."""
        table = self.model.surfaces
        raw = b"".join([table[i] for i in np.frombuffer(ids, id_type(len(table))).tolist()])
        if self.model.prefix and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")


_WORKER: dict = {}


def encode_texts(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_crc32 and round_trip (the ids decode to the text), and ids if asked for.

    Whole texts are encoded; a null text counts as the empty one, which has no ids.
    Models that squeeze spaces cannot give them back, so that round_trip is then false for
    texts that have such, as it is for texts that hold the escape sign itself. Repeated rows each have their own; an empty table gives an
    empty one; columns of docs that have one of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(compile_model(path))

    def start():
        if path not in _WORKER:
            _WORKER.clear()
            _WORKER[path] = Coder(shared.value)
        coder = _WORKER[path]
        w, dtype = coder.width, id_type(len(coder.model.surfaces))

        def work(rows):
            texts = [(t or b"").decode("utf-8", "replace") for t in raw_texts(rows, text_col)]
            ids = coder.encode(texts)
            columns = [
                pa.array([len(x) // w for x in ids], pa.int64()),
                pa.array([zlib.crc32(x if w == 4 else np.frombuffer(x, dtype).astype("<u4")) for x in ids], pa.int64()),
                pa.array([coder.decode(x) == t for x, t in zip(ids, texts, strict=True)]),
            ]
            if with_ids:
                flat = np.frombuffer(b"".join(ids), dtype).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) // w for x in ids])), pa.int32()), pa.array(flat)))
            return columns

        return work

    fields = "n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return with_arrow_columns(docs, fields, start, size_column=text_col)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", "ids_crc32", "round_trip")
