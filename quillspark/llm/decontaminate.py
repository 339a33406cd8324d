"""Benchmark decontamination: one Aho-Corasick automaton over normalised questions and answers.

Texts become their words, lower-cased and joined by single spaces. Each item is cut into
blocks of half a window, end to end; a block is a pattern with a space at either end, so
that it matches whole words alone. Every window holds a whole block, so a scan, which
reads each text once, finds a block wherever a window occurs. Only the windows of the
text around a block are then looked up, by their 128-bit digests, among all windows of
the items. Hits are ranges of words; for texts that have any, they are mapped to
character offsets of the original.

An automaton holds each item's text once, not once a place of the window. The items'
bytes are counted before they are collected: they are dealt into as many shards as keep
each automaton under ``shard_bytes`` of item text (about 80 bytes of memory a byte). One
shard (the normal case) needs no shuffle at all; more are scanned one after the other,
and only rows with hits are joined back.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free, raw_texts, stored, with_arrow_columns

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPAN = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return text.translate(_KEEP).split() if text else []


def digest(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


class Automaton:
    """Blocks of items (item id or None, text), and the items of every window by its digest."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int):
        import ahocorasick

        self.size, half = size, (size + 1) // 2
        blocks: dict[bytes, int] = {}
        found: dict[bytes, tuple[str, ...]] = {}
        ids: dict[tuple, tuple[str, ...]] = {}  # equal lists of items are held once
        for item, text in items:
            words = words_of(text)
            n = min(size, len(words))
            if not n:
                continue
            step = half if len(words) >= size else n
            for i in range(0, len(words) - step + 1, step):
                blocks[b" " + b" ".join(words[i : i + step]) + b" "] = step
            for i in range(len(words) - n + 1):
                key = digest(words[i : i + n])
                old = found.get(key, ())
                if item is not None and item not in old:
                    old = (*old, item)
                found[key] = ids.setdefault(old, old)
        self.windows = found
        self.shorter = sorted({n for _, text in items if 0 < (n := len(words_of(text))) < size})
        self.automaton = ahocorasick.Automaton() if blocks else None
        for block, n in blocks.items():
            self.automaton.add_word(block.decode("latin-1"), n)
        if blocks:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges of words (start, end) that lie in windows, and the items these are of."""
        if self.automaton is None or not words:
            return [], set()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")  # one character a byte
        hits = list(self.automaton.iter(joined))
        if not hits:
            return [], set()
        ends = np.cumsum([len(w) + 1 for w in words])  # place of the space after each word
        last = np.searchsorted(ends, [at for at, _ in hits]).tolist()
        places: set[tuple[int, int]] = set()  # where a window may stand: start and number of words
        for end, (_, n) in zip(last, hits, strict=True):
            start = end + 1 - n
            places.update((i, self.size) for i in range(max(0, end + 1 - self.size), min(start, len(words) - self.size) + 1))
            if n in self.shorter:
                places.add((start, n))
        ranges, items = [], set()
        for i, n in sorted(places):
            ids = self.windows.get(digest(words[i : i + n]))
            if ids is not None:
                ranges.append((i, i + n))
                items.update(ids)
        merged: list[tuple[int, int]] = []
        for a, b in ranges:
            if merged and a <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        return merged, items


def spans_of(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original of ranges of words."""
    places = [m.span() for m in _SPAN.finditer(text.translate(_KEEP))]
    count = np.cumsum(np.append(0, (np.frombuffer(text, np.uint8) & 0xC0) != 0x80))  # characters before each byte
    return [(int(count[places[a][0]]), int(count[places[b - 1][1]])) for a, b in ranges]


_WORKER: dict = {}
FIELDS = "n_words long, ranges array<struct<start:long,end:long>>, item_ids array<string>, spans array<struct<start:long,end:long>>"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(docs: DataFrame, items: list, text_col: str, size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def start():
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = Automaton(shared.value, size)
        automaton = _WORKER[key]

        def work(rows):
            counts, ranges, ids, spans = [], [], [], []
            for text in raw_texts(rows, text_col):
                words = words_of(text)
                hit, items = automaton.scan(words)
                counts.append(len(words))
                ranges.append([{"start": a, "end": b} for a, b in hit])
                ids.append(sorted(items))
                spans.append([{"start": a, "end": b} for a, b in spans_of(text, hit)] if hit else [])
            return pa.array(counts, pa.int64()), pa.array(ranges, _RANGES), pa.array(ids, pa.list_(pa.string())), pa.array(spans, _RANGES)

        return work

    return with_arrow_columns(docs, FIELDS, start, size_column=text_col)


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20, shard_bytes: int = 4 << 20
) -> DataFrame:
    """docs with n_words, ranges, item_ids, spans, n_hit and contaminated.

    A window is ``size`` consecutive words of an item, or all of them if it has fewer. A
    word of a document within an occurrence of a window is hit; a document is
    contaminated if it has hits and share * n_hit >= n_words. Null and empty texts have no
    words; items without words give no window, items without an id hit but are not
    listed. Repeated rows are each judged; items that repeat count once by their id. Texts
    of any length are scanned whole; a single item has to fit a shard's memory. An empty
    table of documents gives an empty table, one of items no hits. Columns of docs that
    have one of the new names are replaced, others pass through.
    """
    asked = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").cast("binary").alias("text"))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    deal = F.pmod(F.xxhash64("id", "text"), F.lit(shards))
    pick = lambda k: [(r[0], bytes(r[1]) if r[1] is not None else None) for r in asked.where(deal == k).collect()]
    if shards == 1:
        out = _scan(docs, pick(0), text_col, size)
    else:
        h1, h2 = free(docs, "_h1"), free(docs, "_h2")
        texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")
        parts = []
        for k in range(shards):
            hit = _scan(texts, pick(k), "text", size).where(F.size("ranges") > 0)
            both = F.arrays_zip("ranges", "spans").alias("both")
            parts.append(stored(hit.select(F.xxhash64("text").alias(h1), F.xxhash64(F.lit(7), "text").alias(h2), both, "item_ids"), "hits"))
        one = parts[0]
        for p in parts[1:]:
            one = one.unionAll(p)
        one = one.distinct().groupBy(h1, h2).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("both", "item_ids")])
        kind = one.schema["both"].dataType.simpleString()
        joined = "named_struct('ranges', named_struct('start', {0}.ranges.start, 'end', greatest({0}.ranges.end, x.ranges.end)), 'spans', named_struct('start', {0}.spans.start, 'end', greatest({0}.spans.end, x.spans.end)))"
        merge = f"aggregate(both, cast(array() as {kind}), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).ranges.end >= x.ranges.start, concat(slice(acc, 1, size(acc) - 1), array({joined.format('element_at(acc, -1)')})), concat(acc, array(x))))"
        one = one.withColumn("both", F.expr(merge)).select(h1, h2, F.col("both.ranges").alias("ranges"), F.col("both.spans").alias("spans"), "item_ids")
        base = _scan(docs, [], text_col, size).drop("ranges", "item_ids", "spans")
        base = base.withColumns({h1: F.xxhash64(f"`{text_col}`"), h2: F.xxhash64(F.lit(7), f"`{text_col}`")})
        out = base.join(one, [h1, h2], "left").drop(h1, h2)
        empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
        out = out.withColumns({"ranges": F.coalesce("ranges", empty), "spans": F.coalesce("spans", empty), "item_ids": F.coalesce("item_ids", F.expr("cast(array() as array<string>)"))})
    hits = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return out.withColumn("n_hit", hits).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM bw WHERE len(w) > 0)
), firsts AS (
  SELECT DISTINCT n, string_split(s, ' ')[1] AS f FROM win
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw WHERE len(w) > 0
), cand AS (
  SELECT p.doc_id, p.i, f.n, array_to_string(p.w[p.i : p.i + f.n - 1], ' ') AS s
  FROM places p JOIN firsts f ON p.w[p.i] = f.f AND p.i + f.n - 1 <= len(p.w)
), hit AS (
  SELECT c.doc_id, c.i, c.n, win.item_id FROM cand c JOIN win ON c.s = win.s AND c.n = win.n
), hw AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items, sha256(coalesce(hi.ids, '')) AS items_sha256,
       coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""
