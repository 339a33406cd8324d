"""Near-duplicate groups by b-bit MinHash with band candidates and exact confirmation.

1. Every text becomes its set of word shingles (64-bit hashes). ``bands * rows`` minima
   give the band keys; of each minimum the low ``BITS`` bits stay, packed into longs.
2. Equal sets collapse to the smallest id first, so copies never meet in a bucket.
3. In every band bucket a leader (its smallest id) is paired with the members; the packed
   signatures give the similarity, corrected for chance agreement of low bits, by bit
   counts. Members near a leader leave the bucket, those far from it also stay on for a
   next leader; pairs that are not plainly apart are candidate edges. So a bucket gives
   pairs in proportion to its members, not to their square.
4. Connected candidates form groups, which hold every pair over the threshold that shares
   a bucket. Within a group full sets are compared exactly, in blocks of bounded size, as
   products of 0/1 matrices; a block gives a spanning forest of its links. Groups of
   several blocks go on with one set of each tree, as long as their number halves; then
   trees are joined by an exact prefix filter: of any two sets over the threshold both
   hold one of the other's rarest shingles, and only sets of different trees that share
   such a one are compared. So near texts by the thousand cost what their forest costs,
   and texts that share a frame alone meet in their rare shingles or not at all. Where
   the filter would leave more than PAIRS_A_SET pairs a set, as among texts that are all
   just about as like as the threshold, the sets outside of the largest tree meet all
   sets in a grid of blocks instead: exact too, by matrix products, with work that grows
   as the one number times the other.
5. Components of the links; each document gets the smallest id it reaches.

A pair at 0.8 shares no band with probability 5e-8 (32 bands of 4 rows). If one of the two
has left a bucket that both were in, the other is a candidate of the same leader: with
the leader at 0.75 to the first, it has 0.55 or more to the second, whose estimate falls
below 0.3 with probability 6e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import free, raw_texts, slices, stored, with_arrow_columns

BANDS, ROWS, BITS = 32, 4, 4
#: Estimates at which a pair is a candidate, and at which a member leaves a bucket.
LOOSE, TIGHT = 0.3, 0.75
#: Leaders of a bucket before what is left of it counts as candidates of one another as it is.
LEADERS = 4
#: Members and shingles of a block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 1 << 22
#: Pairs that the prefix filter may leave for each set of a group.
PAIRS_A_SET = 32
#: Rows below which the members' ids are broadcast (8 bytes each) instead of shuffling the texts.
BROADCAST_MEMBERS = 1 << 20

_random = np.random.default_rng(20_240_229)
_A = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_C = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; of all its words, if fewer than size."""
    import xxhash

    words = text.lower().split() if text else []  # bytes: A-Z alone, and ASCII blanks alone
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > 400_000:
        _words.clear()
    hashes = list(map(_words.get, words))
    if None in hashes:
        for w in {w for w, h in zip(words, hashes, strict=True) if h is None}:
            _words[w] = xxhash.xxh3_64_intdigest(w)
        hashes = list(map(_words.__getitem__, words))
    h = np.array(hashes, dtype=np.uint64)
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _C[k]
    return np.unique(_mix(total))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(out, (s[at : at + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def _pack(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of minima, rows of longs."""
    per = 64 // BITS
    low = (_mix(low) & np.uint64((1 << BITS) - 1)).reshape(len(low), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def similarity(a: Column, b: Column) -> Column:
    """Estimate from two packed signatures: agreeing minima, less those that agree by chance."""
    words = BANDS * ROWS * BITS // 64
    ones = 0x1111111111111111
    apart = F.lit(0)
    for i in range(words):
        x = a[i].bitwiseXOR(b[i])
        for _ in range(BITS // 2):  # folds each group of bits onto its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1 if _ == 0 else 2))
        apart = apart + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return (1 - apart / (BANDS * ROWS) - chance) / (1 - chance)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, h (the text's hash), n, d1, d2 (the set's digest), sig and keys (band hashes) of every row."""
    import xxhash

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    def start():
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def work(part):
            sets = [shingles(t, size) for t in raw_texts(part, "text")]
            m = np.stack([minima(s) for s in sets])
            bands = m.reshape(len(sets), BANDS, ROWS)
            keys = salt[None, :] + bands[:, :, 0]
            for r in range(1, ROWS):
                keys = _mix(keys) * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r]
            keys, sig = _mix(keys).view(np.int64), _pack(m)
            digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))
            return pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists(sig), lists(keys)

        return work

    out = with_arrow_columns(rows, "n long, d1 long, d2 long, sig array<long>, keys array<long>", start, size_column="text", most_rows=256)
    return out.select("id", "h", "n", "d1", "d2", "sig", "keys")


def candidate_edges(sets: DataFrame) -> DataFrame:
    """u, v of pairs of ids that share a bucket and are not plainly apart, as described above. sets: id, sig, keys."""
    signs = sets.select("id", "sig")
    inside = sets.select("id", F.explode("keys").alias("key"))
    edges = None
    for turn in range(LEADERS + 1):
        leaders = inside.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("last > leader").select("key", "leader")
        leaders = stored(leaders, "leaders")
        pairs = inside.join(leaders, "key").where("id > leader")
        if turn == LEADERS:
            left = pairs.select(F.col("id").alias("u"), F.col("leader").alias("v")).distinct()
            return edges.unionAll(left)
        pairs = stored(pairs.select("key", "id", "leader"), "bucket-pairs")
        seen = pairs.select("id", "leader").distinct()
        seen = seen.join(signs, "id").join(signs.select(F.col("id").alias("leader"), F.col("sig").alias("sig2")), "leader")
        seen = stored(seen.select("id", "leader", similarity(F.col("sig"), F.col("sig2")).alias("s")), "pair-estimates")
        near = seen.where(F.col("s") >= LOOSE).select(F.col("id").alias("u"), F.col("leader").alias("v"))
        edges = near if edges is None else edges.unionAll(near)
        far = seen.where(F.col("s") < TIGHT)
        if not far.limit(1).count():
            return edges
        inside = stored(pairs.join(far.select("id", "leader"), ["id", "leader"]).select("key", "id").distinct(), "bucket-rest")
    raise AssertionError


def linked(sets: list[np.ndarray], ids: list[int], share: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest (id, root) of all links among sets: share[1] * intersection >= share[0] * union."""
    m = len(sets)
    root = list(range(m))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(i, j):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    num, den = share
    order = np.argsort(ids, kind="stable")
    sets, ids, sizes = [sets[i] for i in order], [ids[i] for i in order], sizes[order]
    if m <= 24:
        for i in range(m):
            for j in range(i + 1, m):
                if ids[i] == ids[j]:
                    join(i, j)
                elif den * min(sizes[i], sizes[j]) >= num * max(sizes[i], sizes[j]) and find(i) != find(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if den * both >= num * (sizes[i] + sizes[j] - both):
                        join(i, j)
    else:
        flat = np.concatenate(sets)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), sizes)
        shared = count > 1  # a shingle of one set alone is in no intersection
        number = np.cumsum(shared) - 1
        some = shared[column]
        row, column = row[some], number[column[some]]
        by_column = np.argsort(column, kind="stable")
        row, column = row[by_column], column[by_column]
        both = np.zeros((m, m), dtype=np.float32)
        for at in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, (at, at + 4096))
            part = np.zeros((m, 4096), dtype=np.float32)
            part[row[a:b], column[a:b] - at] = 1
            both += part @ part.T
        for i in range(m):
            inter = both[i, i + 1 :].astype(np.int64)
            for j in np.flatnonzero(den * inter >= num * (sizes[i] + sizes[i + 1 :] - inter)):
                join(i, i + 1 + int(j))
        for i in range(m - 1):
            if ids[i] == ids[i + 1]:
                join(i, i + 1)
    return sorted({(ids[i], ids[find(i)]) for i in range(m) if ids[i] != ids[find(i)]})


def _forests(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """u, v: a spanning forest of the exact links in every block. sets: component, block, id, shingles."""
    dealt = sets.select("component", "block", "id", "shingles").repartition("component", "block").sortWithinPartitions("component", "block", "id")

    def confirm(batches):
        key, ids, found = None, [], []

        def out():
            links = linked(found, ids, share) if len(ids) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["u", "v"])

        for batch in batches:
            for part in slices(batch, "shingles"):
                for c, b, i, s in zip(*[x.to_pylist() for x in part.columns], strict=True):
                    if (c, b) != key:
                        yield from out()
                        key, ids, found = (c, b), [], []
                    ids.append(i)
                    found.append(np.frombuffer(s, "<u8"))
        yield from out()

    return dealt.mapInArrow(confirm, "u long, v long")


def _blocks(c, total, members: int | None = None):
    return F.greatest(F.ceil(c / (members or BLOCK_MEMBERS)), F.ceil(total / BLOCK_SHINGLES)).cast("int")


def _tree_links(sets: DataFrame, trees: DataFrame, share: tuple[int, int]) -> DataFrame:
    """u, v: all links between sets of different trees of a component, by the prefix filter.

    sets: component, id, n, shingles; trees: node and component (its tree's root).
    """
    num, den = share
    labelled = sets.join(trees.select(F.col("node").alias("id"), F.col("component").alias("root")), "id", "left").withColumns({"tree": F.coalesce("root", "id"), "set": F.xxhash64("shingles")}).drop("root")
    several = labelled.groupBy("component").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).where("lo < hi").select("component")
    labelled = stored(labelled.join(several, "component", "left_semi"), "trees")

    def tokens(batches):
        for batch in batches:
            for part in slices(batch, "shingles", most_bytes=1 << 20):
                component, i, own, n, tree, s = part.columns
                at = np.repeat(np.arange(part.num_rows), n.to_numpy())
                flat = np.concatenate([np.frombuffer(x, "<i8") for x in s.to_pylist()])
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in (component, i, own, n, tree)], pa.array(flat)], names=["component", "id", "set", "n", "tree", "tok"])

    toks = labelled.select("component", "id", "set", "n", "tree", "shingles").mapInArrow(tokens, "component long, id long, set long, n long, tree long, tok long")
    held = toks.groupBy("component", "tok").agg(F.count(F.lit(1)).alias("c"), F.min("tree").alias("lo"), F.max("tree").alias("hi"))
    rarest = F.row_number().over(Window.partitionBy("id", "set").orderBy("c", "tok"))
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1
    first = stored(toks.join(held, ["component", "tok"]).withColumn("r", rarest).where((F.col("r") <= prefix) & (F.col("lo") < F.col("hi"))).select("component", "tok", "id", "n", "tree"), "rare-shingles")
    held = first.groupBy("component", "tok", "tree").agg(F.count(F.lit(1)).alias("c")).groupBy("component", "tok").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    posted = held.groupBy("component").agg(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2).alias("pairs"))  # of different trees, by shingle
    whole = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
    dense = stored(whole.join(posted, "component").where(F.col("pairs") > PAIRS_A_SET * F.col("c")).select("component", "c", "total"), "dense-groups")
    grid = _grid_links(labelled, dense, share)
    first = first.join(dense, "component", "left_anti")
    other = first.select("component", "tok", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("tree").alias("tree2"))
    pairs = first.join(other, ["component", "tok"]).where((F.col("tree") < F.col("tree2")) & (den * F.least("n", "n2") >= num * F.greatest("n", "n2"))).select("id", "id2").distinct()
    texts = labelled.select("id", "shingles")
    both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("id2"), F.col("shingles").alias("shingles2")), "id2").select("id", "id2", "shingles", "shingles2")

    def compare(batches):
        for batch in batches:
            for part in slices(batch, "shingles", most_bytes=1 << 20):
                fits = []
                for i, j, a, b in zip(*[x.to_pylist() for x in part.columns], strict=True):
                    a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                    inter = len(np.intersect1d(a, b, assume_unique=True))
                    if den * inter >= num * (len(a) + len(b) - inter):
                        fits.append((i, j))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in fits], pa.int64()), pa.array([y for _, y in fits], pa.int64())], names=["u", "v"])

    return both.mapInArrow(compare, "u long, v long").unionAll(grid)


def _grid_links(sets: DataFrame, dense: DataFrame, share: tuple[int, int]) -> DataFrame:
    """u, v: links of the sets outside of their component's largest tree with all its sets, for the components of dense."""
    mine = sets.join(dense.select("component"), "component", "left_semi")
    largest = mine.groupBy("component", "tree").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.max_by("tree", F.struct("k", "tree")).alias("largest"))
    rest = mine.join(largest, "component").where("tree <> largest")
    outside = rest.groupBy("component").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("r_total"))
    sizes = dense.join(outside, "component").select("component", _blocks(F.col("r"), F.col("r_total"), 2 * BLOCK_MEMBERS).alias("rows"), _blocks(F.col("c"), F.col("total"), 2 * BLOCK_MEMBERS).alias("columns"))
    sizes = stored(sizes, "grids")
    cell = (F.col("row").cast("long") * F.col("columns") + F.col("column")).alias("block")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n)).cast("int")
    across = rest.join(sizes, "component").withColumn("row", own(1, "rows")).withColumn("column", every("columns"))
    down = mine.join(sizes, "component").withColumn("column", own(2, "columns")).withColumn("row", every("rows"))
    cells = across.select("component", cell, "id", "shingles").unionAll(down.select("component", cell, "id", "shingles"))
    return _forests(cells, share)


def confirmed_links(docs: DataFrame, members: DataFrame, n_members: int, id_col: str, text_col: str, size: int, share: tuple[int, int]) -> tuple[DataFrame, DataFrame | None]:
    """node and component of all exact links inside groups that are one block, and (or None) of those in larger groups.

    members: id, component, n. Members of large groups are shuffled with their shingles
    once a round, not once a block.
    """
    groups = members.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
    placed = stored(members.join(groups, "component").select(F.col("id").alias("_id"), "component", F.col("n").alias("_n"), _blocks(F.col("c"), F.col("total")).alias("blocks")), "members")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")

    def start():
        return lambda part: (pa.array([shingles(t, size).tobytes() for t in raw_texts(part, "text")], pa.binary()),)

    def sets(some: DataFrame) -> DataFrame:
        side = F.broadcast(some) if n_members <= BROADCAST_MEMBERS else some
        found = texts.join(side, F.col("id") == F.col("_id")).select(F.col("id").cast("long").alias("id"), "text", "component")
        made = with_arrow_columns(found, "shingles binary", start, size_column="text").drop("text")
        return made.withColumn("n", F.expr("octet_length(shingles) div 8"))

    small = stored(_forests(sets(placed.where("blocks = 1")).withColumn("block", F.lit(0)), share), "links").select(F.col("u").alias("node"), F.col("v").alias("component"))
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return small, None
    every = stored(sets(large).dropDuplicates(["id", "shingles"]), "large-groups")
    left, links, turn, n, before = every, None, 0, every.count(), None
    while before is None or 2 * n <= before:
        sizes = left.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
        sizes = sizes.select("component", _blocks(F.col("c"), F.col("total")).alias("blocks"))
        dealt = left.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "id"), F.col("blocks")).cast("int"))
        found = stored(_forests(dealt, share), "block-links")
        links = found if links is None else links.unionAll(found)
        left = stored(left.join(found.select(F.col("u").alias("id")).distinct(), "id", "left_anti").select(*left.columns), "roots")
        before, n, turn = n, left.count(), turn + 1
    links = links.unionAll(_tree_links(every, components(links, "trees-of-blocks"), share))
    return small, components(links, "link-components")


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """id, h (hash of the text), n_shingles, component_id (smallest id reachable) and kept, one for each row of docs.

    Words are lower-cased (A-Z) and separated by ASCII blanks; a set holds the distinct
    shingles of ``size`` words, or the whole sequence if it is shorter. Texts that are null
    or without words have an empty set and are linked with nothing. Documents are linked if
    their sets' Jaccard similarity is share[0] / share[1] or more; kept: whether the
    component's id is the row's own. Rows that share an id are each judged by their own
    text. Rows without an id take no part: component_id null, kept true. Texts of any
    length are taken whole. An empty table gives an empty table; columns of docs besides
    the two are ignored, whatever their names.
    """
    prints = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    full = prints.where("id IS NOT NULL AND n > 0")
    reps = stored(full.groupBy("d1", "d2").agg(F.min("id").alias("rep")), "distinct-sets")
    sets = full.join(reps.select(F.col("rep").alias("id"), F.col("d1").alias("e1"), F.col("d2").alias("e2")), "id").where("d1 = e1 AND d2 = e2")
    sets = stored(sets.select("id", "n", "sig", "keys"), "set-signatures")
    groups = components(candidate_edges(sets), "candidate-groups")
    lone = groups.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    members = groups.select(F.col("node").alias("id"), "component").unionAll(lone)
    members = stored(members.join(sets.groupBy("id").agg(F.max("n").alias("n")), "id"), "grouped")
    final, more = confirmed_links(docs, members, members.count(), id_col, text_col, size, share)
    final = final if more is None else final.unionAll(more)
    classes = reps.join(final, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    placed = prints.select("id", "h", "n", "d1", "d2").join(stored(classes, "classes"), ["d1", "d2"], "left")
    own = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("id")))
    return placed.select("id", "h", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of docs that duplicate_classes keeps, with their columns."""
    key, mark = free(docs, "_gone"), free(docs, "_gone_h")
    gone = duplicate_classes(docs, id_col, text_col, size, share).where("NOT kept").select(F.col("id").alias(key), F.col("h").alias(mark))
    text = F.col(f"`{text_col}`").cast("string")
    return docs.join(gone, (F.col(f"`{id_col}`") == F.col(key)) & (F.xxhash64(text) == F.col(mark)), "left_anti")


def op5_near_dup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return duplicate_classes(docs, size=4).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT i.a, i.b FROM i JOIN n x ON i.a = x.doc_id JOIN n y ON i.b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
), r AS (
  SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
"""
