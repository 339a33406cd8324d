"""Exact top-k by inner product over norm buckets.

Vectors are turned to integers, ordered by length and packed into buckets of bounded
rows; queries are packed into blocks likewise. The bucket of the longest vectors (one,
of bounded size) gives every query a first lower bound for its k-th score. Then blocks
and buckets are dealt over a grid: a cell holds a group of blocks (of bounded bytes) and
meets every so-manieth bucket, the longer ones first. So a bucket moves once for a group
of blocks, and a block once for a column, not once a pair; buckets that are too short for
a whole group are not sent to it at all. In a bucket a query's bound and the bucket's
longest vector give a local cosine threshold: above 1 the query skips the bucket; from
``coordinate_from`` on, candidates are pruned by the range that the threshold leaves them
in the query's largest coordinates; below it, by length alone. What is left is verified by
exact products. The k-th best score found so far in a cell raises the query's bound for
the next bucket; at most k rows leave a cell for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, stored

#: Rows of a bucket and of a block.
BUCKET, BLOCK = 2048, 512
#: Bytes of the vectors of a group of blocks, and cells of the grid for each slot of the cluster.
GROUP_BYTES, CELLS_A_SLOT = 16 << 20, 3
#: Coordinates that pruning looks at.
FOCUS = 3
_PACK = "part int, seq int, longest double, ids binary, dim int, kind string, data binary"
_EXACT = float(1 << 53)


def _packed(ids: list, vectors: list, norms: list, part: int, seq: int) -> pa.RecordBatch:
    dim = max(map(len, vectors))
    m = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = v
    kind = "<i2" if np.abs(m).max(initial=0) <= 32767 else "<f8"
    row = [part, seq, max(norms), np.asarray(ids, "<i8").tobytes(), dim, kind, m.astype(kind).tobytes()]
    types = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.int32(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["part", "seq", "longest", "ids", "dim", "kind", "data"])


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], row["kind"]).reshape(-1, row["dim"]).astype(np.float64)


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    v = F.col(f"`{vector_col}`")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(fine, F.lit(False))).where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            offsets = column.offsets.to_numpy()
            flat = np.floor(scale * column.values.to_numpy(zero_copy_only=False))
            parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            norms = [float(np.sqrt(np.dot(x, x))) if len(x) else 0.0 for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norms), pa.array([x.tobytes() for x in parts], pa.binary())], names=["id", "norm", "v"])

    return rows.mapInArrow(run, "id long, norm double, v binary")


def _groups(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows packed by falling length, at most size to a group; groups are numbered from 0, the longest first."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // size))

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, vectors, norms = [], [], []
        for batch in batches:
            for i, n, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids.append(i)
                norms.append(n)
                vectors.append(np.frombuffer(v, "<f8"))
                if len(ids) == size:
                    yield _packed(ids, vectors, norms, part, seq)
                    seq, ids, vectors, norms = seq + 1, [], [], []
        if ids:
            yield _packed(ids, vectors, norms, part, seq)

    ordered = rows.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id")
    packed = stored(ordered.mapInArrow(pack, _PACK), name)
    sizes = sorted(tuple(r) for r in packed.groupBy("part").agg(F.count(F.lit(1))).collect())  # a row for thousands of vectors
    firsts, total = [], 0
    for p, n in sizes:
        firsts.append((p, total))
        total += n
    numbered = spark.createDataFrame(firsts, "part int, first int")
    return packed.join(numbered, "part").select((F.col("first") + F.col("seq")).alias("number"), "longest", "ids", "dim", "kind", "data")


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact integer products, as float64 where they are exact there, else as clipped Python integers."""
    dim = max(q.shape[1], p.shape[1])
    q, p = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, p))
    if len(q) and len(p) and np.sqrt((q * q).sum(1).max()) * np.sqrt((p * p).sum(1).max()) >= _EXACT:
        whole = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in p], dtype=object).T
        return np.vectorize(lambda x: max(-(1 << 63), min((1 << 63) - 1, x)), otypes=[object])(whole)
    return q @ p.T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids."""
    if len(ids) > 4 * k and scores.dtype != object:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


def search_pair(qids, q, theta, pids, p, k: int, coordinate_from: float):
    """(place of query, candidates, scores) of every query's best k in one bucket at its bound theta or above."""
    qn, pn = np.sqrt((q * q).sum(1)), np.sqrt((p * p).sum(1))
    slack = 1 - 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(theta > 0, theta * slack / (qn * pn.max(initial=0)), -1.0)  # cosine that a candidate needs at least
    local = np.where(np.isnan(local), 2.0, local)
    out = []

    def keep(i, among, scores):
        ok = np.flatnonzero((scores >= theta[i]) & (pids[among] != qids[i]))
        if len(ok):
            some, got = among[ok], scores[ok]
            best = _best(pids[some], got, k)
            out.append((i, pids[some][best], np.array([int(x) for x in got[best]], dtype=np.int64)))

    by_length = np.flatnonzero((local <= 1) & (local < coordinate_from))
    if len(by_length):
        needed = np.where(theta[by_length] > 0, theta[by_length] * slack / np.maximum(qn[by_length], 1e-300), -1).min()
        among = np.flatnonzero(pn >= needed)
        scores = products(q[by_length], p[among])
        for row, i in enumerate(by_length):
            keep(i, among, scores[row])
    by_coordinate = np.flatnonzero((local <= 1) & (local >= coordinate_from))
    if len(by_coordinate):
        unit = p / np.maximum(pn, 1e-300)[:, None]
        for i in by_coordinate:
            direction = q[i] / qn[i]
            wide = np.sqrt(max(0.0, 1 - local[i] ** 2)) + 1e-9
            good = pn >= theta[i] * slack / qn[i]
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                if f < unit.shape[1]:
                    middle, half = direction[f] * local[i], np.sqrt(max(0.0, 1 - direction[f] ** 2)) * wide
                    # a cosine c >= local keeps p_f between both ends; the end towards q's side is open, as c may be 1
                    good &= (unit[:, f] >= middle - half) if direction[f] >= 0 else (unit[:, f] <= middle + half)
            among = np.flatnonzero(good)
            if len(among):
                keep(i, among, products(q[i : i + 1], p[among])[0])
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, coordinate_from: float = 0.8, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of highest product for each query.

    Vectors that are null, hold a null or a non-finite component, or have no id take no
    part. Shorter vectors count as filled with zeros. Ties go to the smaller id. Rows
    with a query's own id are not its candidates; a query id that repeats is asked once,
    with the vector that orders first; candidates that repeat each count. Products
    beyond 64 bits are clipped before they are ranked. Empty tables, of vectors or of
    queries, give an empty table. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    ship(spark)
    every = stored(_integers(vectors, id_col, vector_col, scale), "vectors")
    asked = stored(_integers(vectors.where(is_query), id_col, vector_col, scale).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("x")).select("id", "x.norm", "x.v"), "queries")
    buckets, blocks = stored(_groups(every, bucket, "bucket-rows"), "buckets"), _groups(asked, block, "block-rows")
    n = buckets.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = spark.sparkContext.broadcast(buckets.where("number = 0").first().asDict())  # one bucket

    def bounds(batches):
        pids, p = _unpacked(longest.value)
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                qids, q = _unpacked(row)
                scores = products(q, p).astype(np.float64)
                scores = np.where(np.abs(scores) < _EXACT, scores, np.nextafter(scores, -np.inf))  # a bound, not rounded up
                scores[qids[:, None] == pids[None, :]] = -np.inf
                theta = np.partition(scores, len(pids) - k, axis=1)[:, len(pids) - k] if len(pids) > k else np.full(len(qids), -np.inf)
                with np.errstate(divide="ignore"):
                    reach = theta / np.sqrt((q * q).sum(1))  # length that a candidate needs at least
                least = float(np.nan_to_num(reach, nan=0.0, neginf=-1e308).min())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([theta.astype("<f8").tobytes()], pa.binary()), pa.array([least])], names=[*batch.schema.names, "theta", "least"])

    blocks = blocks.withColumnRenamed("number", "block").withColumnRenamed("longest", "q_longest")
    blocks = stored(blocks.mapInArrow(bounds, "block int, q_longest double, ids binary, dim int, kind string, data binary, theta binary, least double"), "blocks")
    n_blocks, most = blocks.agg(F.count(F.lit(1)), F.max(F.octet_length("data") + F.octet_length("ids"))).first()
    if not n_blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = -(-n_blocks // max(1, GROUP_BYTES // most))
    columns = max(1, min(n, -(-CELLS_A_SLOT * spark.sparkContext.defaultParallelism // rows)))
    groups = blocks.groupBy(F.pmod("block", F.lit(rows)).alias("row")).agg(F.min("least").alias("least"))  # a row for thousands of queries
    payload = ["ids", "dim", "kind", "data"]
    cells = blocks.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).select(F.pmod("block", F.lit(rows)).alias("row"), "column", F.lit(-1).alias("number"), *payload, "theta")
    wanted = buckets.select("number", "longest").join(F.broadcast(groups), F.col("least") * (1 - 1e-9) <= F.col("longest")).select("number", "row")
    sent = buckets.drop("longest").join(wanted, "number").select("row", F.pmod("number", F.lit(columns)).alias("column"), "number", *payload, F.lit(None).cast("binary").alias("theta"))
    dealt = cells.unionAll(sent).repartition(rows * columns, "row", "column").sortWithinPartitions("row", "column", "number")

    def search(batches):
        cell, held = None, []

        def out():
            for qids, _, _, best in held:
                some = [(q, *b) for q, b in zip(qids.tolist(), best, strict=True) if b is not None]
                if some:
                    lengths = [len(ids) for _, ids, _ in some]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in some], lengths), pa.int64()), *[pa.array(np.concatenate([x[j] for x in some]), pa.int64()) for j in (1, 2)]], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["row"], row["column"]) != cell:
                    yield from out()
                    cell, held = (row["row"], row["column"]), []
                ids, m = _unpacked(row)
                if row["number"] < 0:
                    held.append((ids, m, np.frombuffer(row["theta"], "<f8").copy(), [None] * len(ids)))
                    continue
                for qids, q, theta, best in held:
                    dim = max(q.shape[1], m.shape[1])
                    q, p = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, m))
                    for j, pids, scores in search_pair(qids, q, theta, ids, p, k, coordinate_from):
                        if best[j] is not None:
                            pids, scores = np.concatenate([best[j][0], pids]), np.concatenate([best[j][1], scores])
                            order = _best(pids, scores, k)
                            pids, scores = pids[order], scores[order]
                        best[j] = pids, scores
                        if len(pids) == k:  # never above the score itself: a float64 may round up
                            bound = float(scores[-1])
                            theta[j] = max(theta[j], bound if abs(bound) < _EXACT else np.nextafter(bound, -np.inf))
        yield from out()

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP8_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(p.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
