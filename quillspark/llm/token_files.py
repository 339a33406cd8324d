"""Token-ID files: shared-table rANS blocks in ascending id order, written and read by all executors.

Layout under the target path, both parts plain Parquet, so that any store Spark writes
to holds them and its commit protocol covers lost executors:

* ``table``: symbol, freq - the static frequency table that all blocks share.
* ``blocks``: one row a block of whole documents: part and block number, the tokens
  before it in its part, its documents' ids and lengths, and the rANS block (lanes,
  words, and for each checkpoint its place in the words, its states and a CRC-32).

Parts follow the ids' order (a range partitioning), blocks within a part too. Only one
total a part and the frequency table (bounded by the vocabulary) reach the driver.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .piece_table import PieceTable, release_table, worker_table
from .shared import new_path, ship, slices, stored

#: Tokens after which a block is closed; a longer document makes its block longer.
BLOCK_TOKENS = 1 << 20
#: Encoded MB that a range of ids aims at.
PART_MB = 32

BLOCKS = "part int, block int, before long, ids array<long>, lengths array<long>, n long, lanes int, every int, words binary, places array<long>, states array<binary>, crcs array<long>"


def _packer():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def encoded_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """id, n and ids (compressed little-endian, of 16 or 32 bits) of every row, the end id appended."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def tokenise(batches):
        table, (pack, _) = worker_table(PieceTable, path), _packer()
        w, end = table.library.width, np.array(end_id, dtype=table.dtype).tobytes()
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [x + end for x in table.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // w for x in raw], pa.int64()), pa.array([pack.compress(planes(x, w)) for x in raw], pa.binary())], names=["id", "n", "ids"])

    return rows.mapInArrow(tokenise, "id long, n long, ids binary")


def planes(raw: bytes, width: int) -> bytes:
    """Byte planes: all low bytes, then the next ones, which compresses faster and better."""
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, width).T.tobytes()


def unplanes(raw: bytes, n: int) -> np.ndarray:
    width = len(raw) // n
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(f"<u{width}").ravel()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> str:
    """Encodes every whole text and writes the files described above to path.

    A null text is the empty one: just the end id. Rows without an id come first; rows
    that share one follow each other, the shorter first, then in the order of a hash;
    they may be spread over several parts. Texts of any length are encoded whole, one
    without blanks too. An empty table writes files with no block. Columns besides the
    two are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ids = stored(encoded_ids(docs, tokenizer, id_col, text_col, end_id), "token-ids")

    def histogram(batches):
        release_table()
        counts = np.zeros(0, dtype=np.int64)
        _, unpack = _packer()
        for batch in batches:
            for part in slices(batch, "ids"):
                all_ids = np.concatenate([unplanes(unpack.decompress(x), n) for n, x in zip(*[c.to_pylist() for c in part.columns], strict=True)])
                got = np.bincount(all_ids, minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["symbol", "n"])

    counted = ids.select("n", "ids").mapInArrow(histogram, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # a row a symbol of the vocabulary at most
    if len(table):
        t = rans.Table.scaled(table["symbol"].to_numpy(), table["n"].to_numpy())
        rows = [(int(s), int(f)) for s, f in zip(t.symbols, t.freqs, strict=True)]
    else:
        rows = []
    spark.createDataFrame(rows, "symbol long, freq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(rows)

    total = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (PART_MB << 20)))
    # Rows that share an id are dealt by length and text too, and equal ones by their place in the table read.
    order = ["id", "n", "hash", "place"]
    keyed = ids.withColumns({"hash": F.xxhash64("ids"), "place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "n", "ids")

    def blocks(batches):
        release_table()
        part, (_, unpack) = TaskContext.get().partitionId(), _packer()
        t = rans.Table(*map(np.array, zip(*shared.value, strict=True))) if shared.value else None
        held_ids: list = []
        held: list = []
        size = before = number = 0

        def close():
            block = rans.encode(np.concatenate(held), t)
            row = [part, number, before, held_ids, [len(x) for x in held], block.n, block.lanes, block.every, block.words, block.places, block.states, block.crcs]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)

        for batch in batches:
            for some in slices(batch, "ids"):
                for i, n, x in zip(*[c.to_pylist() for c in some.columns], strict=True):
                    held_ids.append(i)
                    held.append(unplanes(unpack.decompress(x), n))
                    size += len(held[-1])
                    if size >= block_tokens:
                        yield close()
                        before, number, size, held_ids, held = before + size, number + 1, 0, [], []
        if held:
            yield close()

    ordered.mapInArrow(blocks, BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64())]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n")).collect())  # a row a part
    bases = dict(zip([p for p, _ in totals], itertools.accumulate([n for _, n in totals], initial=0), strict=False))
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in spark.read.parquet(f"{path}/table").orderBy("symbol").collect()])

    def decode(batches):
        release_table()
        t = rans.Table(*map(np.array, zip(*shared.value, strict=True))) if shared.value else None
        for batch in batches:
            for row in batch.to_pylist():
                block = rans.Block(row["n"], row["lanes"], row["every"], row["words"], row["places"], row["states"], row["crcs"])
                ids = rans.decode(block, t).astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(row["ids"], pa.int64()), pa.array(starts + (bases[row["part"]] + row["before"]), pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """part, block, segment, first (its first token's place in the block) and ids, each decoded from its own checkpoint.

    Rows carry the words of their segment alone, so that a long block is decoded by many tasks.
    """
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in spark.read.parquet(f"{path}/table").orderBy("symbol").collect()])
    end = F.coalesce(F.get("places", F.col("segment") + 1), F.octet_length("words") / 4)
    one = blocks.select("part", "block", "n", "lanes", "every", "words", "places", "states", "crcs", F.posexplode("places").alias("segment", "place"))
    one = one.select(
        "part", "block", "segment", F.substring("words", (4 * F.col("place") + 1).cast("int"), (4 * (end - F.col("place"))).cast("int")).alias("words"),
        (F.col("segment").cast("long") * F.col("every") * F.col("lanes")).alias("first"), "n", "lanes", "every", F.get("states", "segment").alias("state"), F.get("crcs", "segment").alias("crc"),
    )
    dealt = one.repartition("part", "block", "segment")

    def decode(batches):
        release_table()
        t = rans.Table(*map(np.array, zip(*shared.value, strict=True))) if shared.value else None
        for batch in batches:
            for row in batch.to_pylist():
                size = min(row["n"] - row["first"], row["every"] * row["lanes"])
                ids = rans.decode_segment(rans.Block(size, row["lanes"], row["every"], row["words"], [0], [row["state"]], [row["crc"]]), 0, t)
                out = [pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()), pa.array([row["segment"]], pa.int32()), pa.array([row["first"]], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(out, names=["part", "block", "segment", "first", "ids"])

    return dealt.mapInArrow(decode, "part int, block int, segment int, first long, ids array<int>")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_token_files(docs, new_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, with_ids=False)
