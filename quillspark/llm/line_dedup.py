"""Line dedup, native: repeated lines stay only in the smallest document that holds them.

Lines are exploded and normalised, and reduced to a 128-bit hash. One aggregation
with map-side combine finds the hashes held by ``min_docs`` documents or more and the
smallest of these; that table is written out, so that the join that follows deals both
of its sides and adaptive execution can split a hot line. Only line positions come back
to the documents; texts move once, for the join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. All-ASCII values take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Adds _n_lines, _n_dropped and _kept_text to every row of docs.

    A line is dropped if its key has min_chars code points or more, at least min_docs
    different ids hold the key, and the row's id is not the smallest of them. Null and
    empty texts are one empty line, which is never dropped. Rows that repeat an id count
    as one document; each keeps its own lines. Rows without an id neither cause nor
    suffer a drop. An empty table gives an empty table; other columns pass through.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    lines = (
        docs.select(doc.alias("_d"), F.xxhash64(text).alias("_t"), F.posexplode(lines_of(text)).alias("_pos", "_line"))
        .where(F.col("_d").isNotNull() & (F.char_length("_line") >= min_chars))
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= min_chars)
        .select("_d", "_t", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    if min_docs <= 2:
        held = lines.groupBy("_h1", "_h2").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
        held = held.where(F.col("_first") < F.col("_last"))
    else:
        held = lines.groupBy("_h1", "_h2", "_d").agg(F.count(F.lit(1)))
        held = held.groupBy("_h1", "_h2").agg(F.min("_d").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs)
    held = stored(held.select("_h1", "_h2", "_first"), "repeated-lines")
    drops = (
        lines.join(held, ["_h1", "_h2"])
        .where(F.col("_d") > F.col("_first"))
        .groupBy("_d", "_t")
        .agg(F.collect_list("_pos").alias("_drops"))
        .withColumnRenamed("_d", "_dd")
        .withColumnRenamed("_t", "_dt")
    )
    new = ("_n_lines", "_n_dropped", "_kept_text")
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = docs.select(row.alias("_row"), doc.alias("_id"), F.xxhash64(text).alias("_t"), lines_of(text).alias("_lines"))
    out = out.join(drops, (F.col("_id") == F.col("_dd")) & (F.col("_t") == F.col("_dt")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce("_drops", F.array().cast("array<int>")))
    kept_lines = F.when(F.col("_drops").isNull(), F.col("_lines")).otherwise(F.transform(kept, lambda i: F.get("_lines", i)))
    out = out.select("_row", F.size("_lines").cast("long").alias("_n"), F.coalesce(F.size(F.array_distinct("_drops")), F.lit(0)).cast("long").alias("_gone"), F.array_join(kept_lines, "\n").alias("_text"))
    old = [F.col("_row").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new]
    return out.select(*old, F.col("_n").alias("_n_lines"), F.col("_gone").alias("_n_dropped"), F.col("_text").alias("_kept_text"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), d AS (
  SELECT k.doc_id, k.pos, k.line, r.first IS NOT NULL AND r.first < k.doc_id AS dropped FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
