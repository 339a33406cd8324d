"""From raw documents to token ids: five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept; all but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.near_dup import drop_near_duplicates
from quillspark.llm.quality import judge
from quillspark.llm.sentencepiece_fst import encode_texts
from quillspark.llm.shared import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return judge(docs).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds; n_chars follows the text."""
    kept = dedup_lines(docs).withColumns({"text": F.col("_kept_text"), "n_chars": F.char_length("_kept_text").cast("long")})
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of benchmark items."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*docs.columns)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, their CRC-32 and whether they decode to the text."""
    return encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids", "ids_crc32", "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_ids),
]

#: SQL can't express the classifier's fit nor the encoding; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
