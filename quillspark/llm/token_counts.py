"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

Tier one is a broadcast table of the lengths (in tokens) of frequent pre-tokens, of at
most ``frequent`` entries, drawn from a bounded sample of short rows; it only saves time.
Tier two is each worker's own table, of bounded size, which starts with tier one's
entries and keeps the lengths of what the library had to encode. Neither holds ids: a
text's count is the sum of its pre-tokens' lengths.

* Plain byte-level BPE (.json): pieces of piece_table.py, found by their hashes.
* Tokenizers whose splitter drops blanks (.json): words between ASCII blanks.
* sentencepiece (.model): segments at borders that no piece crosses, as op9 cuts them.

Other models are counted by the library, text by text.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_table import LengthTable, cut, doubtful, worker_table
from .pretokens import Library
from .sentencepiece_fst import Coder, compile_model
from .shared import ship, slices

#: Entries from which a worker's table of keys starts afresh, and characters above which a key is not kept.
ENTRIES, LONG = 400_000, 1 << 12


class WordLengths:
    """Words between ASCII blanks, for a tokenizer whose splitter drops blanks."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.library, self.frequent = Library(path), frequent or {}
        self.known = dict(self.frequent)

    def cut(self, text: str) -> list[str]:
        return [w.decode("utf-8") for w in text.encode("utf-8").split()]  # bytes: ASCII blanks alone

    def measure(self, keys: list[str]) -> list[int]:
        return self.library.counts(keys)

    def lengths(self, column: pa.StringArray) -> np.ndarray:
        """The number of tokens of each text (null: none)."""
        cuts = [self.cut(t or "") for t in column.to_pylist()]
        if len(self.known) > ENTRIES:
            self.known = dict(self.frequent)
        fresh = sorted(set().union(*cuts).difference(self.known)) if cuts else []
        new = dict(zip(fresh, self.measure(fresh), strict=True))
        self.known.update((k, n) for k, n in new.items() if len(k) <= LONG)
        new |= {k: self.known[k] for c in cuts for k in c if k in self.known}
        return np.array([sum(map(new.__getitem__, c)) for c in cuts], dtype=np.int64)


class SegmentLengths(WordLengths):
    """Segments of a sentencepiece model, measured by its library."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import sentencepiece

        self.library, self.frequent = sentencepiece.SentencePieceProcessor(model_file=path), frequent or {}
        self.known = dict(self.frequent)
        try:
            self.coder = Coder(compile_model(path))
        except ValueError:  # a normaliser that op9 does not compile: whole texts
            self.coder = None
        if self.coder and (self.coder.model.crosses or self.coder.model.has_newline or not self.coder.model.fallback):
            self.coder = None
        self.newline = len(self.library.encode("\n"))

    def cut(self, text: str) -> list[str]:
        return self.coder.cut(text) if self.coder else [text]

    def measure(self, keys: list[str]) -> list[int]:
        """What a key stands for is told in Coder.cut. Where no space leads, a newline does, whose tokens are taken off."""
        if not self.coder:
            return [len(x) for x in self.library.encode(keys, num_threads=1)]
        texts, less = [], []
        prefix = self.coder.model.prefix  # the library puts a space before a text
        for k in keys:
            literal = k if k[0] == "\n" else k[1:] if k[0] == " " else " " + k
            if prefix and literal == " ":  # an empty text would get no space
                texts.append("\n")
                less.append(self.newline - 1)
            elif prefix and literal[0] == "\n":
                texts.append(literal)
                less.append(self.newline - 1)
            elif prefix and literal[0] != " ":
                texts.append("\n" + literal)
                less.append(self.newline)
            else:
                texts.append(literal[1:] if prefix else literal)
                less.append(0)
        return [len(x) - n for x, n in zip(self.library.encode(texts, num_threads=1), less, strict=True)]


def lengths_of(path: str):
    """The class that counts with a tokenizer file."""
    if path.endswith(".model"):
        return SegmentLengths
    library = Library(path)
    return WordLengths if library.drops_blanks and not library.cuts else LengthTable


def frequent_lengths(docs: DataFrame, text_col: str, path: str, frequent: int = 65_536, sample_rows: int = 2_048, sample_bytes: int = 16_384):
    """The lengths of at most ``frequent`` pre-tokens of at most sample_rows texts of at most sample_bytes bytes each."""
    kind = lengths_of(path)
    table = kind(path, 12) if kind is LengthTable else kind(path)
    if kind is LengthTable and not table.library.cuts:
        return ()
    if kind is SegmentLengths and not table.coder:
        return {}
    short = docs.where(F.octet_length(f"`{text_col}`") <= sample_bytes).select(F.col(f"`{text_col}`").cast("binary"))
    share = min(1.0, 8 * sample_rows / max(1, docs.count()))
    counts: Counter = Counter()
    for (text,) in short.sample(share, seed=1).limit(sample_rows).collect():
        if kind is not LengthTable:
            counts.update(table.cut(bytes(text).decode("utf-8", "replace")))
            continue
        raw = np.frombuffer(bytes(text), np.uint8)
        if len(raw) and not len(doubtful(raw)):
            counts.update([bytes(text[a:b]) for a, b in zip(*[x.tolist() for x in cut(raw, np.array([0, len(raw)]))], strict=True)])
    common = [p for p, _ in counts.most_common(frequent)]
    return table.entries(common) if kind is LengthTable else dict(zip(common, table.measure(common), strict=True))


def count_tokens(docs: DataFrame, path: str, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", limit: int = 1024, frequent: int = 65_536) -> DataFrame:
    """id_cols, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    path: a tokenizers .json or a sentencepiece .model. Counts are the library's for the
    whole text, without begin, end or padding; an added token's string counts as the
    library takes it by default. A null text counts as the empty one. Texts of any length
    are counted whole, one without blanks too: a long pre-token is encoded each time and
    not kept. Rows that repeat each have their own row; nulls in id_cols stay; an empty
    table gives an empty table; other columns are ignored, whatever their names.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(id_cols)], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"), text.cast("string").alias("_text"))
    run = uuid.uuid4().hex
    ship(docs.sparkSession)
    kind = lengths_of(path)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, path, frequent))

    def lengths(batches):
        table = worker_table(kind, path, shared, run)
        for batch in batches:
            for part in slices(batch, "_text"):
                n = table.lengths(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64())], names=[*part.schema.names[:-1], "_n"])

    schema = ", ".join([f"_k{i} {rows.schema[f'_k{i}'].dataType.simpleString()}" for i in range(len(id_cols))] + ["_bytes long", "_n long"])
    counted = rows.mapInArrow(lengths, schema)
    return counted.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(id_cols)], F.col("_bytes").alias("n_bytes"), F.col("_n").alias("n_tokens"), (F.col("_n") > limit).alias("over_limit"))


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
