from __future__ import annotations

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm import piece_table, rans
from quillspark.llm.shared import new_path
from quillspark.llm.token_counts import count_tokens, op6_token_counts
from quillspark.llm.token_files import op1_token_files, read_segments, read_token_files, write_token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "  ", "a  b", "a\n\nb", " a", "a ", "a\n", "a\t b", "a  b", "it's 12 <|endoftext|> x", "é ü᠎ b", "x\r\ny", "世界 世界", "The end.\nThe end.", "word " * 5000]


def library(texts):
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("slot_bits", [8, 16])
def test_piece_table_gives_the_librarys_ids(slot_bits, monkeypatch):
    rng = np.random.default_rng(6)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "'s", "1", "é", "\xa0", "　", ".", ",", "!?", "’", "᠎", "<|endoftext|>", "世", "\x1c", "\x85", "\r\n", "Â", "word, ", "end. "]
    texts = [*ODD, None, *["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(4000)]]
    monkeypatch.setattr(piece_table, "CHUNK", 64)
    table, lengths = piece_table.PieceTable(PATH, slot_bits), piece_table.LengthTable(PATH, slot_bits)
    for k in range(0, len(texts), 50):
        column = pa.array(["x", *texts[k : k + 50]]).slice(1)
        for text, mine, ids in zip(texts[k : k + 50], table.encode(column), library(texts[k : k + 50]), strict=True):
            assert np.frombuffer(mine, "<u2").tolist() == ids, text
        assert lengths.lengths(column).tolist() == [0, *map(len, library(texts[k : k + 50]))][1:]


def long_runs():
    """Texts with a run without blanks of 40,000, 65,000 and 100,000 tokens and more."""
    rng = np.random.default_rng(3)
    runs = [base64.b64encode(rng.bytes(n)).decode() for n in (39_000, 105_000)]
    return [f"before {r} after {r[:3_000]} {r[:9_000]}, end" for r in [*runs, "".join(map(chr, rng.integers(0x4E00, 0x9FA5, 24_000)))]]


def test_piece_table_long_runs_without_blanks():
    texts = long_runs()
    expected = library(texts)
    assert sorted(len(ids) > 40_000 for ids in expected) == [True] * 3 and max(map(len, expected)) > 100_000
    table = piece_table.PieceTable(PATH, 12)
    for _ in range(2):  # the second time with what is kept
        for mine, ids in zip(table.encode(pa.array(texts)), expected, strict=True):
            assert np.frombuffer(mine, "<u2").tolist() == ids
    lengths = piece_table.LengthTable(PATH, 12)
    assert lengths.lengths(pa.array(texts)).tolist() == [len(x) for x in expected]
    pieces = [b" " + w.encode() for w in texts[0].split()]
    seeded = piece_table.LengthTable(PATH, 12, lengths.entries(pieces))
    assert seeded.filled == 4 and seeded.lengths(pa.array(texts)).tolist() == [len(x) for x in expected]  # the two longest are not kept


def test_long_runs_in_token_files_and_counts(spark):
    texts = list(enumerate(long_runs()))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    check_digest(read_token_files(spark, write_token_files(df, new_path(spark, "t"), PATH)).orderBy("doc_id").collect(), texts)
    assert [r.n_tokens for r in count_tokens(df, PATH).orderBy("doc_id").collect()] == [len(x) for x in library([t for _, t in texts])]


@pytest.mark.parametrize("slot_bits", [6, 10, 12])
def test_piece_table_with_more_pieces_than_slots(slot_bits):
    n = 1 << slot_bits
    start = " ".join(map(str, range(n * 69 // 100)))  # just under the limit
    texts = [start, " ".join(map(str, range(10_000, 10_000 + 3 * n))), " ".join(map(str, range(20_000, 20_000 + n))), start, "1 2 3 ab"]
    expected = library(texts)
    pieces = [f" {i}".encode() for i in range(30_000, 30_000 + 2 * n)]
    entries = piece_table.LengthTable(PATH, 16).entries(pieces)
    table, short, seeded = piece_table.PieceTable(PATH, slot_bits), piece_table.LengthTable(PATH, slot_bits), piece_table.LengthTable(PATH, slot_bits, entries)
    for columns in ([[t] for t in texts], [texts], [texts[1:], texts]):
        for column in columns:
            for mine, text in zip(table.encode(pa.array(column)), column, strict=True):
                assert np.frombuffer(mine, "<u2").tolist() == expected[texts.index(text)]
            for own in (short, seeded):
                assert own.lengths(pa.array(column)).tolist() == [len(expected[texts.index(t)]) for t in column]
            assert max(table.filled, short.filled, seeded.filled) < n


def test_piece_table_starts_afresh_with_a_full_pool(monkeypatch):
    monkeypatch.setattr(piece_table, "POOL_IDS", 100)
    table = piece_table.PieceTable(PATH, 16)
    for k in range(5):
        text = " ".join(map(str, range(k * 1_000, k * 1_000 + 400)))
        assert np.frombuffer(table.encode(pa.array([text]))[0], "<u2").tolist() == library([text])[0]
        assert table.filled <= 400


def test_rans_round_trip_and_checksums():
    ids = (np.random.default_rng(1).zipf(1.3, 40_000) % 5_000).astype(np.uint32)
    table = rans.Table.scaled(*np.unique(ids, return_counts=True))
    for n in (1, 63, 64, 65, 1_000, 40_000):
        block = rans.encode(ids[:n], table, segment=1 << 11)
        assert (rans.decode(block, table) == ids[:n]).all()
        last = len(block.places) - 1  # a segment alone
        assert (rans.decode_segment(block, last, table) == ids[:n][last * block.every * block.lanes :]).all()
    block.words = block.words[:8] + bytes(4) + block.words[12:]
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(block, table)


def check_digest(rows, texts):
    start = 0
    for (doc, text), row in zip(texts, rows, strict=True):
        ids = np.array([*library([text])[0], 0], "<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_against_brute_force(spark, sf):
    texts = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    check_digest(op1_token_files(spark, sf).orderBy("doc_id").collect(), texts)


def test_token_files_odd_rows(spark):
    texts = list(enumerate(ODD))
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS ids", "3 AS part").repartition(3)
    path = write_token_files(df, new_path(spark, "t"), PATH, block_tokens=100)
    rows = read_token_files(spark, path).orderBy("doc_id").collect()
    check_digest(rows, texts)
    assert rows[-1].ids[-1] == 0 and len(rows[-1].ids) == rows[-1].n_tokens
    twice = spark.createDataFrame([(1, "b b"), (None, "a"), (1, "b b"), (1, "a")], "doc_id long, text string")
    rows = sorted(read_token_files(spark, write_token_files(twice, new_path(spark, "t"), PATH)).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (1, 2, 2), (1, 4, 3), (1, 7, 3)]
    none = read_token_files(spark, write_token_files(twice.limit(0), new_path(spark, "t"), PATH))
    assert none.count() == 0


def test_token_counts(spark, sf):
    rows = op6_token_counts(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for row, ids in zip(rows, library([texts[r.doc_id] for r in rows]), strict=True):
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (len(ids), len((texts[row.doc_id] or "").encode()), len(ids) > 1024)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_odd_rows(spark, name):
    rng = np.random.default_rng(8)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "'s", "12", "é", "e\u0301", "\xa0", "\u3000", ".", "!?", "’", "▁", "<|endoftext|>", "<s>", "世", "Σ", "İ", "\x1c", "\x85", "\r\n", "word, ", "end. ", " \u0301x"]
    some = [*ODD, *["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(1_500)], "=" * 5_000, "世界" * 4_000]
    df = spark.createDataFrame([*enumerate(some), (None, "a b"), (1, "a")], "doc_id long, text string").selectExpr("*", "0 AS n_tokens", "0 AS _n")
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        expected = [len(model.encode(t or "")) for t in [*some, "a b", "a"]]
    else:
        tokenizer = Tokenizer.from_file(path)
        expected = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in [*some, "a b", "a"]]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in count_tokens(df, path).collect())
    assert got == sorted(zip([*range(len(some)), -1, 1], expected, strict=True))
    assert count_tokens(df.limit(0), path).count() == 0


def test_segments_decode_apart(spark):
    docs = spark.createDataFrame([(i, f"{i} some words " * 3_000) for i in range(6)], "doc_id long, text string").repartition(2)
    path = write_token_files(docs, new_path(spark, "t"), PATH, block_tokens=30_000)
    whole = {r.doc_id: r for r in read_token_files(spark, path).collect()}
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "block", "ids").collect()
    pieces: dict = {}
    for r in read_segments(spark, path).collect():
        pieces.setdefault((r.part, r.block), []).append((r.first, r.ids))
    for b in blocks:
        parts = sorted(pieces.pop((b.part, b.block)))
        got = [x for _, ids in parts for x in ids]
        assert got == [x for i in b.ids for x in whole[i].ids] and [f for f, _ in parts] == np.cumsum([0, *[len(x) for _, x in parts]])[:-1].tolist()
    assert not pieces


def test_one_id_on_most_rows_is_spread(spark):
    rows = spark.range(4_000).selectExpr("cast(if(id < 3000, null, id) AS long) AS doc_id", "if(id % 3 = 0, null, concat('w', id % 50)) AS text")
    path = write_token_files(rows, new_path(spark, "t"), PATH)
    parts = [r["count"] for r in spark.read.parquet(f"{path}/blocks").selectExpr("part", "explode(ids) AS id").groupBy("part").count().collect()]
    assert len(parts) > 2 and sum(parts) == 4_000 and max(parts) < 2_000
    got = read_token_files(spark, path, with_ids=False).orderBy("start").collect()
    assert len(got) == 4_000 and [r.doc_id for r in got] == [None] * 3_000 + list(range(3_000, 4_000))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
