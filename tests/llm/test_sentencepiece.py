from __future__ import annotations

import base64
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quillspark.llm.sentencepiece_fst import Coder, compile_model, encode_texts, op9_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return Coder(compile_model(PATH), entries=500)


def test_ids_are_the_librarys(coder, library):
    rng = random.Random(7)
    parts = [" ", "  ", "    ", "\n", "\n\n", "\t", "a", "The", "the", "ing", "'s", "1", "é", "\xa0", "　", ".", "!?", "▁", "<s>", "<0x0A>", "世界", "𝒳", "x\n", "\r\n", "zzq", "tion"]
    texts = ["", " ", "\n", "x" * 3_000, "antidisestablishmentarianism " * 40]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3_000)]
    for k in range(0, len(texts), 100):
        some = texts[k : k + 100]
        for text, mine, ids in zip(some, coder.encode(some), library.encode(some), strict=True):
            assert np.frombuffer(mine, "<u2").tolist() == ids, text
            assert coder.decode(mine) == text.replace("▁", " ")


def test_query(spark, sf, library):
    rows = op9_sentencepiece(spark, sf).collect()
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_odd_rows(spark, library):
    texts = [None, "", " ", "a", "a", "long " * 20_000, "q" * 5_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' AS ids", "1 AS r", "2 AS n0")
    rows = {r.doc_id: r for r in encode_texts(df, PATH).collect()}
    assert [list(rows[i].ids) for i in range(len(texts))] == [library.encode(t or "") for t in texts]
    assert all(r.round_trip and r.r == 1 and r.n0 == 2 for r in rows.values())
    assert encode_texts(df.limit(0), PATH).count() == 0


def test_unigram_paths_are_shortest(tmp_path):
    """Any small unigram model against all segmentations."""
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -1.5, 1), ("b", -1.7, 1), ("ab", -2.9, 1), ("▁a", -3.0, 1), ("ba", -3.37, 1), ("aba", -4.13, 1), ("▁ab", -4.6, 1)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]

    def part(number, raw):
        n, out = len(raw), b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return bytes([number << 3 | 2]) + out + bytes([n]) + raw

    raw = b"".join(part(1, part(1, t.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for t, s, k in pieces)
    raw += part(2, b"\x18\x01" + b"\x98\x02\x01") + part(3, b"\x18\x01\x20\x00")
    path = tmp_path / "small.model"
    path.write_bytes(raw)
    coder, library = Coder(compile_model(str(path))), sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(1)
    texts = ["".join(rng.choice("aabb c\n") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    for text, mine in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(mine, "<u2").tolist() == library.encode(text), text


def test_long_texts_without_blanks():
    """A megabyte without blanks takes seconds, also one character that repeats, and has the library's ids."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coder, library = Coder(compile_model(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    texts = [base64.b64encode(rng.randbytes(750_000)).decode(), "".join(rng.choice("0123456789abcdef") for _ in range(60_000)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(60_000))]
    texts += [ch * 100_001 + "b" + ch * 600 for ch in "a=- é\n"] + ["abab" * 5_000, "".join(rng.choice("etaoin") for _ in range(60_000)), "the" * 700 + "\U0001f9ff" * 700]
    began = time.time()
    got = coder.encode(texts)
    assert time.time() - began < 60
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == library.encode(text) and coder.decode(ids) == text
