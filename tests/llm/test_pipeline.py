from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_near_dup import brute as brute_groups

pipeline = pytest.importorskip("corpus_pipeline")


def brute_lines(docs):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders: dict = {}
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    keep = lambda i, line: len(key(line)) < 10 or min(holders[key(line)]) == i
    return {i: "\n".join([x for x in (t or "").split("\n") if keep(i, x)]) for i, t in docs.items()}


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, outs = docs.columns, []
    for _, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, sf), "stage")
        outs.append(docs)
    assert all(o.columns == columns for o in outs[:-1])
    texts = [dict(o.select("doc_id", "text").collect()) for o in outs[:-1]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels[i] == 1 for i in texts[0] if i in labels) and all(i in texts[0] for i, q in labels.items() if q == 1)
    assert texts[1] == brute_lines(texts[0])
    groups = brute_groups(list(texts[1].items()))
    assert set(texts[2]) == {i for i, (_, c) in groups.items() if i == c}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(texts[3]) == {r[0] for r in brute_hits(list(texts[2].items()), items) if not r[4]}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = outs[4].collect()
    assert {r.doc_id for r in rows} == set(texts[3])
    for r in rows:
        ids = np.array(model.encode(texts[3][r.doc_id]), "<u4")
        assert r.ids == ids.tolist() and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.round_trip


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0


def test_empty_and_extra(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0).selectExpr("*", "1 AS kept", "2 AS n_words", "3 AS _lines")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0 and "n_words" in docs.columns
