from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import topk_search
from quillspark.llm.topk_search import top_k


def brute(rows, k):
    fine = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % 5 == 0}):
        v = next(v for i, v in fine if i == q)
        clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
        scores = [(-clip(sum(a * b for a, b in zip(v, w, strict=False))), i) for i, w in fine if i != q]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("coordinate_from", [0.0, 0.8, 2.0])
@pytest.mark.parametrize(("spread", "group_bytes"), [(0.0, 16 << 20), (1.0, 1_000)])
def test_against_brute_force(spark, monkeypatch, coordinate_from, spread, group_bytes):
    monkeypatch.setattr(topk_search, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    rows = []
    for i in range(300):
        v = centres[i % 8] + 0.2 * rng.normal(size=12)
        v = v / np.linalg.norm(v) * np.exp(spread * rng.normal())
        rows.append((i, [float(np.float32(x)) for x in v]))
    rows += [(400 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(505, None), (510, [1.0, None]), (515, [float("nan")] * 12), (520, [float("inf")] * 12), (525, []), (530, [0.0] * 12), (None, rows[0][1]), (535, [0.5, 0.25]), (401, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS score")
    got = top_k(df, F.col("vec_id") % 5 == 0, k=7, coordinate_from=coordinate_from, bucket=32, block=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7)


def test_small_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    assert top_k(spark.createDataFrame([], schema), F.col("vec_id") % 5 == 0).count() == 0
    assert top_k(spark.createDataFrame([(5, [1.0])], schema), F.col("vec_id") % 5 == 0).count() == 0
    assert top_k(spark.createDataFrame([(6, [1.0]), (7, [2.0])], schema), F.col("vec_id") % 5 == 0).count() == 0
    rows = [(5, [1e30, 1.0]), (6, [1e30, 2.0]), (7, [-1e30, 3.0]), (8, [1e9, 1e9]), (10, [1.0, 3e8])]
    got = top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 5 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3)
