from __future__ import annotations

import inspect
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm.quality import BAD, LABELLERS, Looks, estimate, fit, judge, op7_quality


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_accuracy_on_held_out_labels(spark, sf_dir):
    """No label is used to fit, so all of them are held out."""
    judged = op7_quality(spark, sf_dir)
    rows = judged.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    assert sum((r.quality == 1) == r.kept for r in rows) / len(rows) >= 0.98
    assert judged.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_estimate_recovers_accuracies():
    rng = np.random.default_rng(3)
    m, n = len(LABELLERS), 20_000
    truth = rng.random(n) < 0.2
    right = rng.random((n, m)) < 0.85
    votes = np.where(right == truth[:, None], BAD, 1)
    codes = votes @ (3 ** np.arange(m - 1, -1, -1))
    patterns, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
    bad, table, share = estimate(patterns, counts.astype(float))
    assert abs(share - 0.2) < 0.02 and np.abs(table[1, :, BAD] - 0.85).max() < 0.03
    assert ((bad[inverse] > 0.5) == truth).mean() > 0.97


def test_odd_rows(spark):
    words = "The fox and the dog went over to the old river and saw that it was deep".split()
    texts = [None, "", " ", "\n\n", "a", "x" * 300_000, " ".join(words), " ".join(words) + ".", " ".join(w.upper() + "!!" for w in words), " | ".join(words), "same " * 50, "same " * 50]
    texts += [" ".join(words[i:] + words[:i]) for i in range(15)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'z' AS kept", "1 AS r", "2 AS pattern")
    rows = {r.doc_id: r for r in judge(df).collect()}
    assert len(rows) == len(texts) and rows[6].kept and not rows[8].kept and not rows[10].kept and rows[10].bad == rows[11].bad
    assert all(rows[i].kept for i in (0, 1, 2, 3)) and rows[0].pattern == 2
    assert judge(df.limit(0)).count() == 0
    assert Looks(None).votes() == [0] * len(LABELLERS)


def plain_rates(t: bytes) -> list[float]:
    words, spaced = t.split(), [w for w in re.split(rb"[\x00-\x20]+", t) if w]
    n, letter = max(1, len(words)), rb"[0-9A-Za-z\x80-\xff]"
    marks = rb"[^0-9A-Za-z\x80-\xff]"
    letters = re.findall(letter, t)
    lettered = [w for w in spaced if re.search(letter, w)]
    pairs = list(zip(words, words[1:], strict=False))
    lines = t.split(b"\n")
    return [
        len(re.findall(rb"[%&*$#|!<>{}\[\]=~^\\_@+`]", t)) / max(1, len(t)),
        (len(words) - len(lettered)) / n,
        sum(len(w) > 2 and re.search(marks + marks + rb"\Z", w) is not None for w in spaced) / n,
        1 - len(letters) / max(1, len(re.findall(rb"[^\x00-\x20]", t))),
        sum(len(re.findall(rb"[A-Z]", w)) > 1 and not re.search(rb"[a-z\x80-\xff]", w) for w in spaced) / n,
        len(re.findall(rb"[A-Z]", t)) / max(1, len(letters)),
        sum(a == b for a, b in pairs) / n,
        1 - sum(len(set(words[i : i + 200])) for i in range(0, len(words), 200)) / n,
        1 - len(set(pairs)) / max(1, len(words) - 1),
        1 - len(set(lines)) / len(lines),
    ]


def plain_features(t: bytes, buckets: int) -> dict[int, float]:
    words = t.split()
    t = re.sub(rb"[\x00-\x20]+", b" ", t)
    for pattern, mark in ((rb"[A-Z]+", b"\x01"), (rb"[a-z\x80-\xff]+", b"\x02"), (rb"[0-9]+", b"\x03")):
        t = re.sub(pattern, mark, t)
    t = re.sub(rb"([^\x01-\x03])\1+", rb"\1", t).replace(b"\x01", b"U").replace(b"\x02", b"l").replace(b"\x03", b"d")
    shapes = t.split()
    found: dict[int, float] = {}
    keys = [x[:16] for x in shapes] + [a[:8] + b" " + b[:8] for a, b in zip(shapes, shapes[1:], strict=False)] + [b"= ="] * sum(a == b for a, b in zip(words, words[1:], strict=False))
    for k in keys:
        found[zlib.crc32(k) % buckets] = found.get(zlib.crc32(k) % buckets, 0) + 1
    return {k: math.sqrt(c / max(1, len(words))) for k, c in found.items()}


def plain_judge(texts, buckets, rounds, rate, decay):
    """Votes, EM document by document, and the scorer, in plain Python; gives the posterior and the score of each text."""
    texts = [t or b"" for t in texts]
    votes = [[0 if len(t.split()) < least else 2 if r > bad else 1 if r < good else 0 for r, (_, least, good, bad) in zip(plain_rates(t), LABELLERS, strict=True)] for t in texts]
    post = [(0.05, 0.5, 0.95)[min(2, v.count(2))] for v in votes]
    for _ in range(200):
        table = []
        for weight in ([1 - x for x in post], post):
            rows = [[sum(w for v, w in zip(votes, weight, strict=True) if v[j] == k) / len(texts) + 1e-6 for k in range(3)] for j in range(len(LABELLERS))]
            table.append([[x / sum(r) for x in r] for r in rows])
        share = min(1 - 1e-6, max(1e-6, sum(post) / len(post)))
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(table[1][j][k] / table[0][j][k]) for j, k in enumerate(v) if k)
            new.append(1 / (1 + math.exp(-min(50, max(-50, odds)))))
        moved, post = max(abs(a - b) for a, b in zip(post, new, strict=True)), new
        if moved < 1e-9:
            break
    features = [plain_features(t, buckets) for t in texts]
    once = {t: (f, p) for t, f, p in zip(texts, features, post, strict=True)}
    rows = list(once.values())
    mean = sum(p for _, p in rows) / len(rows)
    w: dict[int, float] = dict.fromkeys({k for f, _ in rows for k in f}, 0.0)
    m1, m2, bias, b1, b2 = dict(w), dict(w), 0.0, 0.0, 0.0
    for t in range(1, rounds + 1):
        grad, gb = {k: decay * x for k, x in w.items()}, 0.0
        for f, y in rows:
            z = bias + sum(w[k] * x for k, x in f.items())
            g = (1 / (1 + math.exp(-min(50, max(-50, z)))) - y) * (0.5 / max(1e-3, mean) if y > 0.5 else 0.5 / max(1e-3, 1 - mean)) / len(rows)
            gb += g
            for k, x in f.items():
                grad[k] += g * x
        for k, g in grad.items():
            m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
            w[k] -= rate * (m1[k] / (1 - 0.9**t)) / (math.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        bias -= rate * (b1 / (1 - 0.9**t)) / (math.sqrt(b2 / (1 - 0.999**t)) + 1e-8)
    score = [1 / (1 + math.exp(-min(50, max(-50, bias + sum(w[k] * x for k, x in f.items()))))) for f in features]
    return post, score


def test_query_equals_brute_force(spark, sf):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    raw = [None if t is None else t.encode() for t in texts.values()]
    for t in raw:
        assert plain_rates(t or b"") == pytest.approx(Looks(t).rates, abs=1e-12)
        assert plain_features(t or b"", 1 << 14) == pytest.approx(Looks(t).features(1 << 14), abs=1e-12)
    options = {k: p.default for k, p in inspect.signature(fit).parameters.items() if k in ("rounds", "rate", "decay")}
    post, score = plain_judge(raw, 1 << 14, **options)
    got = {r.doc_id: r for r in op7_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for i, p, b in zip(texts, post, score, strict=True):
        assert abs(got[i].weak_bad - p) < 1e-4 and abs(got[i].bad - b) < 1e-3 and got[i].kept == (got[i].bad < 0.5)


def test_a_frequent_text_is_drawn_once(spark):
    good = " ".join("the quiet river ran by the old stone house and the garden".split() * 2)
    rows = [f"{good} {i} and then the {i + 1} was seen by some of them" for i in range(60)] + [f"{'|#$ %& ' * 12}{i} !! ??" for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    often = spark.range(3_000).select((F.col("id") + 1_000).alias("doc_id"), F.lit(rows[0]).alias("text"))
    alone, both = ({r.doc_id: r.kept for r in judge(x, train_rows=50).where("doc_id < 1000").collect()} for x in (df, df.unionAll(often)))
    assert alone == both and sum(both.values()) == 60
