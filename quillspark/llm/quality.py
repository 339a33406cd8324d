"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Expectation
maximisation over the counts of vote patterns (all documents; at most 3**labellers
patterns) estimates how often each labeller votes what for good and for bad documents,
and gives each pattern a posterior. Those posteriors are the soft labels of a linear
scorer over hashed shapes of words and of pairs of words, fit on a bounded sample of
different texts (``train_rows``); the scorer judges every document on its whole text.

Texts are read three times (patterns; the sample's draw; scores) and never shuffled or
written: features of all documents would be as large as the documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import raw_texts, with_arrow_columns

ABSTAIN, GOOD, BAD = 0, 1, 2
#: name, least words to vote, good if below, bad if above. Every kind of fault shows in several of them.
LABELLERS = [
    ("symbols", 5, 0.006, 0.03),  # odd symbols by character
    ("letterless", 10, 0.03, 0.15),  # words without a letter or digit by word
    ("marked", 10, 0.05, 0.2),  # words that end in two marks or more by word
    ("non_letters", 10, 0.15, 0.25),  # characters that are no letters, digits or blanks by non-blank
    ("capital_words", 10, 0.15, 0.4),  # words of capitals by word
    ("capitals", 10, 0.12, 0.4),  # capitals by letter or digit
    ("echoes", 10, 0.03, 0.2),  # words equal to the one before by word
    ("sameness", 20, 0.4, 0.6),  # 1 less distinct words by word, in runs of 200 words
    ("same_pairs", 20, 0.2, 0.5),  # 1 less distinct pairs of words by pair
    ("copied_lines", 20, 0.4, 0.8),  # lines that repeat one by line
]
_ODD = b"%&*$#|!<>{}[]=~^\\_@+`"


def _shape(b: int) -> int:
    """A byte's class: U, l, d, itself, or a blank."""
    if 65 <= b <= 90:
        return ord("U")
    if 97 <= b <= 122 or b >= 128:
        return ord("l")
    if 48 <= b <= 57:
        return ord("d")
    return 32 if b <= 32 else b


_SHAPES = np.array([_shape(b) for b in range(256)], dtype=np.uint8)
_ISODD = np.zeros(256, dtype=np.int64)
_ISODD[list(_ODD)] = 1
_ISLETTER = np.isin(_SHAPES, list(b"Uld")).astype(np.int64)


class Looks:
    """What the labellers and the scorer see of a text."""

    def __init__(self, text: bytes | None):
        text = text or b""
        self.words = words = text.split()
        self.n = n = len(words)
        raw = np.frombuffer(text, np.uint8)
        shapes = _SHAPES[raw]
        new = np.ones(len(raw), dtype=bool)
        new[1:] = shapes[1:] != shapes[:-1]
        self.shapes = shapes[new].tobytes().split()  # runs of a class are one
        long = shapes.tobytes().split()
        self.echoes = sum(map(eq, words, words[1:]))
        kinds = Counter(long)
        letters = capitals = marked = 0
        for k, c in kinds.items():
            if b"l" in k or b"U" in k or b"d" in k:
                letters += c
                if b"l" not in k and k.count(b"U") > 1:
                    capitals += c
            if len(k) > 2 and k[-1] not in b"Uld" and k[-2] not in b"Uld":
                marked += c
        lines = text.split(b"\n")
        d = max(1, n)
        by_byte = np.bincount(raw, minlength=256)
        upper, letter, blank = int(by_byte[65:91].sum()), int(by_byte @ _ISLETTER), int(by_byte[:33].sum())
        self.rates = [
            int(by_byte @ _ISODD) / max(1, len(raw)),
            (n - letters) / d,
            marked / d,
            1 - letter / max(1, len(raw) - blank),
            capitals / d,
            upper / max(1, letter),
            self.echoes / d,
            1 - sum(len(set(words[i : i + 200])) for i in range(0, n, 200)) / d,
            1 - len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
            1 - len(set(lines)) / len(lines),
        ]

    def votes(self) -> list[int]:
        return [ABSTAIN if self.n < least else BAD if x > bad else GOOD if x < good else ABSTAIN for x, (_, least, good, bad) in zip(self.rates, LABELLERS, strict=True)]

    def pattern(self) -> int:
        code = 0
        for v in self.votes():
            code = 3 * code + v
        return code

    def features(self, buckets: int) -> dict[int, float]:
        d = max(1, self.n)
        counts: Counter = Counter()
        for k, c in Counter(self.shapes).items():
            counts[_bucket(k[:16], buckets)] += c
        for (a, b), c in Counter(zip(self.shapes, self.shapes[1:], strict=False)).items():
            counts[_bucket(a[:8] + b" " + b[:8], buckets)] += c
        counts[_bucket(b"= =", buckets)] += self.echoes
        return {k: (c / d) ** 0.5 for k, c in counts.items() if c}


_BUCKETS: dict[tuple[bytes, int], int] = {}


def _bucket(key: bytes, buckets: int) -> int:
    got = _BUCKETS.get((key, buckets))
    if got is None:
        if len(_BUCKETS) > 200_000:
            _BUCKETS.clear()
        got = _BUCKETS[key, buckets] = zlib.crc32(key) % buckets
    return got


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of 'bad' by pattern, P(vote | class) by labeller, and the share of bad ones.

    It starts from 'bad' where two labellers say so, as each sees some kinds of fault only.
    """
    m = len(LABELLERS)
    votes = np.array([[p // 3 ** (m - 1 - j) % 3 for j in range(m)] for p in patterns.tolist()], dtype=np.int64).reshape(-1, m)
    weight = counts / max(1, counts.sum())
    bad = np.array([0.05, 0.5, 0.95])[np.minimum(2, (votes == BAD).sum(axis=1))]
    table, share = np.full((2, m, 3), 1 / 3), 0.1
    for _ in range(rounds):
        for c, post in ((0, 1 - bad), (1, bad)):
            mass = weight * post
            for v in range(3):
                table[c, :, v] = ((votes == v) * mass[:, None]).sum(axis=0)
            table[c] = (table[c] + 1e-6) / (table[c] + 1e-6).sum(axis=1, keepdims=True)
        share = float(np.clip((weight * bad).sum(), 1e-6, 1 - 1e-6))
        odds = np.log(share / (1 - share)) * np.ones(len(votes))
        for j in range(m):
            seen = votes[:, j] != ABSTAIN
            odds[seen] += (np.log(table[1, j, votes[:, j]]) - np.log(table[0, j, votes[:, j]]))[seen]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - bad).max(initial=0) < 1e-9:
            break
        bad = new
    return bad, table, share


def fit(rows: list[tuple[list[int], list[float], float]], buckets: int, rounds: int = 300, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, by Adam over all rows at once."""
    w, bias = np.zeros(buckets), 0.0
    if not rows:
        return w, bias
    at = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows])
    x = np.concatenate([np.asarray(r[1]) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    balance = np.where(y > 0.5, 0.5 / max(1e-3, y.mean()), 0.5 / max(1e-3, 1 - y.mean()))
    m1, m2 = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], minlength=len(y)) + bias, -50, 50)))
        g = (p - y) * balance / len(y)
        grad = np.append(np.bincount(at, x * g[row], minlength=buckets) + decay * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def judge(docs: DataFrame, text_col: str = "text", buckets: int = 1 << 14, train_rows: int = 8_000, threshold: float = 0.5) -> DataFrame:
    """docs with weak_bad (the label model's posterior), bad (the scorer's) and kept (bad < threshold).

    Null, empty and very short texts get no votes and few shapes: they stand at the prior
    and are kept. Repeated rows are judged alike. Texts of any length are looked at whole.
    An empty table gives an empty table. Columns of docs that have one of the new names
    are replaced, others pass through. The scorer is fit on train_rows different texts at
    most, drawn by their hashes (all, if fewer): a text counts once, however many rows
    hold it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))

    def start_patterns():
        return lambda rows: (pa.array([Looks(t).pattern() for t in raw_texts(rows, "text")], pa.int32()),)

    seen = with_arrow_columns(texts, "pattern int", start_patterns, size_column="text").groupBy("pattern").count().collect()  # at most 3**labellers rows
    patterns, counts = np.array([r["pattern"] for r in seen], dtype=np.int64), np.array([r["count"] for r in seen], dtype=np.float64)
    posterior = dict(zip(patterns.tolist(), estimate(patterns, counts)[0].tolist(), strict=True))

    def start_features():
        def work(rows):
            looks = [Looks(t) for t in raw_texts(rows, "text")]
            f = [x.features(buckets) for x in looks]
            return pa.array([x.pattern() for x in looks], pa.int32()), pa.array([list(x) for x in f], pa.list_(pa.int32())), pa.array([list(x.values()) for x in f], pa.list_(pa.float64()))

        return work

    # Over-drawn twofold, made distinct (with a map-side combine), then cut to the bound in the order of the hash.
    texts_there = texts.agg(F.approx_count_distinct(F.xxhash64("text"), 0.01)).first()[0]
    slots = max(1, int(texts_there // (2 * train_rows)))
    drawn = texts.where(F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(slots)) == 0).groupBy(F.xxhash64(F.lit(13), "text").alias("h"), F.xxhash64(F.lit(17), "text").alias("h2")).agg(F.first("text").alias("text"))
    drawn = drawn.orderBy("h", "h2").limit(train_rows)
    sample = with_arrow_columns(drawn, "pattern int, at array<int>, x array<double>", start_features, size_column="text").select("pattern", "at", "x").collect()
    rows = sorted((list(r["at"]), list(r["x"]), posterior.get(r["pattern"], 0.5)) for r in sample)
    shared = spark.sparkContext.broadcast((posterior, *fit(rows, buckets)))

    def start_scores():
        post, w, bias = shared.value

        def work(rows):
            looks = [Looks(t) for t in raw_texts(rows, text_col)]
            weak = [post.get(x.pattern(), 0.5) for x in looks]
            f = [x.features(buckets) for x in looks]
            row = np.repeat(np.arange(len(f)), [len(x) for x in f])
            at, x = np.fromiter((k for d in f for k in d), np.int64), np.fromiter((v for d in f for v in d.values()), np.float64)
            z = bias + np.bincount(row, w[at] * x, minlength=len(f))  # a sparse matrix product a batch
            bad = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            return pa.array(weak, pa.float64()), pa.array(bad), pa.array(bad < threshold)

        return work

    return with_arrow_columns(docs, "weak_bad double, bad double, kept boolean", start_scores, size_column=text_col)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", F.round("weak_bad", 6).alias("weak_bad"), F.round("bad", 6).alias("bad"), "kept")
