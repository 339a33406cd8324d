from __future__ import annotations

import random
import re
import subprocess
import sys
from pathlib import Path

import pytest

from quillspark.llm.decontaminate import Automaton, decontaminate, op2_decontaminate, words_of

ROOT = str(Path(__file__).resolve().parents[2])

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=13):
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(size, len(iw))
            for i in range(len(iw) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == iw[i : i + n]:
                        hit |= set(range(j, j + n))
                        if item is not None:
                            ids.add(str(item))
        out.append((doc, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_bytes", [4 << 20, 200])
def test_against_brute_force(spark, shard_bytes):
    rng = random.Random(4)
    vocab = ["a", "B", "cé", "d9", "ü", "E"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(1, None), (2, ""), (None, "a b"), (3, "A b ... cé"), (3, "A b ... cé"), (4, "x " * 20_000 + "a B cé")]
    items = [(i, text(rng.randint(1, 6))) for i in range(25)] + [(30, None), (31, "..."), (None, "d9 d9"), (32, "a b cé"), (32, "a b cé")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS ranges", "1 AS n_words", "2 AS r")
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), size=4, shard_bytes=shard_bytes)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()]
    assert sorted(rows, key=repr) == brute(docs, items, 4)
    assert got.select("r").first()[0] == 2
    for r in got.where("n_hit > 0").collect():
        for run, span in zip(r.ranges, r.spans, strict=True):
            assert words(r.text[span.start : span.end]) == words(r.text)[run.start : run.end]
    assert decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = decontaminate(df, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0 OR contaminated").count()
    assert none == 0


def test_query_finds_planted_passages(spark, sf):
    rows = op2_decontaminate(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert any(r.contaminated for r in rows)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 13])
def test_every_window_is_found(size):
    rng = random.Random(size)
    for _ in range(60):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 3 * size + 2))).encode()) for i in range(4)]
        text = " ".join(rng.choice("abcd") for _ in range(80))
        for _, t in items:
            text += " " + t.decode() + " d " + " ".join(t.decode().split()[rng.randint(0, 3) :])
        ranges, ids = Automaton(items, size).scan(words_of(text.encode()))
        (_, _, n_hit, want, _) = brute([(0, text)], [(i, t.decode()) for i, t in items], size)[0]
        assert (sum(b - a for a, b in ranges), sorted(ids)) == (n_hit, want)


def test_memory_of_a_full_shard():
    code = """
import inspect, random, resource
from quillspark.llm.decontaminate import Automaton, decontaminate
rng = random.Random(1)
bound = inspect.signature(decontaminate).parameters["shard_bytes"].default
vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(50_000)]
items, total = [], 0
while total < bound:
    items.append((str(len(items)), " ".join(rng.choice(vocab) for _ in range(60)).encode()))
    total += len(items[-1][1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
a = Automaton(items, 13)
assert a.scan(items[5][1].split())[1] == {"5"}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(out.stdout.split()[-1]) < 600  # MB, so that two workers fit an executor of 3 GB
