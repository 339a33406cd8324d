from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import components as components_module
from quillspark.llm import near_dup
from quillspark.llm.components import components
from quillspark.llm.near_dup import drop_near_duplicates, duplicate_classes, linked, minima, shingles, similarity


def words(text):
    return (text or "").encode().lower().split()


def brute(docs, size=5, share=(80, 100)):
    """id -> (set size, smallest id reachable), over all pairs."""
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and share[1] * both >= share[0] * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, most=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.randint(1, most)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            docs.append(" ".join(t) if rng.random() < 0.8 else "\t".join(t).upper())
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("block", "broadcast"), [(512, 1 << 20), (3, 1 << 20), (4, 0)])
def test_against_brute_force(spark, monkeypatch, block, broadcast):
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(near_dup, "BROADCAST_MEMBERS", broadcast)
    docs = corpus(3) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a b c d e"), (1006, "far " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in duplicate_classes(df).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (7, None), (7, "x")], "doc_id long, text string").selectExpr("*", "1 AS id", "'q' AS h", "2 AS kept")
    rows = duplicate_classes(df).collect()
    assert sorted((r.id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True)]
    left = drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 3, 7, 7]
    assert duplicate_classes(df.limit(0)).count() == 0


def test_estimates_follow_similarity(spark):
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8, 1.0):
        got = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = round(400 * (1 - j) / (1 + j))
            a, b = (np.concatenate([both[: 400 - n], rng.integers(0, 1 << 63, n, dtype=np.uint64)]) for _ in range(2))
            got.append([near_dup._pack(minima(x)[None, :])[0].tolist() for x in (a, b)])
        df = spark.createDataFrame(got, "a array<long>, b array<long>").select(F.avg(similarity(F.col("a"), F.col("b"))))
        assert abs(df.first()[0] - j) < 0.05


def test_linked_small_and_matrix_forms_agree():
    docs = corpus(8, groups=6, most=16)
    sets = [shingles(t.encode(), 4) for _, t in docs]
    ids = [i for i, _ in docs]
    want = {i: c for i, (_, c) in brute(docs, 4).items() if i != c}
    assert len(sets) > 24 and dict(linked(sets, ids, (80, 100))) == want
    for k in range(0, len(sets) - 12, 12):
        part = docs[k : k + 12]
        want = {i: c for i, (_, c) in brute(part, 4).items() if i != c}
        assert dict(linked(sets[k : k + 12], ids[k : k + 12], (80, 100))) == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {i: i for e in edges for i in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: find(i) for i in root if find(i) != i}


def test_large_groups(spark, monkeypatch):
    """Thousands of near texts of two kinds, and as many that share a frame alone, are one candidate group of many blocks."""
    rng = random.Random(11)
    monkeypatch.setattr(near_dup, "LOOSE", -1.0)  # whatever shares a bucket is in a group
    frame = [f"f{i}" for i in range(60)]
    near = [frame + [f"{k}{i}" for i in range(60)] for k in "ab"]
    docs = []
    for i in range(3_000):
        t = list(near[i % 2])
        t[rng.randrange(60, 115)] = f"x{i}"
        docs.append((i, " ".join(t)))
    docs += [(10_000 + i, " ".join(frame + [f"own{i}w{j}" for j in range(40)])) for i in range(1_500)]
    docs += [(20_000 + i, " ".join(frame + [f"own{i}w{j}" for j in range(39)] + ["end"])) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in duplicate_classes(df).collect()}
    assert {got[i] for i in range(0, 3_000, 2)} == {0} and {got[i] for i in range(1, 3_000, 2)} == {1}
    assert all(got[10_000 + i] == 10_000 + i for i in range(1_500)) and all(got[20_000 + i] == 10_000 + i for i in range(700))


@pytest.mark.parametrize("pairs", [0, 32, 1 << 40])
def test_groups_about_the_threshold(spark, monkeypatch, pairs):
    """Copies that are all about 0.8 to one another: the grid and the prefix filter give the links of brute force."""
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(near_dup, "PAIRS_A_SET", pairs)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(90)]
    docs = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4])):
            t[rng.randrange(90)] = f"e{rng.randrange(10_000)}"
        docs.append((i, " ".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.id: (r.n_shingles, r.component_id) for r in duplicate_classes(df).collect()} == brute(docs)


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(components_module, "HUB", 5)
    edges = [(0, i) for i in range(1, 60)] + [(i, 100 + i) for i in range(1, 40)] + [(300, 400 + i) for i in range(50)] + [(400, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 if i < 300 else 300 for e in edges for i in e if i not in (0, 300)}
