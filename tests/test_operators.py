from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import candidates as C
from quillspark.operators import disambiguation as D
from quillspark.operators import evaluation as E
from quillspark.operators import features as X
from quillspark.operators import ranking as R
from quillspark.operators import retrieval as S
from quillspark.operators import training as L


def scored(spark, rows):
    return spark.createDataFrame(rows, "q_id string, mention string, en_id string, fb_id string, score double")


def test_commonness_and_back_off(spark):
    forms = spark.createDataFrame([("x", "facc09", "A", 3), ("x", "facc09", "B", 1), ("x", "facc12", "A", 1), ("x", "facc12", "C", 5), ("x", "anchor", "D", 9)], "surface string, predicate string, en_id string, cnt long")
    assert {r.en_id: round(r.commonness, 6) for r in C.commonness(forms).collect()} == {"A": 0.4, "B": 0.1, "C": 0.5}
    q = spark.createDataFrame([("q", "x y")], "q_id string, q_content string")
    got = {r.en_id: (round(r.commonness, 6), r.matches) for r in C.candidates(q, forms, 0.2).collect()}
    assert got == {"A": (0.4, 3), "C": (0.5, 3), "D": (0.0, 3)}
    kept = C.candidates(q, forms, 0.2, spark.createDataFrame([("A",), ("A",)], "en_id string")).collect()
    assert [(r.en_id, r.matches) for r in kept] == [("A", 3)]
    found = spark.createDataFrame([("q", "a", 1, "A", 0.1), ("q", "a b", 2, "B", 0.2)], "q_id string, mention string, n int, en_id string, commonness double")
    assert [r.en_id for r in C.longest_match(found).collect()] == ["B"]


def test_same_as(spark):
    pairs = spark.createDataFrame([("f", "r", 0), ("f", "x", 1), ("f", "y", 2), ("g", "r", 0), ("h", "r", 0), ("h", "r2", 1)], "fb_uri string, dbp_uri string, pos int")
    redirects = spark.createDataFrame([("r",), ("r2",)], "dbp_uri string")
    assert {r.fb_uri: r.dbp_uri for r in C.same_as(pairs, redirects).collect()} == {"f": "x", "g": "r", "h": None}


def test_ranks(spark):
    rows = [("q", "m1", "1", "A", 4.0), ("q", "m2", "2", "B", 3.0), ("q", "m3", "3", "A", 2.0), ("q", "m4", "4", "C", 1.0)]
    assert {r.mention: r["rank"] for r in R.rank_entities(scored(spark, rows)).collect()} == {"m1": 1, "m2": 2, "m3": 2, "m4": 3}
    assert {r.mention for r in R.top_k(scored(spark, rows), 2).collect()} == {"m1", "m2", "m3"}
    assert R.top_k(scored(spark, rows), None).count() == 4
    assert {r.fb_id: r["rank"] for r in R.trec_run(scored(spark, rows), "x").collect()} == {"A": 1, "B": 2, "C": 3}


def test_prune_delta_follows_its_model(spark):
    def model(s):
        s = sorted(s, reverse=True)
        if len(s) <= 2:
            return s
        largest, kept = s[0] - s[1], [s[0]]
        for i in range(1, len(s)):
            kept.append(s[i])
            if i + 1 < len(s):
                gap = s[i] - s[i + 1]
                if gap < largest:
                    kept.pop()
                    break
                largest = max(largest, gap)
        return kept

    rng = random.Random(3)
    lists = {"f": [10.0, 9.0, 5.0, 4.0]} | {f"q{i}": [float(rng.randint(0, 20)) for _ in range(rng.randint(1, 7))] for i in range(40)}
    rows = [(q, f"m{n}", str(n), str(n), s) for q, v in lists.items() for n, s in enumerate(v)]
    got: dict = {}
    for r in R.prune_delta(scored(spark, rows)).collect():
        got.setdefault(r.q_id, []).append(r.score)
    assert {q: sorted(v, reverse=True) for q, v in got.items()} == {q: model(v) for q, v in lists.items()}
    assert sorted(got["f"], reverse=True) == [10.0, 9.0]


def test_delta_floors_leave_the_rows_of_prune_delta(spark):
    rng = random.Random(5)
    held = [(f"w{s}", s * 10 + i, float(rng.choice([rng.randint(0, 6), rng.randint(0, 40)]))) for s in range(40) for i in range(rng.randint(1, 6))]
    asked = [(f"q{i}", " ".join(f"w{x}" for x in rng.sample(range(40), rng.randint(1, 4)))) for i in range(300)]
    held = spark.createDataFrame(held, "surface string, en_id long, score double")
    rows = C.said(spark.createDataFrame(asked, "q_id string, q_content string"), held).drop("q_content")
    levels = R.delta_levels(held)
    cut = R.delta_floors(C.met(rows, levels, (), packed=True))
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()
    kept = R.above_delta(C.met(cut, held.join(levels, ["surface", "score"], "left_semi")))
    key = lambda df: sorted((r.q_id, r.mention, r.en_id) for r in df.collect())
    assert key(kept) == key(R.prune_delta(C.met(rows, held)))


def test_min_max_and_competition_rank(spark):
    rows = [("q", "a", "1", "1", 1.0), ("q", "b", "2", "2", 3.0), ("q", "c", "3", "3", 5.0), ("p", "a", "1", "1", 7.0)]
    assert sorted((r.q_id, r.score) for r in R.min_max(scored(spark, rows)).collect()) == [("p", 0.5), ("q", 0.0), ("q", 0.5), ("q", 1.0)]
    counts = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", 1)], "field string, docs int")
    assert sorted((r.field, r["rank"]) for r in R.competition_rank(counts, "docs", 2).collect()) == [("a", 1), ("b", 1)]


def test_folds(spark):
    keys = spark.range(0, 103).withColumnRenamed("id", "k")
    sizes = {r.fold: r["count"] for r in R.folds(keys, "k", 5).groupBy("fold").count().collect()}
    assert sorted(sizes.values()) == [20, 20, 21, 21, 21]
    assert R.folds(keys, "k", -1).select("fold").distinct().count() == 103
    members = R.fold_members(R.folds(keys, "k", 5), "k", 5)
    assert members.count() == 515 and members.where("mode = 'testing'").select("k").distinct().count() == 103


def overlap(mentions):
    words = [w for m in mentions for w in dict.fromkeys(m.split())]
    return len(words) != len(set(words))


def test_overlap(spark):
    cases = {("the", "music man"): False, ("the", "the man", "music"): True, ("yx x",): False, ("a a",): False}
    rows = spark.createDataFrame([(list(k),) for k in cases], "m array<string>").select("m", D.overlapping(F.col("m")).alias("o")).collect()
    assert {tuple(r.m): r.o for r in rows} == cases


def test_containment_and_interpretations(spark):
    rows = [("q", m, str(i), str(i), float(s)) for i, (m, s) in enumerate([("new york", 9), ("york", 8), ("york city", 7), ("hotel", 6), ("city", 5), ("new york", 4)])]
    kept = D.prune_containment(scored(spark, rows))
    assert sorted((r.mention, r.score) for r in kept.collect()) == [("hotel", 6.0), ("new york", 9.0), ("york city", 7.0)]
    sets = D.interpretations(kept).collect()
    assert sorted(sorted(m.mention for m in r.members) for r in sets) == [["hotel", "new york"], ["hotel", "york city"]]
    best = {tuple(sorted(r.inter_set.values())): (r.score, r.target) for r in D.greedy(scored(spark, rows), 5.0).collect()}
    assert best == {("hotel", "new york"): (7.5, "1"), ("hotel", "york city"): (6.5, "1")}


def test_interpretations_follow_their_model(spark):
    rng = random.Random(6)
    words = ["a", "b", "c", "d", "e"]
    rows, want = [], {}
    for q in range(30):
        inst = [(f"q{q}", " ".join(rng.sample(words, rng.randint(1, 2))), str(i), str(i), float(rng.randint(0, 30)) + i / 100) for i in range(rng.randint(1, 6))]
        rows += inst
        order = sorted(inst, key=lambda x: (-x[4], x[1], x[2]))
        sets: list = [[]]
        for x in order:
            free = [s for s in sets if not any(set(y[1].split()) & set(x[1].split()) for y in s)]
            if free:
                sets = [[*s, x] if s in free else s for s in sets]
            else:
                sets.append([x])
        want[f"q{q}"] = sorted(sorted(x[2] for x in s) for s in sets if s)
    got: dict = {}
    for r in D.interpretations(scored(spark, rows)).collect():
        got.setdefault(r.q_id, []).append(sorted(m.en_id for m in r.members))
    assert {q: sorted(v) for q, v in got.items()} == want


def test_entity_sets_equal_enumeration(spark):
    rows = [("q", "jon gruden", "A", "A", 1.0), ("q", "gruden", "A", "A", 1.0), ("q", "jon", "B", "B", 1.0), ("q", "jon", "C", "C", 1.0), ("q", "rumors", "D", "D", 1.0)]
    got = D.entity_sets(scored(spark, rows)).collect()
    want = set()
    for n in range(1, 6):
        for combo in itertools.combinations(rows, n):
            ms = [r[1] for r in combo]
            if len(set(ms)) == n and not overlap(ms) and len({r[2] for r in combo}) == n:
                want.add(tuple(sorted((r[1], r[2]) for r in combo)))
    assert {tuple(sorted((m.mention, m.en_id) for m in r.members)) for r in got} == want and len(got) == len(want)


def test_set_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (1, 3.0, 2)], "s int, f double, m int")
    r = D.weighted_sums(df, "f", "m", ["s"]).first()
    assert (r.wsum_men, r.wsum_men_pow, r.wsum_set_men, r.wsum_set_men_pow) == (8.0, 14.0, 15.0, 135.0)
    r = D.aggregates(spark.createDataFrame([(1, 2.0), (1, 3.0), (1, 7.0)], "s int, f double"), ["f"], ["s"]).first()
    assert (r.f_min, r.f_max, r.f_avg) == (2.0, 7.0, 4.0)
    top = D.set_instances(scored(spark, [("q", "a", "1", "1", 3.0), ("q", "b", "2", "2", 1.0), ("q", "c", "3", "3", None)]).withColumn("commonness", F.lit(0.5)), 5)
    assert {(r.set_key, r.mention, r.score, r["rank"]) for r in top.collect()} == {("1:a", "a", 1.0, 1), ("2:b", "b", 0.0, 2), ("1:a|2:b", "a", 1.0, 1), ("1:a|2:b", "b", 0.0, 2)}


def test_smoothing(spark):
    lit = lambda x: F.lit(float(x))
    r = spark.range(1).select(S.jm(lit(2), lit(10), lit(5), lit(100)).alias("jm"), S.dirichlet(lit(2), lit(10), lit(5), lit(100), lit(20)).alias("d"), S.dirichlet(lit(2), lit(10), lit(5), lit(100), lit(0)).alias("z"), S.jm(lit(0), lit(0), lit(0), lit(0)).alias("e")).first()
    assert (round(r.jm, 9), round(r.d, 9), r.z, r.e) == (0.185, 0.1, 0.0, 0.0)


def small_index(spark):
    rows = [(1, "contents", "red fox runs"), (1, "names", "fox"), (2, "contents", "red red dog"), (2, "names", "dog"), (3, "contents", "quick cat")]
    return S.build_index(spark.createDataFrame(rows, "doc_id int, field string, value string"))


def test_mixture_against_model(spark):
    index = small_index(spark)
    docs = {1: {"contents": ["red", "fox", "runs"], "names": ["fox"]}, 2: {"contents": ["red", "red", "dog"], "names": ["dog"]}, 3: {"contents": ["quick", "cat"], "names": []}}
    weights = {"names": 0.2, "contents": 0.8}
    coll = {f: [t for d in docs.values() for t in d[f]] for f in weights}

    def p(t, d):
        return sum(w * (0.9 * (docs[d][f].count(t) / len(docs[d][f]) if docs[d][f] else 0) + 0.1 * coll[f].count(t) / len(coll[f])) for f, w in weights.items())

    def pc(t):
        return sum(w * coll[f].count(t) / len(coll[f]) for f, w in weights.items())

    query = ["red", "fox", "red", "zebra"]
    q = spark.createDataFrame([("q", " ".join(query))], "q_id string, q_content string")
    likelihood = {r.doc_id: r.score for r in S.score_mixture(index, q, weights).collect()}
    ratio = {r.doc_id: r.score for r in S.score_mixture(index, q, weights, form="nllr", analyse=False).collect()}
    assert set(likelihood) == set(ratio) == {1, 2}
    for d in (1, 2):
        assert math.isclose(likelihood[d], sum(math.log(p(t, d)) for t in query if p(t, d)), rel_tol=1e-9)
        want = math.exp(sum(query.count(t) / 4 * (math.log(p(t, d)) - math.log(pc(t))) for t in set(query) if p(t, d)))
        assert math.isclose(ratio[d], want, rel_tol=1e-9)
    # a document without any term: the background alone
    pairs = spark.createDataFrame([("q", "big red fox", "big", 3), ("p", "big", "big", 3)], "q_id string, q_content string, mention string, doc_id int")
    assert {r.q_id: round(r.context_sim, 9) for r in S.context_similarity(index, pairs).collect()} == {"q": 0.1, "p": 0.0}
    with pytest.raises(ValueError):
        S.scorer("bm25")


def test_context_and_boolean(spark):
    r = spark.range(1).select(S.context(F.lit("uss yorktown charleston"), F.lit("uss")).alias("a"), S.context(F.lit("x"), F.lit("x")).alias("b")).first()
    assert (r.a, r.b) == ("yorktown charleston", "")
    index = small_index(spark)
    assert [r.doc_id for r in S.documents_with(index, ["red", "dog"]).collect()] == [2]
    assert {r.doc_id for r in S.documents_with(index, ["red", "dog"], every=False).collect()} == {1, 2}


def test_entity_values(spark):
    triples = spark.createDataFrame([("<dbpedia:A_b>", "<l>", "The A"), ("<dbpedia:A_b>", "<k>", "<dbpedia:C_d>"), ("<x:B>", "<l>", "no"), ("<dbpedia:E>", "<k>", "x")], "s string, p string, o string")
    fields = spark.createDataFrame([("<l>", "names", False), ("<l>", "title", False), ("<k>", "links", True)], "p string, field string, only_uris boolean")
    got = sorted((r.doc_id, r.field, r.value) for r in S.entity_values(triples, fields, must_have=["<l>"]).collect())
    assert got == [("<dbpedia:A_b>", "contents", "A b"), ("<dbpedia:A_b>", "contents", "C d"), ("<dbpedia:A_b>", "contents", "The A"), ("<dbpedia:A_b>", "links", "<dbpedia:C_d>"), ("<dbpedia:A_b>", "names", "The A"), ("<dbpedia:A_b>", "title", "The A")]


def test_set_features(spark):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "set_id int, en_id string")
    links = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "x"), ("c", "x")], "en_id string, dst string")
    r = {x.set_id: x for x in X.graph_features(members, links).collect()}
    assert math.isclose(r[1].completeness, 1 / 3) and r[2].completeness == 1.0
    r = {x.set_id: (x.common_links, x.total_links, x.j_kb) for x in X.link_features(members, links).collect()}
    assert r == {1: (1, 2, 0.5), 2: (-1, 2, -1.0)}


def test_cooccurrence(spark):
    rows = [(d, "a") for d in range(100)] + [(d, "b") for d in range(80, 120)]
    corpus = spark.createDataFrame(rows, "doc_id int, en_id string")
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "set_id int, en_id string")
    r = {x.set_id: x for x in X.cooccurrence_features(members, corpus, 1000).collect()}
    assert math.isclose(r[1].rel_mw, 0.5, rel_tol=1e-9) and math.isclose(r[1].p, 0.02) and math.isclose(r[1].h, 0.0980391, rel_tol=1e-6)
    assert math.isclose(r[1].j_corpora, 20 / 120) and (r[2].j_corpora, r[2].rel_mw) == (-1.0, -1.0)


def test_strict_evaluation(spark):
    kind = "q_id string, ens array<string>"
    gold = spark.createDataFrame([("a", ["A"]), ("a", ["B"]), ("b", []), ("c", None), ("d", ["X", "Y"])], kind)
    result = spark.createDataFrame([("a", ["A"]), ("a", ["C"]), ("c", ["Z"]), ("d", ["Y", "X"]), ("other", ["Q"])], kind)
    rows = {r.q_id: (r.precision, r.recall, r.f1) for r in E.strict_per_query(gold, result).collect()}
    assert rows == {"a": (0.5, 0.5, 0.5), "b": (1.0, 1.0, 1.0), "c": (0.0, 0.0, 0.0), "d": (1.0, 1.0, 1.0)}
    with pytest.raises(ValueError, match="twice"):
        E.check_no_duplicates(spark.createDataFrame([("a", ["A", "B"]), ("a", ["B", "A"])], kind))


def test_training_sets(spark):
    found = spark.createDataFrame([("q", "m", "A", 0.5), ("q", "m", "B", 0.2)], "q_id string, mention string, en_id string, commonness double")
    truth = spark.createDataFrame([("q", "m", "A", "0"), ("q", "n", "C", "0"), ("q", "k", "D", "-1")], "q_id string, mention string, en_id string, set_id string")
    common = spark.createDataFrame([("m", "A", 0.5)], "surface string, en_id string, commonness double")
    rows = {(r.mention, r.en_id): (r.commonness, r.target) for r in L.with_truth(found, truth, common).collect()}
    assert rows == {("m", "B"): (0.2, "0"), ("m", "A"): (0.5, "1"), ("n", "C"): (0.0, "1"), ("k", "D"): (0.0, "1")}
    sets = L.truth_sets(truth).collect()
    assert [(r.set_id, r.key) for r in sets] == [("0", "A:m|C:n")]
    tried = spark.createDataFrame([("q", "A:m|C:n", 9), ("q", "B:m", 1), ("q", "X:m", 7)], "q_id string, key string, worst int")
    assert {r.key: r.target for r in L.training_sets(tried, L.truth_sets(truth), 3).collect()} == {"A:m|C:n": "1", "B:m": "0"}


def test_mention_features_leave_the_rows_of_queries_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spark.createDataFrame([("q", "red ball x", "red ball", 2), ("p", "ball", "ball", 1)], "q_id string, q_content string, mention string, matches long")
        out = X.mention_features(found, spark.createDataFrame([("red ball", 2), ("ball", 3)], "surface string, n long"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.q_id, r.len, r.ntem, r.smil, r.matches, round(r.len_ratio, 6)) for r in out.collect()) == [("p", 1, 3, 3, 1, 1.0), ("q", 2, 2, 5, 2, 0.666667)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_context_similarity_of_matches(spark):
    """As of pairs that are given one by one; a pair's rows are summed up where its document's postings are."""
    index = small_index(spark)
    q = spark.createDataFrame([("q", "red dog", "red"), ("p", "red dog", "dog"), ("one", "red", "red"), ("none", "unseen", "unseen"), ("cut", "reddog red", "red")], "q_id string, q_content string, mention string")
    hits = S.query_terms(q).join(index.postings.where("field = 'contents'"), "term").select("q_id", "doc_id").distinct()
    rows = lambda df: sorted((r.q_id, r.mention, r.doc_id, round(r.context_sim, 9)) for r in df.collect())
    got = S.context_similarity_of_matches(index, q)
    assert rows(got) == rows(S.context_similarity(index, q.join(hits, "q_id"))) and {r.q_id for r in got.collect()} == {"q", "p", "one", "cut"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(q_id#\d+L?, doc_id", plan)


def test_index_of_some_terms(spark):
    """Lengths and fields count all terms; other terms than those wanted have no postings."""
    values = spark.createDataFrame([(1, "f", "red dog red"), (2, "f", "blue cat"), (3, "f", "the")], "doc_id long, field string, value string")
    every, some = S.build_index(values), S.build_index(values, only=spark.createDataFrame([("red",), ("cat",), ("red",), ("cow",)], "term string"))
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert rows(some.lengths) == rows(every.lengths) and rows(some.fields) == rows(every.fields)
    assert rows(some.terms) == rows(every.terms.where("term IN ('red', 'cat')")) and rows(some.postings) == rows(every.postings.where("term IN ('red', 'cat')"))
    assert len(rows(some.postings)) == 2


def test_rows_below_a_floor_rank_worse(spark):
    """Of random surfaces with shared entities and ties; what top_k gives does not change, and less is ranked."""
    rng = random.Random(5)
    held = [(f"s{s}", e, e // 2, rng.choice([0.1, 0.2, 0.3, 0.4]) + (0.5 if s % 3 == 0 else 0.0)) for s in range(12) for e in rng.sample(range(24), rng.randint(1, 14))]
    said = [(f"q{q}", f"s{s}") for q in range(30) for s in rng.sample(range(12), rng.randint(1, 4))]
    entries = spark.createDataFrame(held, "surface string, en_id long, fb_id long, score double")
    rows = spark.createDataFrame(said, "q_id string, mention string")
    best = R.best_of_surface(entries, 2)
    limit = R.limits(rows.join(R.floors(best, 2).withColumnRenamed("surface", "mention"), "mention"))
    some = R.above_floor(limit.join(best.withColumnRenamed("surface", "mention"), "mention"))
    every = rows.join(entries.withColumnRenamed("surface", "mention"), "mention")
    got = lambda df: sorted((r.q_id, r.mention, r.en_id, r.rank) for r in R.top_k(df, 2).collect())
    assert got(some) == got(every) and some.count() < rows.join(best.withColumnRenamed("surface", "mention"), "mention").count()
