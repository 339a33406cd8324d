from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ranking as R
from quillspark.operators import rankers as L
from quillspark.operators import retrieval as S
from quillspark.plans.registry import QUERIES


def test_scores_of_pairs_follow_their_model(spark):
    values = [(1, "names", "red fox"), (1, "contents", "red fox red hen"), (2, "names", "hen"), (2, "contents", "hen")]
    index = S.build_index(spark.createDataFrame(values, "doc_id long, field string, value string"))
    texts = spark.createDataFrame([("a", "red hen red"), ("b", "wolf")], "t_id string, q_content string")
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "t_id string, doc_id long")
    held = {(d, f): v.split() for d, f, v in values}

    def model(words, doc, weights):
        total = {f: [w for (_, g), ws in held.items() if g == f for w in ws] for f in weights}
        out, known = 0.0, False
        for w in set(words):
            back = sum(x * total[f].count(w) / len(total[f]) for f, x in weights.items())
            if back:
                known = True
                own = sum(x * held[doc, f].count(w) / len(held[doc, f]) for f, x in weights.items())
                out += words.count(w) / len(words) * math.log((0.9 * own + 0.1 * back) / back)
        return math.exp(out) if known else 0.0

    both = {(r.t_id, r.doc_id): r for r in L.field_scores(index, texts, pairs, {"names": "n", "contents": "c"}, "q").collect()}
    mixed = {(r.t_id, r.doc_id): r.s for r in L.pair_scores(index, texts, pairs, {"names": 0.2, "contents": 0.8}, "s").collect()}
    for (t, d), row in both.items():
        words = {"a": ["red", "hen", "red"], "b": ["wolf"]}[t]
        assert (row.q_n, row.q_c, mixed[t, d]) == pytest.approx([model(words, d, w) for w in ({"names": 1.0}, {"contents": 1.0}, {"names": 0.2, "contents": 0.8})])


def test_ranker_ranks_truth_first(spark, sf):
    rows = QUERIES["ranker_scores"](spark, sf).collect()
    first = [r for r in rows if r.rank == 1]
    asked = {r.q_id for r in rows if r.target == "1"}
    assert sum(r.target == "1" for r in first if r.q_id in asked) / len(asked) > sum(r.target == "1" for r in rows) / len(rows)


def test_models_and_folds_are_saved(spark, tmp_path):
    df = spark.range(60).selectExpr("id", "cast(id % 2 AS string) AS target", "cast(id % 2 AS double) AS a", "cast(id AS double) AS b")
    for kind, task in (("rf", "classification"), ("gbrt", "regression"), ("lr", "classification")):
        model = L.Trained.train(df, ["b", "a"], kind, task, **({} if kind == "lr" else {"trees": 5}))
        model.save(spark, str(tmp_path / kind))
        again = L.Trained.load(spark, str(tmp_path / kind))
        one, two = ({r.id: r.score for r in m.score(df).collect()} for m in (model, again))
        assert one == two and again.features == ["b", "a"]
    L.save_folds(R.folds(df, "id", 5), str(tmp_path / "folds"))
    assert L.load_folds(spark, str(tmp_path / "folds"), 5).count() == 60
    with pytest.raises(ValueError, match="5 folds"):
        L.load_folds(spark, str(tmp_path / "folds"), 4)


def test_folds_take_any_key(spark):
    for keys in (spark.range(50).select((F.col("id") * 10**17).alias("k")), spark.range(50).select(F.concat(F.lit("s-"), F.col("id")).alias("k"))):
        assert [r["count"] for r in R.folds(keys, "k", 5).groupBy("fold").count().collect()] == [10] * 5


def test_detector_features_of_sets_of_three(spark):
    """Links, documents and edges of sets in one row, against sets of Python."""
    about = {1: ([1, 2, 3], [1, 2]), 2: ([2, 3], [2, 3]), 3: ([3, 4], [4]), 4: ([], [])}
    kind = "q_id string, asked int, terms array<struct<term:string,share:double,pc:double>>, members array<struct<mention:string,en_id:long,score:double,rank:int,commonness:double,mlm_tc:double,context_sim:double,linked:array<long>,docs:array<long>,own:array<struct<term:string,own:double>>,m:int>>"
    some = [(1,), (4,), (1, 2), (1, 3), (1, 2, 3), (1, 2, 4)]
    member = lambda e: (f"m{e}", e, 0.1 * e, e, 0.5, 0.25, 0.125, *about[e], [("a", 0.5 * e)], 1)
    rows = [(str(s), 4, [("a", 0.5, 0.25), ("b", 0.25, 0.5)], [member(e) for e in s]) for s in some]
    got = {r.q_id: r for r in L.detector_features(spark.createDataFrame(rows, kind), 10).collect()}
    for s in some:
        r, n = got[str(s)], len(s)
        links, docs = ([set(about[e][i]) for e in s] for i in (0, 1))
        both, every = set.intersection(*links), set.union(*links)
        edges = sum(bool(docs[i] & docs[j]) for i in range(n) for j in range(i))
        assert (r.num_nodes, r.num_edges, r.total_links, r.common_links) == (n, edges, len(every), len(both) if n > 1 else -1)
        assert (r.links_min, r.links_max, r.p) == (min(map(len, links)), max(map(len, links)), len(set.intersection(*docs)) / 10)
        own = sum(0.5 * e for e in s)
        sim = math.exp(0.5 * math.log((own + n * 0.1 * 0.25) / 0.25) + 0.25 * math.log(n * 0.1))
        assert (r.set_sim, r.len_ratio_set, r.score_avg) == pytest.approx((sim, n / 4, 0.1 * sum(s) / n))


def test_sets_of_the_detector_are_not_shuffled(spark, sf):
    df = QUERIES["detector_features"](spark, sf)
    assert dict(df.dtypes)["links_min"] == "bigint"
    above = df._jdf.queryExecution().optimizedPlan().toString().split("Generate explode")[0]
    assert "Join" not in above and "Aggregate [" not in above
