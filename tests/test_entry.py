from __future__ import annotations

import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspark.operators.retrieval import score_mixture, score_tfidf
from quillspark.plans import bindings as B
from quillspark.plans import set_queries
from quillspark.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"q_id", "mention", "en_id", "fb_id", "rank"}
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, tables, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cur = tables.execute(ORACLES[name])
    there = [d[0] for d in cur.description]
    assert sorted(there) == columns
    theirs = [tuple(plain(r[there.index(c)]) for c in columns) for r in cur.fetchall()]
    ours = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_learners(spark, sf):
    n = spark.read.parquet(f"{sf}/labels.parquet").count()
    truth = {r.id: r.target for r in set_queries._labelled(spark, sf).collect()}
    for name in ("rf_rank", "gbt_classify", "lr_classify", "cv_rf"):
        rows = QUERIES[name](spark, sf).collect()
        assert len(rows) == n and all(math.isfinite(r.score) for r in rows)
        assert sum((r.score >= 0.5) == (truth[r.id] == "1") for r in rows) / n >= 0.9
    total = sum(r.importance for r in QUERIES["feature_importance"](spark, sf).collect())
    assert abs(total - 1) < 1e-6


def test_sets_without_sql(spark, sf):
    rows = QUERIES["greedy_interpretations"](spark, sf).collect()
    assert rows and all(r.target == "1" and r.ens for r in rows)
    assert QUERIES["set_instances"](spark, sf).where("score < 0 OR score > 1 OR rank > 5").count() == 0


def test_set_instances_against_brute_force(spark, sf):
    """All instances are normalised; all sets of those of the best five ranks."""
    held, got, expected = {}, {}, set()
    for r in B.instances(spark, sf).collect():
        held.setdefault(r.q_id, []).append((-r.score, r.mention, r.en_id, r.fb_id))
    for r in QUERIES["set_instances"](spark, sf).collect():
        low, high = -max(held[r.q_id])[0], -min(held[r.q_id])[0]
        score = next(-x[0] for x in held[r.q_id] if x[1:3] == (r.mention, r.en_id))
        assert math.isclose(r.score, (score - low) / (high - low) if high > low else 0.5, abs_tol=1e-6)
        got.setdefault((r.q_id, r.set_key), set()).add((r.mention, r.en_id))
    for q, rows in held.items():
        best, seen = [], set()
        for _, mention, en_id, fb_id in sorted(rows):
            seen.add(fb_id)
            if len(seen) <= 5:
                best.append((mention, en_id))
        for n in range(1, len(best) + 1):
            for some in itertools.combinations(best, n):
                every = [w for m, _ in some for w in set(m.split())]
                if len(every) == len(set(every)) and len({e for _, e in some}) == n:
                    expected.add((q, frozenset(some)))
    assert {(q, frozenset(m)) for (q, _), m in got.items()} == expected


def test_queries_shuffle_the_numbers_of_lines_once(spark, sf):
    plan = B.queries(spark, sf).groupBy("q_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(concat(o_, cast(l_orderkey" in plan


def test_suppliers_of_lines_are_not_shuffled(spark, sf):
    assert "l_suppkey" not in B.queries(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_partitions_of_sorted_candidates_fit_in_memory():
    assert B.dealt(36_000_000, 13.5) == 1215 and B.dealt(36_000_000, 750) == 18_000 and B.dealt(600, 2.0) == 0


def test_partitions_of_written_candidates():
    assert B.dealt(36_000_000, 750, B.WRITTEN) == 2700 and B.dealt(36_000_000, 13.5, B.WRITTEN) == 49


@pytest.mark.parametrize("name", ["candidate_instances", "minmax_normalise", "wiki_candidates"])
def test_written_candidates_are_dealt(spark, sf, name, monkeypatch):
    monkeypatch.setattr(B, "dealt", lambda lines, each, rows=B.SORTED: 7 if rows == B.WRITTEN else 0)
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert ", 7), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1


TOGETHER = ["candidate_instances", "candidates_kb_filtered", "candidates_union", "cer_cv_set", "cer_train_set", "longest_match_backoff", "minmax_normalise", "wiki_candidates"]


@pytest.mark.parametrize("name", TOGETHER)
def test_candidates_of_a_mention_are_written_together(spark, sf, name):
    rows = QUERIES[name](spark, sf).select(F.spark_partition_id().alias("at"), "mention").collect()
    assert rows and rows == sorted(rows)


def test_wiki_commonness_is_rounded_once_a_surface(spark, sf):
    plan = QUERIES["wiki_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" not in plan and "Generate" in plan


def test_sessions_are_found_once_a_query(spark, sf):
    plan = QUERIES["candidate_instances"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS session" in plan and "session" in plan.split("Generate")[0] and "regexp_replace" not in plan.split("Generate")[0]


def test_threshold_holds_no_more_than_it_returns(spark, sf):
    plan = QUERIES["prune_threshold"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "fb_id" not in plan and "commonness" not in plan


def test_two_pass_scores_all_matches_of_a_small_corpus(spark):
    """Of 1,000 documents the first pass of 10,000 loses none, so the best by the mixture are the query's rows."""
    sf = "/root/testdata/sf0.01"
    index, queries = B.index(spark, sf), B.retrieval_queries(spark, sf)
    found = score_tfidf(index, queries, B.table(spark, sf, "documents").count()).select("q_id", "doc_id")
    best = {}
    for r in score_mixture(index, queries, B.WEIGHTS).join(found, ["q_id", "doc_id"], "left_semi").collect():
        best.setdefault(r.q_id, []).append((-round(r.score, 6), r.doc_id))
    got = {}
    for r in QUERIES["two_pass_retrieval"](spark, sf).collect():
        got.setdefault(r.q_id, []).append((r.rank, -r.score))
    assert {q: [s for s, _ in sorted(rows)[:100]] for q, rows in best.items()} == {q: [s for _, s in sorted(rows)] for q, rows in got.items()}
