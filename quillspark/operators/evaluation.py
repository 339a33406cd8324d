"""Strict set evaluation and ranked measures.

Gold and result sets: q_id and ens (array of entities), one row a set. A query of the
gold standard without any set has one row with a null or empty ens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _keyed(sets: DataFrame) -> DataFrame:
    return sets.where(F.size(F.coalesce("ens", F.array().cast("array<string>"))) > 0).select("q_id", F.array_join(F.array_sort(F.transform("ens", lambda e: e.cast("string"))), "|").alias("key"))


def duplicate_sets(sets: DataFrame) -> DataFrame:
    """A-13: q_id and key of sets that a query has more than once."""
    return _keyed(sets).groupBy("q_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_no_duplicates(sets: DataFrame) -> None:
    found = duplicate_sets(sets).limit(1).collect()
    if found:
        raise ValueError(f"query {found[0].q_id} has a set twice")


def strict_per_query(gold: DataFrame, result: DataFrame) -> DataFrame:
    """A-12, J-23, K-16: q_id, tp, fn, fp, precision, recall, f1 of every gold query; sets match as wholes.

    A query without gold sets scores 1 if it has no result, else 0.
    """
    g, r = _keyed(gold), _keyed(result)
    asked = gold.select("q_id").distinct()
    both = g.withColumn("in_gold", F.lit(1)).join(r.withColumn("in_result", F.lit(1)), ["q_id", "key"], "full")
    counts = both.groupBy("q_id").agg(
        F.count_if(F.col("in_gold").isNotNull() & F.col("in_result").isNotNull()).alias("tp"), F.count_if(F.col("in_result").isNull()).alias("fn"), F.count_if(F.col("in_gold").isNull()).alias("fp")
    )
    out = asked.join(counts, "q_id", "left").na.fill(0, ["tp", "fn", "fp"])
    tp, fn, fp = (F.col(c).cast("double") for c in ("tp", "fn", "fp"))
    empty = (tp + fn) == 0
    share = lambda d: F.when(empty, F.when(fp == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(tp, d), F.lit(0.0)))
    out = out.withColumns({"precision": share(tp + fp), "recall": share(tp + fn)})
    p, r_ = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * p * r_, p + r_), F.lit(0.0)))


def strict_macro(gold: DataFrame, result: DataFrame) -> DataFrame:
    """A-12: means over gold queries; f1 is the harmonic mean of the two means."""
    means = strict_per_query(gold, result).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n_queries"))
    return means.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def ranked_per_query(qrels: DataFrame, run: DataFrame, k: int = 5) -> DataFrame:
    """q_id, ap, p_at_1, rr, recall_at_k and recall of judged queries; ties of score by falling document id.

    qrels: q_id, doc_id (relevant ones); run: q_id, doc_id, score.
    """
    rel = qrels.select("q_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    total = rel.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_rel"))
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), F.desc("doc_id")))
    hits = run.withColumn("place", place).join(rel, ["q_id", "doc_id"])
    hits = hits.withColumn("found", F.row_number().over(Window.partitionBy("q_id").orderBy("place")))
    got = hits.groupBy("q_id").agg(F.sum(F.col("found") / F.col("place")).alias("s"), F.min("place").alias("first"), F.count_if(F.col("place") <= k).alias("at_k"), F.count(F.lit(1)).alias("any"))
    out = total.join(got, "q_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "q_id", zero(F.col("s") / F.col("n_rel")).alias("ap"), zero((F.col("first") == 1).cast("double")).alias("p_at_1"), zero(1.0 / F.col("first")).alias("rr"),
        zero(F.col("at_k") / F.col("n_rel")).alias("recall_at_k"), zero(F.col("any") / F.col("n_rel")).alias("recall"),
    )


def ranked_means(qrels: DataFrame, run: DataFrame, k: int = 5) -> DataFrame:
    per = ranked_per_query(qrels, run, k)
    return per.agg(*[F.avg(c).alias(n) for c, n in (("ap", "map"), ("p_at_1", "p_at_1"), ("rr", "mrr"), ("recall_at_k", "recall_at_k"), ("recall", "recall"))])
