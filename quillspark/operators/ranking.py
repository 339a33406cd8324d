"""Ranks, cut-offs and folds over scored instances (q_id, mention, en_id, fb_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(score: str = "score") -> list[Column]:
    return [F.desc(score), F.asc("mention"), F.asc("en_id")]


def rank_entities(df: DataFrame, entity: str = "fb_id") -> DataFrame:
    """W-01: rank = distinct entities seen so far, by falling score; a repeated entity takes the count so far."""
    first = F.row_number().over(Window.partitionBy("q_id", entity).orderBy(*_order())) == 1
    running = Window.partitionBy("q_id").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_first", first.cast("int")).withColumn("rank", F.sum("_first").over(running).cast("int")).drop("_first")


def top_k(df: DataFrame, k: int | None, entity: str = "fb_id") -> DataFrame:
    """W-02: rank_entities and those up to k; all if k is None."""
    ranked = rank_entities(df, entity)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def prune_delta(df: DataFrame) -> DataFrame:
    """W-03: rows by falling score while the gap to the next is the largest so far; up to two rows stay."""
    w = Window.partitionBy("q_id").orderBy(*_order())
    gaps = df.withColumns({"_rn": F.row_number().over(w), "_gap": F.col("score") - F.lead("score").over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("q_id"))})
    before = F.max("_gap").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = gaps.withColumn("_stop", F.coalesce(F.col("_gap") < before, F.lit(False)))
    gaps = gaps.withColumn("_at", F.min(F.when(F.col("_stop"), F.col("_rn"))).over(Window.partitionBy("q_id")))
    return gaps.where((F.col("_n") <= 2) | F.col("_at").isNull() | (F.col("_rn") < F.col("_at"))).drop("_rn", "_gap", "_n", "_stop", "_at")


def best_of_surface(held: DataFrame, k: int) -> DataFrame:
    """Of entries (surface, en_id, fb_id, score) those that can change which instances top_k gives a query.

    An instance ranks no better among a query's instances than among those of its surface. Those of rank k + 1 stay,
    as they tell that k other entities come before.
    """
    own = rank_entities(held.withColumn("q_id", F.col("surface")).withColumn("mention", F.col("surface")))
    return own.where(F.col("rank") <= k + 1).drop("q_id", "mention", "rank")


def floors(best: DataFrame, k: int) -> DataFrame:
    """Of best_of_surface() the surface and floor, the score at which k + 1 entities of it have come; null if it has fewer.

    Instances of a query below the largest floor of its mentions rank worse than k, as k + 1 entities come before.
    """
    own = rank_entities(best.withColumn("q_id", F.col("surface")).withColumn("mention", F.col("surface")))
    return own.groupBy("surface").agg(F.max(F.when(F.col("rank") > k, F.col("score"))).alias("floor"))


def above_floor(df: DataFrame) -> DataFrame:
    """df (score, floor: the largest of the query's, or null) without what floors() tells to rank worse."""
    return df.where(F.col("floor").isNull() | (F.col("score") >= F.col("floor"))).drop("floor")


def delta_levels(held: DataFrame) -> DataFrame:
    """Of entries (surface, score) the distinct scores with their rows, c, down to where prune_delta stops at the latest.

    A score below the best that has two rows has a gap of 0 behind a positive one, whatever other surfaces add.
    """
    w = Window.partitionBy("surface").orderBy(F.desc("score"))
    levels = held.groupBy("surface", "score").agg(F.count(F.lit(1)).alias("c")).withColumn("_at", F.row_number().over(w))
    done = F.max((F.col("_at") > 1) & (F.col("c") > 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return levels.withColumn("_done", F.coalesce(done, F.lit(False))).where("NOT _done").drop("_at", "_done")


def delta_floors(df: DataFrame) -> DataFrame:
    """W-03 over delta_levels() of a query's mentions (q_id, mention, _items of score and c): q_id, mention, floor.

    Rows above the floor stay; all, if it is null. A query's levels are folded in one row, so that none is sorted on disk.
    """
    levels = F.sort_array(F.flatten(F.collect_list("_items")), asc=False)
    one = df.groupBy("q_id").agg(F.collect_set("mention").alias("mention"), levels.alias("_levels"))

    def state(at: Column, level: Column, gap: Column, floor: Column, n: Column) -> Column:
        return F.named_struct(F.lit("at"), at, F.lit("level"), level, F.lit("gap"), gap, F.lit("floor"), floor, F.lit("n"), n)

    def step(s: Column, x: Column) -> Column:
        none, n, gap = F.lit(None).cast("double"), s["n"] + x["c"], s["at"] - x["score"]
        stop = lambda at: state(s["at"], s["level"], s["gap"], at, n)
        later = s["level"] > 1
        return (
            F.when(s["level"] == 0, state(x["score"], F.lit(1), F.lit(0.0), none, n))
            .when(s["floor"].isNotNull() | ((gap == 0) & ~later), stop(s["floor"]))
            .when(later & ((gap == 0) | (gap < s["gap"])), stop(s["at"]))
            .when(x["c"] > 1, stop(x["score"]))
            .otherwise(state(x["score"], s["level"] + 1, F.greatest(s["gap"], gap), none, n))
        )

    start = state(F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(None).cast("double"), F.lit(0).cast("long"))
    floor = F.aggregate("_levels", start, step, lambda s: F.when(s["n"] > 2, s["floor"]))
    return one.select("q_id", F.explode("mention").alias("mention"), floor.alias("floor"))


def above_delta(df: DataFrame) -> DataFrame:
    """df (score, floor of delta_floors()) without what prune_delta leaves out."""
    return df.where(F.col("floor").isNull() | (F.col("score") > F.col("floor"))).drop("floor")


def above(df: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """P-16: score at the threshold or above, or above it; null never."""
    return df.where(F.col("score") > threshold if strict else F.col("score") >= threshold)


def scaled(score: str, lo: str, hi: str) -> Column:
    """A-11: score to 0..1, 0.5 where all are equal."""
    return F.when(F.col(hi) == F.col(lo), F.lit(0.5)).otherwise((F.col(score) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0.0)))


def limits(rows: DataFrame) -> DataFrame:
    """rows (q_id, and lo, hi, floor: the limits of a mention, as far as there) with those of the query."""
    w = Window.partitionBy("q_id")
    ends = {c: f(c).over(w) for c, f in (("lo", F.min), ("hi", F.max), ("floor", F.max)) if c in rows.columns}
    return rows.withColumns(ends)


def min_max(df: DataFrame) -> DataFrame:
    """A-11: score to 0..1 within a query, 0.5 where all are equal."""
    ends = df.groupBy("q_id").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    return df.join(ends, "q_id").withColumn("score", scaled("score", "_lo", "_hi")).drop("_lo", "_hi")


def competition_rank(df: DataFrame, count: str, n: int | None = None) -> DataFrame:
    """W-04: equal counts share a rank and leave gaps; those up to n."""
    ranked = df.withColumn("rank", F.rank().over(Window.orderBy(F.desc(count))))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def best_of(df: DataFrame, k: int, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """W-05, K-02: the k best of each query; Spark cuts before the shuffle too."""
    w = Window.partitionBy("q_id").orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def folds(keys: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """W-06: distinct keys dealt to k folds in a pseudo-random order that depends on key and seed alone.

    k = -1 leaves one out: every key is its own fold. Keys are of any type; the order is
    that of 28 bits of the MD5 of seed and key, which other engines have too. Fold sizes
    differ by one at most.
    """
    text = F.concat(F.lit(f"{seed}-"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    mixed = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") * 8  # below 2**31, as numbered() wants
    one = numbered(keys.select(key).distinct(), mixed, key).withColumnRenamed("number", "fold")
    return one if k == -1 else one.withColumn("fold", F.pmod("fold", F.lit(k)).cast("int"))


def numbered(df: DataFrame, place: Column, tie: str, buckets: int = 1024) -> DataFrame:
    """df with number, from 0 in the order of place (0 to 2**31) and tie, without gathering rows in one task.

    Rows are numbered within ranges of place; a table of one row a range gives what comes before.
    """
    dealt = df.withColumn("_place", place).withColumn("_bucket", F.floor(F.col("_place") * buckets / F.lit(2147483648.0)).cast("int"))
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_place", tie)) - 1
    out = dealt.withColumn("_own", own).join(F.broadcast(before.drop("_n")), "_bucket")  # at most ``buckets`` rows
    return out.withColumn("number", F.col("_before") + F.col("_own")).drop("_place", "_bucket", "_own", "_before")


def fold_members(assigned: DataFrame, key: str, k: int) -> DataFrame:
    """M14: fold, key and mode (training or testing) for every fold."""
    every = assigned.select(key, F.col("fold").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return every.select("fold", key, F.when(F.col("own") == F.col("fold"), "testing").otherwise("training").alias("mode"))


def trec_run(df: DataFrame, run_id: str) -> DataFrame:
    """K-01: the best-scoring instance of each (q_id, fb_id), no null scores, as TREC columns."""
    ranked = rank_entities(df.where(F.col("score").isNotNull()))
    w = Window.partitionBy("q_id", "fb_id").orderBy(*_order())
    one = ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return one.select("q_id", F.lit("Q0").alias("q0"), "fb_id", "rank", "score", F.lit(run_id).alias("run"))
