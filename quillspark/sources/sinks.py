"""Writers: evaluation runs, relevance files, instances, and learning formats, as one text column each.

Each function gives a DataFrame of lines (and what they are sorted by); write_lines puts
them into a folder of text files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.tables import shared_table


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Text files in the order of the columns given: ranges are sorted apart, so that no task gets all."""
    lines = lines.orderBy(*order) if order else lines
    lines.select("value").write.mode("overwrite").text(path)


def _tabs(*columns: Column | str, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])


def trec_lines(run: DataFrame, sep: str = "\t") -> DataFrame:
    """K-01, K-02: run has q_id, q0, fb_id or doc_id, rank, score, run."""
    entity = "fb_id" if "fb_id" in run.columns else "doc_id"
    return run.select("q_id", "rank", _tabs("q_id", F.lit("Q0"), entity, "rank", "score", "run", sep=sep).alias("value"))


def set_run(sets: DataFrame) -> DataFrame:
    """K-03: q_id, score and fbs of target-1 sets, by falling score; of equal entity sets of a query the best."""
    keyed = sets.where(F.col("target") == "1").withColumn("fbs", F.array_sort("fbs")).withColumn("key", F.array_join("fbs", "|"))
    w = Window.partitionBy("q_id", "key").orderBy(F.desc("score"))
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("q_id", "score", "fbs")


def set_lines(sets: DataFrame) -> DataFrame:
    """K-03: q_id, score and the entities, tab-separated."""
    return set_run(sets).select("q_id", (-F.col("score")).alias("neg_score"), _tabs("q_id", "score", F.array_join("fbs", "\t")).alias("value"))


def protocol_rows(sets: DataFrame) -> DataFrame:
    """K-04: q_id, set_id (from 0, by falling score), fb_id, mention, score of each member of the target-1 sets."""
    unique = sets.where(F.col("target") == "1").withColumn("key", F.array_join(F.array_sort(F.transform("members", lambda m: m["fb_id"].cast("string"))), "|"))
    one = unique.withColumn("_rn", F.row_number().over(Window.partitionBy("q_id", "key").orderBy(F.desc("score")))).where("_rn = 1")
    numbered = one.withColumn("set_id", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "key")) - 1)
    return numbered.select("q_id", "set_id", "score", F.explode("members").alias("m")).select("q_id", "set_id", "m.fb_id", "m.mention", "score")


def qrel_rows(truth: DataFrame, entity: str = "fb_id") -> DataFrame:
    """K-05, K-06: distinct q_id, iter, entity, rel of target 1."""
    return truth.where(F.col("target") == "1").select("q_id", F.lit("0").alias("iter"), F.col(entity).alias("doc_id"), F.lit(1).alias("rel")).distinct()


def qrel_sets(queries: DataFrame, truth: DataFrame, entity: str = "fb_id") -> DataFrame:
    """K-07: q_id, set_id, label and ens of every set; a query without any has one row with nulls."""
    sets = truth.groupBy("q_id", "set_id").agg(F.array_sort(F.collect_set(F.col(entity).cast("string"))).alias("ens"))
    return queries.select("q_id").distinct().join(sets, "q_id", "left").withColumn("label", F.when(F.col("set_id").isNotNull(), F.lit("1")))


def qrel_set_lines(rows: DataFrame) -> DataFrame:
    bare = F.col("q_id").cast("string")
    return rows.select("q_id", "set_id", F.when(F.col("ens").isNull(), bare).otherwise(_tabs("q_id", "label", F.array_join("ens", "\t"))).alias("value"))


def _sorted_features() -> Column:
    return F.array_sort(F.map_entries("features"))


def instance_lines(instances: DataFrame) -> DataFrame:
    """K-08: id, target, name:value of sorted features, tab-separated."""
    pairs = F.transform(_sorted_features(), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return instances.select("id", _tabs("id", "target", F.array_join(pairs, "\t")).alias("value"))


def instance_json(instances: DataFrame) -> DataFrame:
    """K-08: a JSON object a line, id with target, features and properties."""
    body = F.struct("target", "features", "properties") if "properties" in instances.columns else F.struct("target", "features")
    return instances.select("id", F.to_json(F.create_map(F.col("id").cast("string"), body)).alias("value"))


def add_qids(instances: DataFrame, by: str) -> DataFrame:
    """K-10: a dense number from 1 for each distinct value of by, in its order."""
    distinct = instances.select(by).distinct()
    spread = distinct.withColumn("_k", F.col(by))
    numbers = spread.repartitionByRange("_k").sortWithinPartitions("_k").withColumn("_part", F.spark_partition_id())
    numbers = shared_table(instances.sparkSession, numbers.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy("_k"))), "qids")
    before = numbers.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    qids = numbers.join(before, "_part").select(by, (F.col("_before") + F.col("_own")).alias("qid"))
    return instances.join(qids, by)


def libsvm_lines(instances: DataFrame) -> DataFrame:
    """K-09: target qid:q 1:v 2:v ... # id, features by sorted name; instances have qid."""
    values = F.transform(_sorted_features(), lambda e, i: F.concat_ws(":", (i + 1).cast("string"), e["value"].cast("string")))
    return instances.select("qid", "id", F.concat_ws(" ", "target", F.concat(F.lit("qid:"), F.col("qid").cast("string")), F.array_join(values, " "), F.lit("#"), F.col("id").cast("string")).alias("value"))


def score_lines(scored: DataFrame) -> DataFrame:
    """K-11: id and score with 30 decimals."""
    return scored.select("id", F.concat_ws("\t", F.col("id").cast("string"), F.format_string("%.30f", F.col("score"))).alias("value"))


def query_eval_lines(per_query: DataFrame) -> DataFrame:
    """K-16."""
    return per_query.select("q_id", _tabs("q_id", "precision", "recall", "f1").alias("value"))
