"""Candidate generation: n-gram lookups, commonness, and their unions, filters and back-offs.

Shapes: queries (q_id, q_content); surface forms (surface, predicate, en_id, cnt);
candidates (q_id, mention, n, en_id, commonness, matches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import ngrams, runs, session_of, words
from quillspark.sources.tables import shared_table, small

ANNOTATED = ["facc09", "facc12"]


def mentions(queries: DataFrame, most: int | None = None) -> DataFrame:
    """M3: distinct n-grams of each query (of most words, if given), with their length."""
    return queries.select("q_id", F.explode(ngrams(F.col("q_content"), most)).alias("g")).select("q_id", "g.mention", "g.n").distinct()


def commonness(surface_forms: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """J-02, J-03: surface, en_id, cnt and cnt over the surface's total, the predicates' counts added."""
    counts = surface_forms.where(F.col("predicate").isin(predicates or ANNOTATED)).groupBy("surface", "en_id").agg(F.sum("cnt").alias("cnt"))
    # Totals by aggregation, not by a window: a frequent surface is reduced before the shuffle.
    totals = counts.groupBy("surface").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "surface").select("surface", "en_id", "cnt", (F.col("cnt") / F.col("total")).alias("commonness"))


def entries(surface_forms: DataFrame, threshold: float | None, common: DataFrame | None = None, annotated: list[str] | None = None) -> DataFrame:
    """J-01, J-04 to J-08 by surface form: surface, en_id, commonness and matches (entities of the surface).

    Entities of annotated predicates at the threshold or above, and all of the other predicates, whose commonness
    may be 0. A mention's candidates are those of the surface that it equals, whatever the query, so that they are
    found once a surface.
    """
    spark = surface_forms.sparkSession
    common = common if common is not None else commonness(surface_forms, annotated)
    other = surface_forms.where(~F.col("predicate").isin(annotated or ANNOTATED)).select("surface", "en_id").distinct().withColumn("_other", F.lit(True))
    both = common.select("surface", "en_id", "commonness").join(other, ["surface", "en_id"], "full")
    both = both.where(F.coalesce(F.col("commonness") >= (threshold or 0.0), F.lit(False)) | F.col("_other").isNotNull())
    both = shared_table(spark, both.select("surface", "en_id", F.coalesce("commonness", F.lit(0.0)).alias("commonness")), "matches")
    counts = both.groupBy("surface").agg(F.count(F.lit(1)).alias("matches"))
    return shared_table(spark, both.join(counts, "surface"), "entries")


def said(queries: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of queries with mention, once for every distinct n-gram of the row, of the lengths that held (surface) has."""
    sizes = held.select(F.size(words(F.col("surface"))).alias("n")).where("n > 0").distinct()
    lengths = sorted(r.n for r in sizes.collect())  # other n-grams match nothing
    grams = [runs(F.col("_words"), n) for n in lengths] or [F.array().cast("array<string>")]
    rows = queries.select("*", words(F.col("q_content")).alias("_words"))
    return rows.select("*", F.explode(F.array_distinct(F.concat(*grams))).alias("mention")).drop("_words")


def met(rows: DataFrame, held: DataFrame, once: tuple = ("matches",), by: tuple = (), packed: bool = False, together: bool = False) -> DataFrame:
    """rows (mention, and the columns by) joined with held (surface, by) by equality; rows stay where they are if held is small.

    once: columns of held that a surface has one value of. All others are packed to arrays, of 4,096 about at most,
    so that the join makes no more rows than there are mentions; they are unpacked behind it, or left as _items if packed.
    together: rows of a partition are brought in the order of their mentions before, so that what is written repeats a
    surface's entities next to each other, which takes a fraction of the space.
    """
    once = [c for c in once if c in held.columns]
    values = [c for c in held.columns if c not in ("surface", *by, *once)]
    keys = ["surface", *by]
    if values:
        sizes = held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        dealt = held.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64(*values), F.ceil(F.col("_n") / 4096)))
        held = dealt.groupBy(*keys, *once, "_part").agg(F.collect_list(F.struct(*values)).alias("_items")).drop("_part")
    held = shared_table(rows.sparkSession, held.withColumnRenamed("surface", "mention"), "surfaces")
    size = F.length("mention") + 64 + 8 * len(once)
    if together:  # mentions of no surface are not sorted; Spark drops a sort below a join, but for a condition that it can't move
        rows = rows.join(small(held.select("mention"), F.length("mention") + 64), "mention", "left_semi")
        rows = rows.sortWithinPartitions("mention").where(F.spark_partition_id() >= 0)
    out = rows.join(small(held, size + F.size("_items") * (16 + 8 * len(values)) if values else size), ["mention", *by])
    return out.select("*", F.explode("_items").alias("_item")).select("*", "_item.*").drop("_items", "_item") if values and not packed else out


def linked(queries: DataFrame, held: DataFrame, unique: bool = False, together: bool = False) -> DataFrame:
    """J-01: columns of queries with mention, n (its words) and held's columns (surface, matches and others but for surface).

    unique: whether each q_id is there once. Then nothing is shuffled, if held is small, and what queries is
    partitioned by stays. Else only q_id is kept of queries, and the n-grams of its rows are merged. together: as in met().
    """
    rows = said(queries if unique else queries.select("q_id", "q_content"), held)
    if not unique:
        rows = rows.join(held.select(F.col("surface").alias("mention")).distinct(), "mention", "left_semi").select("q_id", "mention").distinct()
    return met(rows, held, together=together).withColumn("n", F.size(F.split("mention", " ")))


def candidates(queries: DataFrame, surface_forms: DataFrame, threshold: float | None = 0.1, kb: DataFrame | None = None, common: DataFrame | None = None, annotated: list[str] | None = None) -> DataFrame:
    """J-07, J-08, J-09: candidates of every mention; matches counts them before the filter on kb (en_id).

    common: commonness() of the surface forms, if at hand. annotated: predicates whose counts make commonness;
    ["anchor"] links by the anchors of a wiki and its titles and redirects (J-06).
    """
    held = within(entries(surface_forms, threshold, common, annotated), kb)
    return linked(queries, held).select("q_id", "mention", "n", "en_id", "commonness", "matches")


def within(held: DataFrame, kb: DataFrame | None) -> DataFrame:
    """J-09: held without entities that kb (en_id) has not."""
    return held.join(kb.select("en_id").distinct(), "en_id", "left_semi") if kb is not None else held


def longest_match(found: DataFrame) -> DataFrame:
    """J-13: only the candidates of the longest length that has any; score is their commonness."""
    return longest(found).withColumn("score", F.col("commonness"))


def longest(found: DataFrame) -> DataFrame:
    """J-13: the rows (q_id, n) of the longest length that a query has."""
    return found.withColumn("_n", F.max("n").over(Window.partitionBy("q_id"))).where("n = _n").drop("_n")


def same_as(pairs: DataFrame, redirects: DataFrame) -> DataFrame:
    """J-10: for each fb_uri of (fb_uri, dbp_uri, pos) its first entity that is no redirect; a lone one as it is; else null."""
    marked = pairs.join(redirects.select("dbp_uri", F.lit(True).alias("r")).distinct(), "dbp_uri", "left")
    first = F.min(F.when(F.col("r").isNull(), F.struct("pos", "dbp_uri")))["dbp_uri"]
    return marked.groupBy("fb_uri").agg(F.when(F.count(F.lit(1)) == 1, F.first("dbp_uri")).otherwise(first).alias("dbp_uri"))


def first_same_as(pairs: DataFrame) -> DataFrame:
    """J-11: for each dbp_uri of (dbp_uri, uri, pos) the first <fb: value."""
    return pairs.where(F.col("uri").startswith("<fb:")).groupBy("dbp_uri").agg(F.min_by("uri", "pos").alias("fb_uri"))


def instances(found: DataFrame) -> DataFrame:
    """J-14: candidates as numbered instances, in the order of query, mention and entity; a session that they have stays."""
    key = F.concat_ws("|", F.col("q_id").cast("string"), "mention", F.col("en_id").cast("string"))
    out = found.withColumn("id", key)
    return out if "session" in found.columns else out.withColumn("session", session_of(F.col("q_id").cast("string")))


def add_match_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """The total order of ties: score falling, then mention, then entity."""
    return df.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "mention", "en_id")))


def lookup(keys: DataFrame, key: str, pairs: DataFrame, value: str) -> DataFrame:
    """J-12: keys with the value that pairs (key, value) have for them, null if none."""
    return keys.join(pairs.select(key, value), key, "left")


def with_redirects(keys: DataFrame, key: str, redirects: DataFrame) -> DataFrame:
    """J-12: keys with is_redirect; redirects: one column of that name."""
    return keys.join(redirects.select(key).distinct().withColumn("_r", F.lit(True)), key, "left").withColumn("is_redirect", F.coalesce("_r", F.lit(False))).drop("_r")
