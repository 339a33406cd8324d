"""Entity tables from triples (s, p, o array): redirects, surface forms, name variants, checks and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import is_disambiguation

LABEL, NAME, REDIRECT, SAME_AS = "<rdfs:label>", "<foaf:name>", "<dbo:wikiPageRedirects>", "<owl:sameAs>"


def flat(triples: DataFrame) -> DataFrame:
    return triples.select("s", "p", F.explode("o").alias("o"))


def inverse(triples: DataFrame, predicate: str = REDIRECT) -> DataFrame:
    """S-08: the predicate's inverse edges as !predicate."""
    return flat(triples.where(F.col("p") == predicate)).groupBy(F.col("o").alias("s")).agg(F.array_sort(F.collect_list("s")).alias("o")).select("s", F.lit("!" + predicate).alias("p"), "o")


def entities(triples: DataFrame) -> DataFrame:
    """P-12: subjects that have a label and are no disambiguation page; is_redirect beside."""
    marks = triples.groupBy("s").agg(F.bool_or(F.col("p") == LABEL).alias("has_label"), F.bool_or(F.col("p") == REDIRECT).alias("is_redirect"))
    return marks.where(F.col("has_label") & ~is_disambiguation(F.col("s"))).select(F.col("s").alias("en_id"), "is_redirect")


def surface_forms(triples: DataFrame, lowercase: bool = True) -> DataFrame:
    """A-05: surface, predicate, en_id, cnt: labels, redirects' labels for their targets, names of non-redirects."""
    rows = flat(triples)
    redirects = rows.where(F.col("p") == REDIRECT).select("s", F.col("o").alias("target"))
    labels = rows.where(F.col("p") == LABEL).select("s", F.col("o").alias("surface"))
    parts = [
        labels.join(redirects, "s", "left_anti").select("surface", F.lit(LABEL).alias("predicate"), F.col("s").alias("en_id")),
        labels.join(redirects, "s").select("surface", F.lit(REDIRECT).alias("predicate"), F.col("target").alias("en_id")),
        rows.where(F.col("p") == NAME).join(redirects, "s", "left_anti").select(F.col("o").alias("surface"), F.lit(NAME).alias("predicate"), F.col("s").alias("en_id")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    every = every.withColumn("surface", F.lower("surface")) if lowercase else every
    return every.groupBy("surface", "predicate", "en_id").agg(F.count(F.lit(1)).alias("cnt"))


def multi_valued(triples: DataFrame, predicate: str) -> DataFrame:
    """X-11: s, number and the first value of subjects with several values where one is due."""
    return triples.where((F.col("p") == predicate) & (F.size("o") > 1)).select("s", F.size("o").alias("n"), F.element_at("o", 1).alias("fixed"))


def single_valued(triples: DataFrame, predicate: str) -> DataFrame:
    """X-11: triples with the predicate cut to its first value."""
    return triples.withColumn("o", F.when(F.col("p") == predicate, F.slice("o", 1, 1)).otherwise(F.col("o")))


def name_variants(triples: DataFrame, predicate: str = LABEL) -> DataFrame:
    """X-12: lower-cased name to its URIs; a redirect's name stands for its target."""
    rows = flat(triples)
    target = rows.where(F.col("p") == REDIRECT).select("s", F.col("o").alias("target"))
    named = rows.where(F.col("p") == predicate).join(target, "s", "left").select(F.lower("o").alias("name"), F.coalesce("target", "s").alias("uri"))
    return named.groupBy("name").agg(F.array_sort(F.collect_set("uri")).alias("uris"))


def top_fields(triples: DataFrame, n: int | None) -> DataFrame:
    """A-04, W-04, K-13: predicate, subjects that have it, competition rank; ranks up to n."""
    counts = triples.groupBy(F.col("p").alias("field")).agg(F.countDistinct("s").alias("docs"))
    ranked = counts.withColumn("rank", F.rank().over(Window.orderBy(F.desc("docs"))))  # a row a predicate
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def wide(triples: DataFrame) -> DataFrame:
    """M5: en_id and a map from predicate to values."""
    return triples.groupBy(F.col("s").alias("en_id")).agg(F.map_from_entries(F.collect_list(F.struct("p", "o"))).alias("predicates"))


def lookup_name(forms: DataFrame, name: str) -> DataFrame:
    """J-12: what a lower-cased name may stand for, the most frequent first."""
    return forms.where(F.col("surface") == name.lower()).orderBy(F.desc("cnt"), "en_id")


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """K-12: counters incremented by new rows."""
    return old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def merge_lists(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """K-12: values appended to lists."""
    rows = old.select(*keys, F.explode(value).alias(value)).unionByName(new.select(*keys, F.explode(value).alias(value)))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(value))
