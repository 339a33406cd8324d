"""Readers: query logs, annotations, knowledge-base dumps, annotated corpora, instances, evaluation files.

All schemas are stated; nothing is inferred. Files are read by Spark alone.
"""

from __future__ import annotations

import contextlib
import dataclasses
import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import query_content, unescape_key, wiki_url_to_uri

_OWN: dict[str, str] = {}
_OWNERS: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Owns the tables that are written to the shared folder inside of it, and deletes them at its end.

    What is wanted of them must have been computed by then.
    """
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir; a temporary one in local tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.applicationId not in _OWN:
            _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        base = _OWN[spark.sparkContext.applicationId]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def shared_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and scanned again."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, size: Column, most: int = 64 << 20) -> DataFrame:
    """df, broadcast in joins if size (bytes a row) adds up to most or less; else Spark chooses."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def _tsv(spark: SparkSession, path: str, columns: list[str], header: bool = False, **options) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.options(sep="\t", quote="", header=header, enforceSchema=True, **options).schema(schema).csv(path)


def _last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the one that comes last in the file."""
    others = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *others)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def read_queries(spark: SparkSession, path: str, process: bool = True) -> DataFrame:
    """S-01: q_id (first column) and q_content (last column); of repeated ids the last; P-02 if process."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where("trim(value) != ''")
    cells = F.split("value", "\t")
    out = _last_by(lines.select("_at", cells[0].alias("q_id"), F.element_at(cells, -1).alias("q_content")), "q_id", "_at")
    return out.withColumn("q_content", query_content(F.col("q_content"))) if process else out


def parse_annotations(spark: SparkSession, path: str, queries: DataFrame, same_as: DataFrame) -> DataFrame:
    """S-02: annotations (q_id, set_id, fb_id, mention, label) of known queries whose entity has a URI (fb_id, en_id)."""
    rows = _tsv(spark, path, ["q_id", "set_id", "fb_id", "mention", "target"])
    return rows.join(queries, "q_id").join(same_as, "fb_id")


def unknown_annotations(spark: SparkSession, path: str, same_as: DataFrame) -> DataFrame:
    """S-02: annotations whose entity has no URI."""
    return _tsv(spark, path, ["q_id", "set_id", "fb_id", "mention", "target"]).join(same_as, "fb_id", "left_anti")


def read_headed_queries(spark: SparkSession, path: str) -> DataFrame:
    """S-03: qid and query of a table with a header, whatever other columns it has; of repeated ids the last."""
    raw = spark.read.options(sep="\t", quote="", header=True, inferSchema=False).csv(path).withColumn("_at", F.monotonically_increasing_id())
    return _last_by(raw.select("_at", F.col("qid").alias("q_id"), F.col("query").alias("q_content")), "q_id", "_at").withColumn("q_content", query_content(F.col("q_content")))


def read_set_annotations(spark: SparkSession, path: str) -> DataFrame:
    """S-04: rows with an entity of difficulty, qid, query, mention, entity, set_id, freebase_id."""
    cols = ["difficulty", "q_id", "q_content", "mention", "en_id", "set_id", "fb_id"]
    return _tsv(spark, path, cols, header=True).where(F.trim(F.coalesce("en_id", F.lit(""))) != "")


def read_entity_annotations(spark: SparkSession, path: str) -> DataFrame:
    """S-05: rows with a freebase_id of qid, query, mention, entity, target, freebase_id."""
    cols = ["q_id", "q_content", "mention", "en_id", "target", "fb_id"]
    return _tsv(spark, path, cols, header=True).where(F.trim(F.coalesce("fb_id", F.lit(""))) != "")


def read_session_xml(spark: SparkSession, path: str) -> DataFrame:
    """S-06: q_id (session_k), q_content, mention, en_id, target of sessions; a query without annotation has nulls."""
    schema = "_id string, query array<struct<text:string,annotation:array<struct<_main:string,span:string,target:string>>>>"
    sessions = spark.read.format("xml").option("rowTag", "session").schema(schema).load(path)
    queries = sessions.select("_id", F.posexplode("query").alias("k", "q"))
    rows = queries.select(F.concat("_id", F.lit("_"), F.col("k") + 1).alias("q_id"), F.col("q.text").alias("q_content"), F.explode_outer("q.annotation").alias("a"))
    return rows.select("q_id", "q_content", F.col("a.span").alias("mention"), wiki_url_to_uri(F.col("a.target")).alias("en_id"), F.when(F.col("a._main") == "true", "1").otherwise("0").alias("target"))


_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, paths: list[str], prefixes: dict[str, str], reverse: bool = False, predicate_prefix: str = "") -> DataFrame:
    """S-07, S-09: s, p, o (arrays of values), of plain or compressed N-Triples files in order.

    URIs are shortened by prefixes, literals lose their quotes and tags, empty ones are
    dropped; values stay in the order of the file; reverse swaps subject and object, predicate_prefix marks the predicates. If
    several files give a subject and predicate, the last file's values stay.
    """
    from quillspark.functions.text import prefixed

    out = None
    for order, path in enumerate(paths):
        # A line's place: its file, the block of the file that it was read in, and its number there.
        place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
        lines = spark.read.text(path).select("value", place.alias("place")).where(~F.col("value").startswith("#"))
        part = lambda k: F.regexp_extract("value", _TRIPLE, k)
        rows = lines.where(F.col("value").rlike(_TRIPLE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), "place")
        rows = rows.withColumn("literal", F.col("o").startswith('"')).withColumn("o", F.when(F.col("literal"), F.regexp_extract("o", r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(F.col("o")))
        rows = rows.where("NOT literal OR trim(o) != ''").withColumns({c: prefixed(F.col(c), prefixes) for c in ("s", "p")})
        rows = rows.withColumn("o", F.when(F.col("literal"), F.col("o")).otherwise(prefixed(F.col("o"), prefixes)))
        s, o = ("o", "s") if reverse else ("s", "o")
        rows = rows.select(F.col(s).alias("s"), F.concat(F.lit(predicate_prefix), F.col("p")).alias("p"), F.col(o).alias("o"), F.lit(order).alias("file"), "place")
        out = rows if out is None else out.unionByName(rows)
    last = out.groupBy("s", "p").agg(F.max("file").alias("file"))
    return out.join(last, ["s", "p", "file"]).groupBy("s", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "o"))), lambda x: x["o"]).alias("o"))


def read_surface_counts(spark: SparkSession, path: str, predicate: str = "facc12", lowercase: bool = True, glob: str = "*.tsv") -> DataFrame:
    """S-10: surface, predicate, en_uri, cnt summed over all files below path whose names match."""
    rows = spark.read.options(sep="\t", quote="", recursiveFileLookup=True, pathGlobFilter=glob).schema("surface string, fb_id string, cnt long").csv(path)
    surface = F.lower("surface") if lowercase else F.col("surface")
    from quillspark.functions.text import freebase_id_to_uri

    rows = rows.select(surface.alias("surface"), F.lit(predicate).alias("predicate"), freebase_id_to_uri(F.col("fb_id"), strict=False).alias("en_uri"), "cnt").where("en_uri IS NOT NULL")
    return rows.groupBy("surface", "predicate", "en_uri").agg(F.sum("cnt").alias("cnt"))


def read_annotated_corpus(spark: SparkSession, path: str) -> DataFrame:
    """S-11: distinct doc_id and fb_id: columns 0 and 7 of all files below path."""
    schema = ", ".join(f"c{i} string" for i in range(8))
    rows = spark.read.options(sep="\t", quote="", recursiveFileLookup=True).schema(schema).csv(path)
    return rows.select(F.col("c0").alias("doc_id"), F.col("c7").alias("fb_id")).where("doc_id IS NOT NULL AND fb_id IS NOT NULL").distinct()


INSTANCE = "map<string,struct<target:string,features:map<string,double>,properties:map<string,string>>>"


def read_instances(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S-12: id, target, features, properties of JSON objects by id: one a file, or one a line, which splits."""
    text = spark.read.option("wholetext", not lines).text(path)
    return text.select(F.explode(F.from_json("value", INSTANCE)).alias("id", "i")).select("id", "i.target", "i.features", "i.properties")


def merge_instances(spark: SparkSession, features: str, feature_names: list[str], properties: str, property_names: list[str], targets: str) -> DataFrame:
    """S-13: three tables with headers merged on id; a header that differs from the names raises."""

    def one(path: str, names: list[str]) -> DataFrame:
        head = spark.read.text(path).first()
        if head is None or head[0].split("\t") != ["id", *names]:
            raise ValueError(f"{path}: the header is not id and {names}")
        return _tsv(spark, path, ["id", *names], header=True)

    f, p, t = one(features, feature_names), one(properties, property_names), one(targets, ["target"])
    as_map = lambda names, kind: F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast(kind) for n in names]))
    f, p = f.select("id", as_map(feature_names, "double").alias("features")), p.select("id", as_map(property_names, "string").alias("properties"))
    return f.join(p, "id", "full").join(t, "id", "full")


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """S-14: distinct ids of the first of two columns."""
    return _tsv(spark, path, ["fb_id", "dbp_uri"]).select("fb_id").where("fb_id IS NOT NULL").distinct()


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    """S-15: the rows of a key; the filter reaches the scan. All rows and their number are df and df.count()."""
    return df.where(F.col(key) == value)


def unescaped_keys(df: DataFrame, key: str) -> DataFrame:
    """S-15: keys of a document store as they were before they were escaped."""
    return df.withColumn(key, unescape_key(F.col(key)))


def read_ragged(spark: SparkSession, path: str, scored: bool = False) -> DataFrame:
    """S-16, M16: q_id, label and ens of lines of any number of cells; blank lines are skipped."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) != ''").select(cells.alias("c"))
    rest = F.when(F.size("c") > 2, F.slice("c", 3, F.size("c"))).otherwise(F.array().cast("array<string>"))
    label = F.get("c", F.lit(1))
    return rows.select(F.col("c")[0].alias("q_id"), (label.cast("double") if scored else label).alias("score" if scored else "label"), rest.alias("ens"))


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 4)
    return rows.select(F.col("c")[0].alias("q_id"), F.col("c")[2].alias("doc_id"), F.col("c")[3].cast("int").alias("rel")).where("rel > 0")


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c")).where(F.size("c") >= 6)
    return rows.select(F.col("c")[0].alias("q_id"), F.col("c")[2].alias("doc_id"), F.col("c")[3].cast("int").alias("rank"), F.col("c")[4].cast("double").alias("score"), F.col("c")[5].alias("run"))


@dataclass
class RetrievalConfig:
    """S-17: a retrieval run; unknown or missing keys raise."""

    index_dir: str
    query_file: str
    output_file: str
    run_id: str
    model: str = "lm"
    num_docs: int = 100
    first_pass_num_docs: int = 10_000
    first_pass_field: str = "contents"
    smoothing_method: str = "jm"
    smoothing_param: float = 0.1
    field: str = "contents"
    field_weights: dict = dataclasses.field(default_factory=lambda: {"contents": 1.0})

    @classmethod
    def from_json(cls, text: str) -> RetrievalConfig:
        return cls(**json.loads(text))


def read_json_queries(spark: SparkSession, path: str) -> DataFrame:
    """S-17: q_id and q_content of a JSON list of query_id and query."""
    rows = spark.read.schema("query_id string, query string").option("multiLine", True).json(path)
    return rows.select(F.col("query_id").alias("q_id"), F.col("query").alias("q_content"))


def toy_documents(spark: SparkSession) -> DataFrame:
    """S-18: five small documents with title, content, and both as contents."""
    rows = [(1, "night train", "a train that runs at night"), (2, "day boat", "boats cross the lake by day"), (3, "lake", "water with land all around"), (4, "night", "the dark part of a day"), (5, "train set", "a small train for the table")]
    return spark.createDataFrame(rows, "doc_id int, title string, content string").withColumn("contents", F.concat_ws(" ", "title", "content"))


def long_fields(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Columns as rows of doc_id, field, value."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("string") for f in fields]))).alias("field", "value"))


def newest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """K-12: overwriting upserts: of rows that share a key the one of the largest order."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
