"""How the driver's tables stand for the engine's inputs, in Spark and in SQL.

Entities are parts (title: name and number of the brand; knowledge-base snapshot p_size
<= 25), surface counts are their line items, a query is what an order holds (every
order), the annotated corpus is suppliers in orders, the fielded index is over whole
documents (and their capitalised words), and whole benchmark texts are retrieval queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.numbers import rounded
from quillspark.functions.text import ANALYSER_STOP_WORDS, plain, query_content
from quillspark.sources.tables import shared_path, shared_table, small

#: Commonness from which a mention links an entity.
THRESHOLD = 0.03
#: Candidates of a partition whose task sorts them all, or only writes them (some 100 MB).
SORTED, WRITTEN = 4e5, 1e7
WEIGHTS = {"names": 0.2, "contents": 0.8}
_INDEXES: dict = {}
#: Groups of a task from which collecting aggregates sort (and spill) all its rows; a partition of queries() has some 50,000.
_FALLBACK = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def title() -> Column:
    """A part's title, as it is written."""
    return F.concat_ws(" ", "p_name", F.substring("p_brand", 7, 10))


def queries(spark, sf, partitions: int | None = None) -> DataFrame:
    """Every order: the titles of its parts in the order of its lines. Partitioned by q_id; only keys of lines are shuffled.

    Lines that agree in number and part say the same title, so that their suppliers need not be known.
    """
    parts = table(spark, sf, "part").select("p_partkey", title().alias("title")).withColumn("plain", plain(F.col("title")))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = max(partitions or 0, int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // 200_000)
    if int(spark.conf.get(_FALLBACK)) < 100_000:
        spark.conf.set(_FALLBACK, "100000")
    q_id = F.concat(F.lit("o_"), F.col("l_orderkey").cast("string"))  # made again behind the shuffle: numbers are shorter
    lines = lines.repartition(n, q_id).select(q_id.alias("q_id"), "l_linenumber", "l_partkey")
    held = lines.join(small(parts, F.length("title") + 32), F.col("l_partkey") == F.col("p_partkey"))
    names = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "title")))["title"]  # a few lines an order
    texts = held.groupBy("q_id").agg(F.array_join(names, " ").alias("text"), F.min("plain").alias("plain"))
    return texts.select("q_id", F.when(F.col("plain"), F.lower("text")).otherwise(query_content(F.col("text"))).alias("q_content"))


#: The same title in SQL.
TITLE = "p_name || ' ' || substr(p_brand, 7)"
Q = f"""q AS MATERIALIZED (
  SELECT 'o_' || l_orderkey AS q_id, lower(string_agg({TITLE}, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey)) AS q_content
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey
)"""
GRAMS = """qw AS (
  SELECT q_id, q_content, string_split(q_content, ' ') AS w FROM q
), qn AS (
  SELECT *, unnest(range(1, len(w) + 1)) AS n FROM qw
), grams AS (
  SELECT q_id, q_content, CAST(n AS INTEGER) AS n, CAST(i AS INTEGER) AS start, array_to_string(w[i + 1 : i + n], ' ') AS mention
  FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM qn)
), men AS MATERIALIZED (
  SELECT DISTINCT q_id, q_content, n, mention FROM grams
)"""


def surface_forms(spark, sf) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", F.lower(title()).alias("surface"))
    lines = table(spark, sf, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.count(F.lit(1)).alias("cnt"))
    linked = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("surface", F.when(F.col("l_linestatus") == "F", "facc09").otherwise("facc12").alias("predicate"), F.col("p_partkey").alias("en_id"), "cnt")
    return linked.unionByName(parts.select("surface", F.lit("<rdfs:label>").alias("predicate"), F.col("p_partkey").alias("en_id"), F.lit(1).cast("long").alias("cnt")))


SF = f"""sf AS MATERIALIZED (
  SELECT lower({TITLE}) AS surface, CASE WHEN l_linestatus = 'F' THEN 'facc09' ELSE 'facc12' END AS predicate, p_partkey AS en_id, count(*) AS cnt
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
  UNION ALL SELECT lower({TITLE}), '<rdfs:label>', p_partkey, 1 FROM part
)"""
COMMON = """cm AS MATERIALIZED (
  SELECT surface, en_id, CAST(sum(cnt) AS BIGINT) AS cnt, CAST(sum(cnt) AS DOUBLE) / sum(sum(cnt)) OVER (PARTITION BY surface) AS commonness
  FROM sf WHERE predicate IN ('facc09', 'facc12') GROUP BY surface, en_id
)"""
CAND = f"""fa AS MATERIALIZED (
  SELECT q_id, q_content, mention, n, en_id, commonness FROM men JOIN cm ON surface = mention WHERE commonness >= {THRESHOLD}
), db AS (
  SELECT DISTINCT m.q_id, m.q_content, m.mention, m.n, s.en_id FROM men m JOIN sf s ON s.surface = m.mention
  WHERE predicate = '<rdfs:label>' AND NOT EXISTS (SELECT 1 FROM fa WHERE fa.q_id = m.q_id AND fa.mention = m.mention AND fa.en_id = s.en_id)
), un AS (
  SELECT * FROM fa UNION ALL SELECT db.*, coalesce(cm.commonness, 0) FROM db LEFT JOIN cm ON cm.surface = db.mention AND cm.en_id = db.en_id
), cand AS MATERIALIZED (
  SELECT *, count(*) OVER (PARTITION BY q_id, mention) AS matches FROM un
)"""
#: Instances: candidates with a Freebase id for every two parts, scored by rounded commonness.
INST = "inst AS (SELECT q_id, q_content, mention, n, en_id, en_id // 2 AS fb_id, round(commonness, 6) AS score, round(commonness, 6) AS commonness, matches FROM cand)"
ALL = f"WITH {Q}, {GRAMS}, {SF}, {COMMON}, {CAND}, {INST}"


def kb(spark, sf) -> DataFrame:
    return table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("en_id"))


def entries(spark, sf) -> DataFrame:
    """surface, en_id, commonness, matches of all titles."""
    from quillspark.operators.candidates import entries

    return entries(shared_table(spark, surface_forms(spark, sf), "forms"), THRESHOLD)


def dealt(lines: int, each: float, rows: float = SORTED) -> int:
    """Partitions of queries() of so many lines, with each so many rows a line: rows in one, 2,000 lines at least.

    So a task's rows are sorted in memory: two sorts at once of rows of 100 bytes take 80 MB or so.
    """
    return round(min(lines * each / rows, lines / 2e3))


def asked(spark, sf, held: DataFrame, rows: float = SORTED) -> DataFrame:
    """queries() in partitions of so many candidates of held (matches), as dealt() says."""
    return queries(spark, sf, dealt(table(spark, sf, "lineitem").count(), held.agg(F.avg("matches")).first()[0] or 0, rows))


def found(spark, sf, held: DataFrame | None = None, sorts: bool = False, written: bool = False) -> DataFrame:
    """Candidates with q_content; held: entries, or some of them. Partitioned by q_id.

    sorts: whether all candidates of a query are sorted then; partitions are so many as dealt() says. written: whether
    they are returned as they are; those of a mention come together then.
    """
    from quillspark.operators.candidates import linked

    held = held if held is not None else entries(spark, sf)
    some = asked(spark, sf, held, WRITTEN if written else SORTED) if sorts or written else queries(spark, sf)
    return linked(some, held, unique=True, together=written)


def spoken(spark, sf) -> DataFrame:
    """q_id, q_content, mention, n and matches of all mentions that have candidates."""
    return found(spark, sf, entries(spark, sf).select("surface", "matches").distinct())


def scored(held: DataFrame) -> DataFrame:
    """Entries as instances that are scored by commonness."""
    score = rounded("commonness", 6)
    return held.select("surface", "en_id", F.floor(F.col("en_id") / 2).cast("long").alias("fb_id"), score.alias("score"), score.alias("commonness"), "matches")


def instances(spark, sf, held: DataFrame | None = None, sorts: bool = False) -> DataFrame:
    """held: scored entries, or some of them."""
    c = found(spark, sf, held if held is not None else scored(entries(spark, sf)), sorts)
    return c.select("q_id", "q_content", "mention", "n", "en_id", "fb_id", "score", "commonness", "matches")


def field_values(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    names = F.array_join(F.regexp_extract_all(text, F.lit("([A-Z][a-z]+)"), F.lit(1)), " ")
    parts = [docs.select("doc_id", F.lit("contents").alias("field"), text.alias("value")), docs.select("doc_id", F.lit("names").alias("field"), names.alias("value"))]
    return parts[0].unionAll(parts[1])


def retrieval_queries(spark, sf) -> DataFrame:
    """All words of each benchmark text."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), F.array_join(w, " ").alias("q_content"))


_STOP = str(ANALYSER_STOP_WORDS)
INDEX = f"""vals AS (
  SELECT doc_id, 'contents' AS field, coalesce(text, '') AS value FROM documents
  UNION ALL SELECT doc_id, 'names', array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'), ' ') FROM documents
), toks AS (
  SELECT doc_id, field, term FROM (SELECT doc_id, field, unnest(regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}]+')) AS term FROM vals) WHERE NOT list_contains({_STOP}, term)
), post AS MATERIALIZED (
  SELECT doc_id, field, term, count(*) AS tf FROM toks GROUP BY ALL
), lens AS MATERIALIZED (
  SELECT doc_id, field, count(*) AS len FROM toks GROUP BY ALL
), terms AS MATERIALIZED (
  SELECT field, term, CAST(sum(tf) AS BIGINT) AS ctf, count(*) AS df FROM post GROUP BY ALL
), flds AS (
  SELECT field, CAST(sum(len) AS BIGINT) AS clen, count(*) AS docs, avg(len) AS avg_len FROM lens GROUP BY ALL
), rq AS (
  SELECT item_id AS q_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark
), qall AS (
  SELECT q_id, unnest(w) AS term FROM rq
), qt0 AS (
  SELECT q_id, term, count(*) AS qtf FROM qall WHERE NOT list_contains({_STOP}, term) GROUP BY ALL
), qt AS (
  SELECT *, CAST(sum(qtf) OVER (PARTITION BY q_id) AS BIGINT) AS q_len FROM qt0
), wqt AS (
  SELECT q_id, term, count(*) AS qtf, (SELECT len(w) FROM rq WHERE rq.q_id = qall.q_id) AS q_len FROM qall GROUP BY ALL
)"""


def index(spark, sf):
    """The index of a session's tables, built and written once."""
    from quillspark.operators.retrieval import build_index

    key = spark.sparkContext.applicationId, sf
    if key not in _INDEXES:
        _INDEXES[key] = build_index(field_values(spark, sf)).write(shared_path(spark, "index"))
    return _INDEXES[key]


def corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("en_id"))


def supplier_sets(spark, sf) -> DataFrame:
    """Sets of suppliers, as interpretations to judge: all, three by three in the order of their keys."""
    return table(spark, sf, "supplier").select(F.floor(F.col("s_suppkey") / 3).cast("long").alias("set_id"), F.col("s_suppkey").alias("en_id"))


SETS = """mem AS (
  SELECT CAST(s_suppkey // 3 AS BIGINT) AS set_id, s_suppkey AS en_id FROM supplier
), siz AS (
  SELECT set_id, count(*) AS n FROM mem GROUP BY ALL
), cor AS (
  SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS en_id FROM lineitem
), lnk AS (
  SELECT DISTINCT l_suppkey AS en_id, l_partkey AS dst FROM lineitem
)"""
