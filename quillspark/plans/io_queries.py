"""Registered queries that write files in the formats of the sources and sinks and read them again, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.numbers import rounded
from quillspark.functions.text import session_of
from quillspark.operators import candidates as C
from quillspark.operators import evaluation as E
from quillspark.operators import ranking as R
from quillspark.operators import retrieval as I
from quillspark.operators import training as L
from quillspark.plans import bindings as B
from quillspark.plans.set_queries import _EVAL, _judged
from quillspark.sources import knowledge_base as KB
from quillspark.sources import sinks as W
from quillspark.sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _written(spark, lines, name: str, order: list[str] | None = None) -> str:
    path = S.shared_path(spark, name)
    W.write_lines(lines, path, order)
    return path


_PREFIXES = {"http://d.org/": "dbpedia", "http://r.org/": "r"}


def _triple_file(spark, sf) -> str:
    s = B.table(spark, sf, "supplier")
    subject = F.concat(F.lit("<http://d.org/s"), F.col("s_suppkey").cast("string"), F.lit(">"))
    rows = [
        F.concat(subject, F.lit(' <http://r.org/label> "'), F.col("s_name"), F.lit('"@en .')),
        F.concat(subject, F.lit(" <http://r.org/nation> <http://d.org/n"), F.col("s_nationkey").cast("string"), F.lit("> .")),
        F.concat(subject, F.lit(' <http://r.org/empty> "" .')),
    ]
    return _written(spark, s.select(F.explode(F.array(*rows)).alias("value")), "triples")


@query("""SELECT '<dbpedia:s' || s_suppkey || '>' AS s, '<r:label>' AS p, s_name AS o FROM supplier
UNION ALL SELECT '<dbpedia:s' || s_suppkey || '>', '<r:nation>', '<dbpedia:n' || s_nationkey || '>' FROM supplier""")
def ntriples_load(spark, sf):
    """S-07."""
    return S.read_ntriples(spark, [_triple_file(spark, sf)], _PREFIXES).select("s", "p", F.array_join("o", "|").alias("o"))


@query("""SELECT '<dbpedia:n' || s_nationkey || '>' AS s, '!<r:nation>' AS p, string_agg('<dbpedia:s' || s_suppkey || '>', '|' ORDER BY '<dbpedia:s' || s_suppkey || '>') AS o FROM supplier GROUP BY s_nationkey""")
def ntriples_reversed(spark, sf):
    """S-08, S-09."""
    rows = S.read_ntriples(spark, [_triple_file(spark, sf)], _PREFIXES, reverse=True, predicate_prefix="!").where(F.col("p") == "!<r:nation>")
    return rows.select("s", "p", F.array_join(F.array_sort("o"), "|").alias("o"))


@query("SELECT '<dbpedia:s' || s_suppkey || '>' AS s, 3 AS n, s_name AS fixed, s_name || '|Acme|' || s_address AS o FROM (SELECT *, 'b' || s_nationkey AS s_address FROM supplier)")
def ntriples_first_values(spark, sf):
    """S-07, X-11: values stay in the order of the file, so that the first one is the file's."""
    s = B.table(spark, sf, "supplier")
    names = F.array("s_name", F.lit("Acme"), F.concat(F.lit("b"), F.col("s_nationkey").cast("string")))
    lines = s.select(F.explode(F.transform(names, lambda n: F.concat(F.lit("<http://d.org/s"), F.col("s_suppkey").cast("string"), F.lit('> <http://r.org/name> "'), n, F.lit('" .')))).alias("value"))
    rows = S.read_ntriples(spark, [_written(spark, lines, "names")], _PREFIXES)
    return KB.multi_valued(rows, "<r:name>").join(rows.where("p = '<r:name>'").select("s", F.array_join("o", "|").alias("o")), "s")


@query("""SELECT lower(p_name) AS surface, 'facc12' AS predicate, '<fb:m.' || p_size || '>' AS en_uri, CAST(sum(p_partkey % 7) AS BIGINT) AS cnt FROM part WHERE p_size <> 3 GROUP BY ALL""")
def surface_counts_load(spark, sf):
    """S-10: ids that are none are left out."""
    parts = B.table(spark, sf, "part")
    fb = F.when(F.col("p_size") == 3, "bad").otherwise(F.concat(F.lit("/m/"), F.col("p_size").cast("string")))
    path = S.shared_path(spark, "surface-counts")
    lines = parts.select(F.concat_ws("\t", F.initcap("p_name"), fb, (F.col("p_partkey") % 7).cast("string")).alias("value"))
    lines.write.text(path + "/a.tsv")
    return S.read_surface_counts(spark, path, glob="part-*")


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc_id, '/m/' || l_suppkey AS fb_id FROM lineitem")
def annotated_corpus_load(spark, sf):
    """S-11."""
    lines = B.table(spark, sf, "lineitem")
    cells = [F.col("l_orderkey").cast("string"), *[F.lit(c) for c in "bcdefg"], F.concat(F.lit("/m/"), F.col("l_suppkey").cast("string"))]
    return S.read_annotated_corpus(spark, _written(spark, lines.select(F.concat_ws("\t", *cells).alias("value")), "facc"))


@query("""SELECT 'b_' || item_id AS q_id, lower(trim(regexp_replace(replace(replace(regexp_replace(replace(text, chr(10), ' '), '[^A-Za-z0-9]+', ' ', 'g'), ' OR ', ' '), ' AND ', ' '), ' +', ' ', 'g'))) AS q_content FROM benchmark""")
def queries_load(spark, sf):
    """S-01: of a repeated id the last line stays."""
    b = B.table(spark, sf, "benchmark").select(F.concat(F.lit("b_"), F.col("item_id").cast("string")).alias("q"), F.translate("text", "\n\t", "  ").alias("t"))
    lines = b.select(F.explode(F.array(F.concat_ws("\t", "q", F.lit("first")), F.concat_ws("\t", "q", F.lit("x"), "t"))).alias("value"))
    return S.read_queries(spark, _written(spark, lines, "queries"))


@query(f"""{B.ALL}, o AS (SELECT *, row_number() OVER (PARTITION BY q_id, fb_id ORDER BY score DESC, mention, en_id) AS k FROM inst), r AS (
SELECT *, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY q_id ORDER BY score DESC, mention, en_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS rank FROM o)
SELECT q_id, CAST(fb_id AS VARCHAR) AS doc_id, rank, score FROM r WHERE k = 1""")
def run_roundtrip(spark, sf):
    """K-01 and S-16: a TREC run written and read."""
    lines = W.trec_lines(R.trec_run(B.instances(spark, sf, sorts=True), "cmns"))
    return S.read_trec_run(spark, _written(spark, lines, "run", ["q_id", "rank"])).select("q_id", "doc_id", "rank", "score")


@query("""WITH t AS (SELECT l_orderkey AS q_id, l_suppkey % 5 AS set_id, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS ens FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT CAST(o_orderkey AS VARCHAR) AS q_id, CASE WHEN set_id IS NOT NULL THEN '1' END AS label, coalesce(ens, '') AS ens FROM orders LEFT JOIN t ON q_id = o_orderkey""")
def qrel_sets_roundtrip(spark, sf):
    """K-07 and S-16: ragged lines, a bare id where there is no set."""
    truth = B.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("q_id"), (F.col("l_suppkey") % 5).alias("set_id"), F.col("l_partkey").alias("fb_id"))
    lines = W.qrel_set_lines(W.qrel_sets(B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("q_id")), truth))
    return S.read_ragged(spark, _written(spark, lines, "qrels", ["q_id", "set_id"])).select("q_id", "label", F.array_join("ens", "|").alias("ens"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CAST(s_nationkey % 2 AS VARCHAR) AS target, s_acctbal AS acctbal, CAST(s_nationkey AS DOUBLE) AS nation, s_name AS name FROM supplier")
def instances_roundtrip(spark, sf):
    """K-08 and S-12: instances as JSON by id, written and read."""
    s = B.table(spark, sf, "supplier")
    features = F.create_map(F.lit("acctbal"), F.col("s_acctbal"), F.lit("nation"), F.col("s_nationkey").cast("double"))
    inst = s.select(F.col("s_suppkey").cast("string").alias("id"), (F.col("s_nationkey") % 2).cast("string").alias("target"), features.alias("features"), F.create_map(F.lit("name"), F.col("s_name")).alias("properties"))
    got = S.read_instances(spark, _written(spark, W.instance_json(inst), "instances"), lines=True)
    return got.select("id", "target", F.col("features")["acctbal"].alias("acctbal"), F.col("features")["nation"].alias("nation"), F.col("properties")["name"].alias("name"))


@query(f"WITH {B.INDEX} SELECT terms.field, term, ctf, df, clen FROM terms JOIN flds ON terms.field = flds.field WHERE df > 1")
def index_roundtrip(spark, sf):
    """K-14, R-18: an index written, read, and its statistics looked up."""
    index = B.index(spark, sf).write(S.shared_path(spark, "index"))
    return index.terms.where("df > 1").join(index.fields, "field").select("field", "term", "ctf", "df", "clen")


@query("""WITH s AS (SELECT l_orderkey AS q_id, l_suppkey % 5 AS s, string_agg(DISTINCT CAST(l_partkey % 3 AS VARCHAR), '|' ORDER BY CAST(l_partkey % 3 AS VARCHAR)) AS key FROM lineitem GROUP BY ALL)
SELECT q_id, key, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1""")
def duplicate_interpretations(spark, sf):
    """A-13."""
    lines = B.table(spark, sf, "lineitem")
    return E.duplicate_sets(lines.groupBy(F.col("l_orderkey").alias("q_id"), (F.col("l_suppkey") % 5).alias("s")).agg(F.collect_set((F.col("l_partkey") % 3).cast("string")).alias("ens")))


@query("SELECT s_nationkey AS dbp_uri, '<fb:m.' || min(s_suppkey) || '>' AS fb_uri FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY ALL")
def first_same_as(spark, sf):
    """J-11."""
    s = B.table(spark, sf, "supplier")
    uri = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("<fb:m."), F.col("s_suppkey").cast("string"), F.lit(">"))).otherwise("<other:x>")
    return C.first_same_as(s.select(F.col("s_nationkey").alias("dbp_uri"), uri.alias("uri"), F.col("s_suppkey").alias("pos")))


@query("""SELECT session, conv_id, CASE WHEN fold = 0 THEN 'testing' ELSE 'training' END AS mode FROM (SELECT DISTINCT 's' || conv_id AS session, conv_id FROM conversations)
JOIN (SELECT conv_id AS c, CAST((row_number() OVER (ORDER BY CAST('0x' || substr(md5('7-' || conv_id), 1, 7) AS BIGINT), conv_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT conv_id FROM conversations)) ON c = conv_id""")
def fold_modes(spark, sf):
    """M14: the first of five folds over conversations."""
    keys = B.table(spark, sf, "conversations").select("conv_id")
    members = R.fold_members(R.folds(keys, "conv_id", 5), "conv_id", 5).where("fold = 0")
    return members.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), "conv_id", "mode")


@query("SELECT conv_id, turn, 'c_' || conv_id AS session FROM conversations WHERE role = 'user'")
def query_sessions(spark, sf):
    """P-14 on conversations' queries."""
    rows = B.table(spark, sf, "conversations").where("role = 'user'")
    q_id = F.concat(F.lit("c_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    return rows.select("conv_id", "turn", session_of(q_id).alias("session"))


_ANNOTATED = "lineitem JOIN part ON p_partkey = l_partkey"


def _annotations(spark, sf):
    both = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    s = lambda c: F.col(c).cast("string")
    return both.select(s("l_orderkey").alias("q_id"), (F.col("l_suppkey") % 5).cast("string").alias("set_id"), F.concat(F.lit("/m/"), s("l_partkey")).alias("fb_id"), F.col("p_name").alias("mention"), "l_returnflag", "l_linenumber", "l_partkey", "p_size")


def _tsv(spark, rows, columns: list[str], name: str, header: bool = False) -> str:
    path = S.shared_path(spark, name)
    rows.select(*columns).write.options(sep="\t", quote="", header=header, emptyValue="").csv(path)
    return path


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS q_id, CAST(l_suppkey % 5 AS VARCHAR) AS set_id, '/m/' || l_partkey AS fb_id, p_name AS mention, l_returnflag AS target, o_orderstatus AS q_content, CAST(p_partkey AS VARCHAR) AS en_id
FROM {_ANNOTATED} JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND p_size <= 25""")
def annotations_load(spark, sf):
    """S-02: annotations of known queries whose entity has a URI."""
    known = B.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("q_id"), F.col("o_orderstatus").alias("q_content"))
    same = B.table(spark, sf, "part").where("p_size <= 25").select(F.concat(F.lit("/m/"), F.col("p_partkey").cast("string")).alias("fb_id"), F.col("p_partkey").cast("string").alias("en_id"))
    path = _tsv(spark, _annotations(spark, sf), ["q_id", "set_id", "fb_id", "mention", "l_returnflag"], "annotations")
    return S.parse_annotations(spark, path, known, same).select("q_id", "set_id", "fb_id", "mention", "target", "q_content", "en_id")


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS q_id, '/m/' || l_partkey AS fb_id, count(*) AS n FROM {_ANNOTATED} WHERE p_size > 25 GROUP BY ALL""")
def annotations_unknown(spark, sf):
    """S-02: annotations whose entity has no URI."""
    same = B.table(spark, sf, "part").where("p_size <= 25").select(F.concat(F.lit("/m/"), F.col("p_partkey").cast("string")).alias("fb_id"))
    path = _tsv(spark, _annotations(spark, sf), ["q_id", "set_id", "fb_id", "mention", "l_returnflag"], "annotations")
    return S.unknown_annotations(spark, path, same).groupBy("q_id", "fb_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(item_id AS VARCHAR) AS q_id, lower(trim(regexp_replace(replace(replace(regexp_replace(replace(text, chr(10), ' '), '[^A-Za-z0-9]+', ' ', 'g'), ' OR ', ' '), ' AND ', ' '), ' +', ' ', 'g'))) AS q_content FROM benchmark""")
def headed_queries_load(spark, sf):
    """S-03."""
    rows = B.table(spark, sf, "benchmark").select(F.lit("x").alias("level"), F.col("item_id").cast("string").alias("qid"), F.translate("text", "\n\t\r", "   ").alias("query"))
    return S.read_headed_queries(spark, _tsv(spark, rows, ["level", "qid", "query"], "headed", True))


@query(f"""SELECT l_returnflag AS difficulty, CAST(l_orderkey AS VARCHAR) AS q_id, p_name AS mention, 'e' || l_partkey AS en_id, CAST(l_suppkey % 5 AS VARCHAR) AS set_id, '/m/' || l_partkey AS fb_id FROM {_ANNOTATED} WHERE l_returnflag <> 'R'""")
def set_annotations_load(spark, sf):
    """S-04: rows without an entity are left out."""
    a = _annotations(spark, sf).withColumns({"query": F.lit("q"), "entity": F.when(F.col("l_returnflag") == "R", " ").otherwise(F.concat(F.lit("e"), F.col("l_partkey").cast("string")))})
    path = _tsv(spark, a, ["l_returnflag", "q_id", "query", "mention", "entity", "set_id", "fb_id"], "sets", True)
    return S.read_set_annotations(spark, path).select("difficulty", "q_id", "mention", "en_id", "set_id", "fb_id")


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS q_id, p_name AS mention, 'e' || l_partkey AS en_id, l_returnflag AS target, '/m/' || l_partkey AS fb_id FROM {_ANNOTATED} WHERE l_returnflag <> 'R'""")
def entity_annotations_load(spark, sf):
    """S-05: rows without an id are left out."""
    a = _annotations(spark, sf).withColumns({"query": F.lit("q"), "entity": F.concat(F.lit("e"), F.col("l_partkey").cast("string")), "freebase": F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("fb_id"))})
    path = _tsv(spark, a, ["q_id", "query", "mention", "entity", "l_returnflag", "freebase"], "entities", True)
    return S.read_entity_annotations(spark, path).select("q_id", "mention", "en_id", "target", "fb_id")


@query(f"""SELECT 'z' || l_orderkey || '_' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS q_id, p_name AS q_content, CASE WHEN l_returnflag <> 'R' THEN p_name END AS mention,
CASE WHEN l_returnflag <> 'R' THEN '<dbpedia:' || replace(p_name, ' ', '_') || '>' END AS en_id, CASE WHEN l_returnflag = 'A' THEN '1' ELSE '0' END AS target FROM {_ANNOTATED}""")
def sessions_load(spark, sf):
    """S-06: an order is a session, its lines are queries; those that were returned have no annotation."""
    both = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    main = F.when(F.col("l_returnflag") == "A", "true").otherwise("false")
    note = F.concat(F.lit('<annotation main="'), main, F.lit('"><span>'), "p_name", F.lit("</span><target>http://x.org/wiki/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("</target></annotation>"))
    one = F.concat(F.lit("<query><text>"), F.col("p_name"), F.lit("</text>"), F.when(F.col("l_returnflag") != "R", note).otherwise(""), F.lit("</query>"))
    lines = both.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", one.alias("x")).alias("q")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("q")).alias("q"))
    text = F.concat(F.lit('<session id="z'), F.col("l_orderkey").cast("string"), F.lit('">'), F.array_join(F.transform("q", lambda q: q["x"]), ""), F.lit("</session>"))
    files = max(8, lines.count() // 100_000)
    dealt = lines.select(F.pmod(F.xxhash64("l_orderkey"), F.lit(files)).alias("file"), F.lit(1).alias("at"), text.alias("value"))
    ends = spark.range(files).select(F.col("id").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit("<sessions>").alias("value")), F.struct(F.lit(2).alias("at"), F.lit("</sessions>").alias("value")))).alias("e")).select("file", "e.at", "e.value")
    path = S.shared_path(spark, "sessions")
    dealt.unionAll(ends).repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path)
    return S.read_session_xml(spark, path)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_acctbal AS a, CAST(s_nationkey AS DOUBLE) AS b, s_name AS name, CAST(s_nationkey % 2 AS VARCHAR) AS target FROM supplier")
def merged_instances(spark, sf):
    """S-13: features, properties and targets of three tables."""
    s = B.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").alias("b"), F.col("s_name").alias("name"), (F.col("s_nationkey") % 2).alias("target"))
    paths = [_tsv(spark, s, ["id", *names], "part", True) for names in (["a", "b"], ["name"], ["target"])]
    got = S.merge_instances(spark, paths[0], ["a", "b"], paths[1], ["name"], paths[2])
    return got.select("id", F.col("features")["a"].alias("a"), F.col("features")["b"].alias("b"), F.col("properties")["name"].alias("name"), "target")


@query("SELECT DISTINCT '/m/' || l_partkey AS fb_id FROM lineitem")
def kb_load(spark, sf):
    """S-14: an entity may be there several times."""
    rows = B.table(spark, sf, "lineitem").select(F.concat(F.lit("/m/"), F.col("l_partkey").cast("string")).alias("fb_id"), F.concat(F.lit("<dbpedia:"), F.col("l_suppkey").cast("string"), F.lit(">")).alias("uri"))
    return S.read_kb(spark, _tsv(spark, rows, ["fb_id", "uri"], "kb"))


@query("""WITH m AS (SELECT l_orderkey AS q_id, l_suppkey % 5 AS s, max(l_quantity) AS score, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS key FROM lineitem GROUP BY ALL),
u AS (SELECT q_id, key, max(score) AS score FROM m GROUP BY ALL), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, key) - 1 AS INTEGER) AS set_id FROM u)
SELECT q_id, set_id, unnest(string_split(key, '|')) AS fb_id, score FROM n""")
def protocol_members(spark, sf):
    """K-04: the members of every set, sets numbered by falling score."""
    lines = B.table(spark, sf, "lineitem")
    member = F.struct(F.col("l_partkey").cast("string").alias("fb_id"), F.lit("m").alias("mention"))
    sets = lines.groupBy(F.col("l_orderkey").alias("q_id"), (F.col("l_suppkey") % 5).alias("s")).agg(F.max("l_quantity").alias("score"), F.collect_set(member).alias("members"))
    return W.protocol_rows(sets.withColumn("target", F.lit("1"))).select("q_id", "set_id", "fb_id", "score")


@query("""SELECT l_partkey AS surface, l_suppkey AS en_id, count(*) AS cnt FROM lineitem GROUP BY ALL""")
def merged_counts(spark, sf):
    """K-12: counters of one batch incremented by those of another."""
    lines = B.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("surface"), F.col("l_suppkey").alias("en_id"), "l_linestatus")
    old, new = (lines.where(F.col("l_linestatus") == x).groupBy("surface", "en_id").agg(F.count(F.lit(1)).alias("cnt")) for x in "FO")
    return KB.merge_counts(old, new, ["surface", "en_id"], "cnt")


@query("""SELECT l_suppkey AS s, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS o FROM lineitem GROUP BY ALL""")
def merged_lists(spark, sf):
    """K-12: values of one batch appended to those of another."""
    lines = B.table(spark, sf, "lineitem")
    old, new = (lines.where(F.col("l_linestatus") == x).groupBy(F.col("l_suppkey").alias("s")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("o")) for x in "FO")
    return KB.merge_lists(old, new, ["s"], "o").select("s", F.array_join("o", "|").alias("o"))


@query("""SELECT user_id, max(event_id) AS event_id FROM events GROUP BY ALL""")
def newest_rows(spark, sf):
    """K-12: an upsert overwrites what a key had."""
    return S.newest(B.table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query(f"""WITH {_EVAL} SELECT CAST(q_id AS VARCHAR) AS q_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0e0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM pr""")
def query_eval_roundtrip(spark, sf):
    """K-16: the evaluation by query written and read."""
    lines = W.query_eval_lines(E.strict_per_query(*_judged(spark, sf)))
    cells = F.split("value", "\t")
    rows = spark.read.text(_written(spark, lines, "by-query", ["q_id"]))
    return rows.select(cells[0].alias("q_id"), *[rounded(cells[i + 1].cast("double"), 6).alias(n) for i, n in enumerate(("precision", "recall", "f1"))])


@query("""WITH r AS (SELECT l_orderkey AS q_id, l_suppkey AS doc_id, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT CAST(q_id AS VARCHAR) AS q_id, CAST(doc_id AS VARCHAR) AS doc_id, rank, score, 'lm' AS run FROM k WHERE rank <= 3""")
def retrieval_run_roundtrip(spark, sf):
    """K-02: a retrieval run with spaces between its columns, written and read."""
    scored = B.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("q_id"), F.col("l_suppkey").alias("doc_id")).agg(F.max("l_extendedprice").alias("score"))
    run = R.best_of(scored, 3).withColumns({"q0": F.lit("Q0"), "run": F.lit("lm")})
    return S.read_trec_run(spark, _written(spark, W.trec_lines(run, " "), "run", ["q_id", "rank"])).select("q_id", "doc_id", "rank", "score", "run")


@query(f"WITH {B.INDEX} SELECT doc_id, field, string_agg(term || ':' || tf, '|' ORDER BY term) AS terms FROM post GROUP BY ALL")
def document_dump(spark, sf):
    """R-17: what the index holds of every document."""
    return I.document_terms(B.index(spark, sf)).select("doc_id", "field", F.array_join(F.transform("terms", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string"))), "|").alias("terms"))


@query(f"WITH {B.INDEX} SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS number, doc_id FROM (SELECT DISTINCT doc_id FROM lens)")
def document_numbers(spark, sf):
    """R-17."""
    return I.document_numbers(B.index(spark, sf)).select(F.col("number").cast("long").alias("number"), "doc_id")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey <= 12 THEN '<fb:m.' || s_nationkey || '>' END AS fb_uri, s_suppkey % 7 = 3 AS is_redirect FROM supplier""")
def uri_lookups(spark, sf):
    """J-12: an id for each URI, and whether it is a redirect."""
    s = B.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    pairs = B.table(spark, sf, "nation").where("n_nationkey <= 12").select(F.col("n_nationkey").alias("s_nationkey"), F.concat(F.lit("<fb:m."), F.col("n_nationkey").cast("string"), F.lit(">")).alias("fb_uri"))
    found = C.lookup(s, "s_nationkey", pairs, "fb_uri")
    return C.with_redirects(found, "s_suppkey", s.where("s_suppkey % 7 = 3")).select("s_suppkey", "fb_uri", "is_redirect")


_ANCHOR = f"""WITH {B.Q}, {B.GRAMS}, {B.SF}, ac AS (SELECT surface, en_id, CAST(sum(cnt) AS DOUBLE) / sum(sum(cnt)) OVER (PARTITION BY surface) AS commonness FROM sf WHERE predicate = 'facc12' GROUP BY surface, en_id),
fa AS (SELECT q_id, mention, n, en_id, commonness FROM men JOIN ac ON surface = mention WHERE commonness >= 0.4),
db AS (SELECT DISTINCT m.q_id, m.mention, m.n, s.en_id FROM men m JOIN sf s ON s.surface = m.mention WHERE predicate = '<rdfs:label>' AND NOT EXISTS (SELECT 1 FROM fa WHERE fa.q_id = m.q_id AND fa.mention = m.mention AND fa.en_id = s.en_id))"""


@query(f"""{_ANCHOR} SELECT q_id, mention, en_id, round(commonness, 9) AS commonness FROM fa UNION ALL SELECT db.q_id, db.mention, db.en_id, round(coalesce(ac.commonness, 0), 9) FROM db LEFT JOIN ac ON ac.surface = db.mention AND ac.en_id = db.en_id""")
def wiki_candidates(spark, sf):
    """J-06: anchors at a threshold, and titles; open orders' lines stand for anchors."""
    forms = B.surface_forms(spark, sf).where("predicate <> 'facc09'").withColumn("predicate", F.when(F.col("predicate") == "facc12", "anchor").otherwise("title"))
    held = C.entries(S.shared_table(spark, forms, "forms"), 0.4, annotated=["anchor"])
    asked = B.asked(spark, sf, held, B.WRITTEN)
    held = held.select("surface", "en_id", rounded("commonness", 9).alias("commonness"))  # rounded once a surface
    return C.linked(asked, held, unique=True, together=True).select("q_id", "mention", "en_id", "commonness")


@query(f"{B.ALL} SELECT q_id, count(*) AS n, string_agg(q_id || '|' || mention || '|' || en_id, ';' ORDER BY q_id || '|' || mention || '|' || en_id) AS ids FROM cand GROUP BY q_id")
def grouped_instances(spark, sf):
    """A-01."""
    return L.grouped(C.instances(B.found(spark, sf, sorts=True)), "q_id").select("q_id", "n", F.array_join("ids", ";").alias("ids"))
