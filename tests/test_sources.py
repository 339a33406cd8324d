from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import knowledge_base as K
from quillspark.sources import sinks as W
from quillspark.sources import tables as S


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_queries(spark, tmp_path):
    path = put(tmp_path / "q.tsv", "a\tOld One\nb\tx\tNew-York OR not\n\na\tLast One\n")
    assert {r.q_id: r.q_content for r in S.read_queries(spark, path).collect()} == {"a": "last one", "b": "new york not"}
    assert {r.q_id: r.q_content for r in S.read_queries(spark, path, process=False).collect()}["b"] == "New-York OR not"
    path = put(tmp_path / "h.tsv", 'difficulty\tqid\tquery\nx\ta\tSay "Hi"\nx\ta\tTwo\n')
    assert [(r.q_id, r.q_content) for r in S.read_headed_queries(spark, path).collect()] == [("a", "two")]


def test_annotations(spark, tmp_path):
    path = put(tmp_path / "a.tsv", "a\t0\t/m/1\tone\t1\na\t0\t/m/9\tnine\t1\nz\t0\t/m/1\tone\t1\n")
    queries = spark.createDataFrame([("a", "one")], "q_id string, q_content string")
    same = spark.createDataFrame([("/m/1", "<dbpedia:One>")], "fb_id string, en_id string")
    assert [(r.q_id, r.en_id, r.mention) for r in S.parse_annotations(spark, path, queries, same).collect()] == [("a", "<dbpedia:One>", "one")]
    assert [r.fb_id for r in S.unknown_annotations(spark, path, same).collect()] == ["/m/9"]
    path = put(tmp_path / "s.tsv", "difficulty\tqid\tquery\tmention\tentity\tset_id\tfreebase_id\ne\ta\tq\tm\t<x>\t1\t/m/1\ne\tb\tq\tm\t \t1\t\n")
    assert [r.q_id for r in S.read_set_annotations(spark, path).collect()] == ["a"]
    path = put(tmp_path / "e.tsv", "qid\tquery\tmention\tentity\ttarget\tfreebase_id\na\tq\tm\t<x>\t1\t/m/1\nb\tq\tm\t<x>\t1\t\n")
    assert [r.q_id for r in S.read_entity_annotations(spark, path).collect()] == ["a"]


def test_session_xml(spark, tmp_path):
    body = """<root><session id="s1"><query><text>one two</text><annotation main="true"><span>one</span><target>http://en/wiki/One thing</target></annotation>
<annotation main="false"><span>two</span><target>http://en/wiki/Two</target></annotation></query><query><text>none</text></query></session></root>"""
    rows = sorted((r.q_id, r.mention or "", r.en_id or "", r.target) for r in S.read_session_xml(spark, put(tmp_path / "x.xml", body)).collect())
    assert rows == [("s1_1", "one", "<dbpedia:One%20thing>", "1"), ("s1_1", "two", "<dbpedia:Two>", "0"), ("s1_2", "", "", "0")]


NT = """# a comment
<http://d/A> <http://r/label> "Thing \\"A\\""@en .
<http://d/A> <http://r/link> <http://d/B> .
<http://d/A> <http://r/link> <http://d/C> .
<http://d/A> <http://r/label2> "  " .
<http://d/R> <http://r/redirect> <http://d/A> .
"""


def test_ntriples(spark, tmp_path):
    plain = put(tmp_path / "a.nt", NT)
    packed = tmp_path / "b.nt.gz"
    packed.write_bytes(gzip.compress(b'<http://d/A> <http://r/label> "Newer"^^<http://t> .\n'))
    prefixes = {"http://d/": "dbpedia", "http://r/": "r", "http://": "web"}
    got = {(r.s, r.p): r.o for r in S.read_ntriples(spark, [plain, str(packed)], prefixes).collect()}
    assert got == {("<dbpedia:A>", "<r:label>"): ["Newer"], ("<dbpedia:A>", "<r:link>"): ["<dbpedia:B>", "<dbpedia:C>"], ("<dbpedia:R>", "<r:redirect>"): ["<dbpedia:A>"]}
    back = {(r.s, r.p): r.o for r in S.read_ntriples(spark, [plain], prefixes, reverse=True, predicate_prefix="!").where(F.col("p") == "!<r:redirect>").collect()}
    assert back == {("<dbpedia:A>", "!<r:redirect>"): ["<dbpedia:R>"]}


def triples(spark):
    rows = [
        ("<dbpedia:A>", K.LABEL, ["Alpha"]), ("<dbpedia:A>", K.NAME, ["Alpha", "The First"]), ("<dbpedia:R>", K.LABEL, ["Alfa"]), ("<dbpedia:R>", K.REDIRECT, ["<dbpedia:A>"]), ("<dbpedia:R>", K.NAME, ["no"]),
        ("<dbpedia:A_(disambiguation)>", K.LABEL, ["Alpha pages"]), ("<dbpedia:N>", "<x>", ["1"]),
    ]
    return spark.createDataFrame(rows, "s string, p string, o array<string>")


def test_knowledge_base(spark):
    t = triples(spark)
    assert {(r.surface, r.predicate, r.en_id) for r in K.surface_forms(t).collect()} == {
        ("alpha", K.LABEL, "<dbpedia:A>"), ("alfa", K.REDIRECT, "<dbpedia:A>"), ("alpha", K.NAME, "<dbpedia:A>"), ("the first", K.NAME, "<dbpedia:A>"), ("alpha pages", K.LABEL, "<dbpedia:A_(disambiguation)>"),
    }
    assert {(r.en_id, r.is_redirect) for r in K.entities(t).collect()} == {("<dbpedia:A>", False), ("<dbpedia:R>", True)}
    assert [tuple(r) for r in K.inverse(t).collect()] == [("<dbpedia:A>", "!" + K.REDIRECT, ["<dbpedia:R>"])]
    assert [tuple(r) for r in K.multi_valued(t, K.NAME).collect()] == [("<dbpedia:A>", 2, "Alpha")]
    assert K.single_valued(t, K.NAME).where(F.size("o") > 1).count() == 0
    assert {r.name: r.uris for r in K.name_variants(t).collect()}["alfa"] == ["<dbpedia:A>"]
    assert {r.en_id: sorted(r.predicates) for r in K.wide(t).collect()}["<dbpedia:N>"] == ["<x>"]
    assert [(r.field, r["rank"]) for r in K.top_fields(t, 1).collect()] == [(K.LABEL, 1)]
    assert [r.en_id for r in K.lookup_name(K.surface_forms(t), "ALFA").collect()] == ["<dbpedia:A>"]


def test_upserts(spark):
    kind = "k string, n long"
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], kind), spark.createDataFrame([("x", 5)], kind)
    assert {r.k: r.n for r in K.merge_counts(a, b, ["k"], "n").collect()} == {"x": 6, "y": 2}
    lists = "k string, v array<string>"
    got = K.merge_lists(spark.createDataFrame([("x", ["b"])], lists), spark.createDataFrame([("x", ["a"])], lists), ["k"], "v").collect()
    assert [r.v for r in got] == [["a", "b"]]
    assert [r.n for r in S.newest(spark.createDataFrame([("x", 1), ("x", 3)], kind), ["k"], "n").collect()] == [3]


def test_surface_counts_and_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    put(tmp_path / "a.tsv", "Paris\t/m/1\t3\nParis\tbad\t3\n")
    put(tmp_path / "sub" / "b.tsv", "paris\t/m/1\t4\n")
    assert [tuple(r) for r in S.read_surface_counts(spark, str(tmp_path)).collect()] == [("paris", "facc12", "<fb:m.1>", 7)]
    other = tmp_path / "facc"
    other.mkdir()
    put(other / "x.tsv", "d1\ta\tb\tc\td\te\tf\t/m/1\nd1\ta\tb\tc\td\te\tf\t/m/1\nd2\ta\n")
    assert [tuple(r) for r in S.read_annotated_corpus(spark, str(other)).collect()] == [("d1", "/m/1")]


def test_instances(spark, tmp_path):
    path = put(tmp_path / "i.json", json.dumps({"7": {"target": "1", "features": {"b": 2.0, "a": 1.0}, "properties": {"q_id": "q"}}}))
    inst = S.read_instances(spark, path)
    assert inst.first().features == {"b": 2.0, "a": 1.0}
    assert W.instance_lines(inst).first().value == "7\t1\ta:1.0\tb:2.0"
    assert json.loads(W.instance_json(inst).first().value) == {"7": {"target": "1", "features": {"b": 2.0, "a": 1.0}, "properties": {"q_id": "q"}}}
    with_q = W.add_qids(inst.withColumn("q_id", F.lit("q")), "q_id")
    assert W.libsvm_lines(with_q).first().value == "1 qid:1 1:1.0 2:2.0 # 7"
    f, p, t = put(tmp_path / "f", "id\ta\n1\t0.5\n"), put(tmp_path / "p", "id\tq\n1\tx\n2\ty\n"), put(tmp_path / "t", "id\ttarget\n1\t1\n")
    merged = {r.id: (r.features, r.properties, r.target) for r in S.merge_instances(spark, f, ["a"], p, ["q"], t).collect()}
    assert merged == {"1": ({"a": 0.5}, {"q": "x"}, "1"), "2": (None, {"q": "y"}, None)}
    with pytest.raises(ValueError, match="header"):
        S.merge_instances(spark, f, ["b"], p, ["q"], t)


def test_runs_and_relevance(spark, tmp_path):
    truth = spark.createDataFrame([("a", "0", "f1", "m", "1"), ("a", "0", "f2", "n", "1"), ("a", "0", "f1", "o", "1"), ("b", "0", "f3", "m", "0")], "q_id string, set_id string, fb_id string, mention string, target string")
    assert {tuple(r) for r in W.qrel_rows(truth).collect()} == {("a", "0", "f1", 1), ("a", "0", "f2", 1)}
    queries = spark.createDataFrame([("a",), ("c",)], "q_id string")
    lines = W.qrel_set_lines(W.qrel_sets(queries, truth))
    assert sorted(r.value for r in lines.collect()) == ["a\t1\tf1\tf2", "c"]
    W.write_lines(lines, str(tmp_path / "q"), ["q_id", "set_id"])
    got = {r.q_id: (r.label, r.ens) for r in S.read_ragged(spark, str(tmp_path / "q")).collect()}
    assert got == {"a": ("1", ["f1", "f2"]), "c": (None, [])}
    sets = spark.createDataFrame([("a", 0.5, ["y", "x"], "1"), ("a", 0.9, ["x", "y"], "1"), ("a", 0.7, ["z"], "0")], "q_id string, score double, fbs array<string>, target string")
    assert [r.value for r in W.set_lines(sets).collect()] == ["a\t0.9\tx\ty"]
    members = spark.createDataFrame([("a", 0.5, "1", [("f1", "m"), ("f2", "n")]), ("a", 0.9, "1", [("f3", "o")])], "q_id string, score double, target string, members array<struct<fb_id:string,mention:string>>")
    assert sorted((r.set_id, r.fb_id, r.mention) for r in W.protocol_rows(members).collect()) == [(0, "f3", "o"), (1, "f1", "m"), (1, "f2", "n")]
    run = spark.createDataFrame([("a", "f1", 1, 0.25, "x")], "q_id string, fb_id string, rank int, score double, run string")
    line = W.trec_lines(run)
    assert line.first().value == "a\tQ0\tf1\t1\t0.25\tx"
    W.write_lines(line, str(tmp_path / "r"), ["q_id", "rank"])
    assert [tuple(r) for r in S.read_trec_run(spark, str(tmp_path / "r")).collect()] == [("a", "f1", 1, 0.25, "x")]
    assert W.score_lines(spark.createDataFrame([(1, 0.5)], "id int, score double")).first().value == "1\t0.5" + "0" * 29


def test_configuration(spark, tmp_path):
    text = json.dumps({"index_dir": "i", "query_file": "q", "output_file": "o", "run_id": "r", "model": "mlm"})
    assert S.RetrievalConfig.from_json(text).smoothing_param == 0.1
    with pytest.raises(TypeError):
        S.RetrievalConfig.from_json("{}")
    path = put(tmp_path / "q.json", json.dumps([{"query_id": "1", "query": "x y"}]))
    assert [tuple(r) for r in S.read_json_queries(spark, path).collect()] == [("1", "x y")]
    assert S.toy_documents(spark).count() == 5
    assert S.read_kb(spark, put(tmp_path / "kb", "/m/1\tx\n/m/1\ty\n")).count() == 1
