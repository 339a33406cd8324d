from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "clean"), [("a OR OR b AND  c!", "a OR b c"), ("", ""), ("  x--y ", "x y"), ("OR a", "OR a"), ("é1", "1")])
def test_preprocess(spark, raw, clean):
    assert one(spark, raw, T.preprocess) == clean


def test_preprocess_follows_its_model(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", " OR ", " AND ", "-", " ", "7", "or"]) for _ in range(rng.randint(0, 9))) for _ in range(200)]

    def model(s):
        s = re.sub("[^A-Za-z0-9]+", " ", s).replace(" OR ", " ").replace(" AND ", " ")
        return re.sub(" +", " ", s).strip()

    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.preprocess(F.col("x")).alias("y")).collect()
    assert all(r.y == model(r.x) for r in rows)


def test_ngrams_in_order(spark):
    got = one(spark, "a b c", T.ngrams)
    assert [g.mention for g in got] == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, "", T.ngrams) == []
    assert [g.mention for g in one(spark, "a a", T.ngrams)] == ["a", "a", "a a"]


def test_ids_and_uris(spark):
    assert one(spark, "/m/0q7_xz", T.freebase_id_to_uri) == "<fb:m.0q7_xz>"
    assert one(spark, "<fb:m.0q7_xz>", T.freebase_uri_to_id) == "/m/0q7_xz"
    assert one(spark, "x", lambda c: T.freebase_id_to_uri(c, strict=False)) is None
    with pytest.raises(Exception, match="not an id"):
        one(spark, "x", T.freebase_id_to_uri)
    assert one(spark, "<dbpedia:Kind:Tall_tree%2Bbush>", T.resolve_uri) == "Tall tree+bush"
    assert one(spark, "100% sure+", T.resolve_uri) == "100% sure+"
    assert one(spark, "http://x/wiki/A b(c)+é", T.wiki_url_to_uri) == "<dbpedia:A%20b(c)+%C3%A9>"
    assert one(spark, "web-7-12_3", T.session_of) == "web-7-12" and one(spark, "solo-4", T.session_of) == "solo-4"
    assert one(spark, "a.b$c", lambda c: T.unescape_key(T.escape_key(c))) == "a.b$c"
    assert one(spark, "<http://x.org/Name>", lambda c: T.prefixed(c, {"http://x.org/": "x"})) == "<x:Name>"


def test_terms(spark):
    assert one(spark, "The cat's (big) house!", T.index_query) == ["cat", "s", "big", "house"]
    assert one(spark, "a b a c", lambda c: T.remove_stop_words(c, ["b"])) == "a a c"
    assert T.mlm_weights(0.2, 0.0, 0.8) == {"names": 0.2, "contents": 0.8}
    assert T.run_id("mlm", th=0.3, k=None) == "mlm-th0.3"


@pytest.mark.parametrize(("raw", "plain"), [("Red ball 7", True), ("a", True), ("ORB band", True), ("or and", True), ("", False), (" a", False), ("a ", False), ("a  b", False), ("a\n", False), ("é", False), ("a-b", False), ("OR a", False), ("a AND", False), ("a OR b", False), (None, False)])
def test_plain_texts_are_only_lower_cased(spark, raw, plain):
    row = spark.createDataFrame([(raw,)], "x string").select(T.plain(F.col("x")).alias("p"), T.query_content(F.concat_ws(" ", "x", "x")).alias("two")).first()
    assert row.p is plain and (not plain or row.two == f"{raw} {raw}".lower())


def test_runs(spark):
    rows = [T.runs(F.split(F.lit("a b a b c d e f g h"), " "), n).alias(f"n{n}") for n in (1, 2, 9, 10, 11)]
    r = spark.range(1).select(*rows).first()
    assert (r.n1, r.n2[:4], r.n9, r.n10, r.n11) == (list("ababcdefgh"), ["a b", "b a", "a b", "b c"], ["a b a b c d e f g", "b a b c d e f g h"], ["a b a b c d e f g h"], [])
