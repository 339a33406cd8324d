from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.llm.line_dedup import dedup_lines, op4_line_dedup
from quillspark.llm.url_filter import filter_urls, host_of, path_of
from tests.llm.test_pipeline import brute_lines


def test_line_dedup_against_brute_force(spark, sf):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = brute_lines(docs)
    for r in op4_line_dedup(spark, sf).collect():
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.n_lines == len((docs[r.doc_id] or "").split("\n")) and r.n_lines - r.n_dropped == (want[r.doc_id].count("\n") + 1 if r.n_lines > r.n_dropped else 0)


def test_line_dedup_odd_rows(spark):
    line = "A line of ten"
    rows = [(2, f"{line}\nx\n{line}"), (1, f" a LINE of ten\t\n{line}"), (1, f" a LINE of ten\t\n{line}"), (1, line), (3, None), (4, ""), (None, line), (5, "É" * 12), (6, "é" * 12), (7, "short"), (8, "short"), (9, f"{line}\n" * 3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _lines", "2 AS _row", "3 AS _kept_text", "'é' AS _d")
    got = sorted(((r.doc_id or -1, r._n_lines, r._n_dropped, r._kept_text) for r in dedup_lines(df).collect()), key=repr)
    want = [(2, 3, 2, "x"), (1, 2, 0, rows[1][1]), (1, 2, 0, rows[1][1]), (1, 1, 0, line), (3, 1, 0, ""), (4, 1, 0, ""), (-1, 1, 0, line), (5, 1, 0, "É" * 12), (6, 1, 0, "é" * 12), (7, 1, 0, "short"), (8, 1, 0, "short"), (9, 3_001, 3_000, "")]
    assert got == sorted(want, key=repr)
    assert dedup_lines(df).columns == ["doc_id", "text", "_lines", "_row", "_d", "_n_lines", "_n_dropped", "_kept_text"]
    assert dedup_lines(df.limit(0)).count() == 0
    three = {(r.doc_id, r._n_dropped) for r in dedup_lines(df, min_docs=4).collect()}
    assert (2, 0) in three and (9, 0) in three


def test_line_dedup_stays_native(spark, sf):
    plan = op4_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_urls_and_other_alphabets(spark):
    long = "x://" + "s." * 2_000 + "com" + "/d" * 2_000
    rows = [(0, long), (1, "http://É.com/a"), (2, "http://x.É.COM/a"), (3, "http://é.com/a"), (4, "x://" + "a." * 30_000 + "net" + "/" * 30_000)]
    rules = [("com", "/d/d/", "block"), ("É.com", "/", "deny"), ("s." * 1_999 + "com", "/d" * 1_000, "drop"), ("net", "/" * 20_000, "stop"), ("net", "/" * 40_000, "none")]
    df = spark.createDataFrame(rows * 20, "page_id long, url string")
    began = time.time()
    got = {(r.page_id, r.verdict) for r in filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), id_cols=("page_id",)).collect()}
    assert got == {(0, "drop"), (1, "deny"), (2, "deny"), (3, "allow"), (4, "stop")}
    assert time.time() - began < 30


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_urls_against_brute_force(spark, broadcast):
    rng = random.Random(9)
    hosts = ["com", "a.com", "B.a.com", "x.B.a.com", "net", "", "a..com", "u:p@a.com:80"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/x/y.html", "//", "/es/é"]
    urls = [f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#/en/', '?a://b'])}" for _ in range(200)]
    urls += [None, "", "a.com/en/", "http:/a.com", "http://a.com\n/en/", "x://" + "s." * 300 + "com" + "/d" * 300]
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("b.a.com", "/en/", "allow"), ("a.com", "/en/x", "block"), ("net", "", "block"), ("com", "/", "allow"), ("com", "/d/d/", "block"), (None, "/", "block"), ("com", None, "block")]

    def one(url):
        rest = url.split("://", 1)[1] if url and "://" in url else None
        if rest is None:
            return "", "", None, "allow"
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
        fits = [(-len(h + p), h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(min(fits)[1:] if fits else (None, "allow")))

    rows = [*enumerate(urls), (0, urls[0]), (0, urls[0]), (None, urls[1])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' AS host", "1 AS _url")
    got = filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), id_cols=("page_id",), broadcast_bytes=broadcast)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *one(u))) for i, u in rows)
    assert filter_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    none = filter_urls(df, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict != 'allow'").count()
    assert none == 0
    assert df.select(host_of(F.col("url")), path_of(F.col("url"))).count() == len(rows)
