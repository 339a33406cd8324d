from __future__ import annotations

import json
from pathlib import Path

from quillspark.__main__ import main
from quillspark.operators.retrieval import build_index
from quillspark.sources import tables as S
from quillspark.streaming.linking import link_stream


def test_stream(spark, tmp_path):
    forms = spark.createDataFrame([("red fox", "facc09", "A", 3), ("fox", "facc12", "B", 1)], "surface string, predicate string, en_id string, cnt long")
    spark.createDataFrame([("q1", "the Red-Fox"), ("q2", "nothing")], "q_id string, text string").write.json(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("q_id string, text string").json(str(tmp_path / "in"))
    before = set(shared_folder(spark).iterdir())
    link_stream(stream, forms, lambda df, n: got.extend(df.collect()), str(tmp_path / "state")).awaitTermination()
    assert {(r.q_id, r.mention, r.en_id) for r in got} == {("q1", "red fox", "A"), ("q1", "fox", "B")}
    assert [p.name.split("-")[0] for p in set(shared_folder(spark).iterdir()) - before] == ["commonness"]  # a batch leaves nothing


def shared_folder(spark):
    return Path(S.shared_path(spark, "x").removeprefix("file:")).parent


def lines(folder):
    return sorted(x for p in folder.glob("part-*") for x in p.read_text().splitlines())


def test_commands(spark, tmp_path, capsys):
    forms = [("red fox", "facc09", "A", 3), ("fox", "facc12", "B", 1), ("red fox", "facc12", "C", 1)]
    spark.createDataFrame(forms, "surface string, predicate string, en_id string, cnt long").write.parquet(str(tmp_path / "forms"))
    (tmp_path / "q.tsv").write_text("q1\tred fox\nq2\tnothing\n")
    main(["rank", "--queries", str(tmp_path / "q.tsv"), "--forms", str(tmp_path / "forms"), "--out", str(tmp_path / "run")])
    assert lines(tmp_path / "run") == ["q1\tQ0\tA\t1\t0.75\tcmns", "q1\tQ0\tC\t2\t0.25\tcmns"]
    main(["link", "--queries", str(tmp_path / "q.tsv"), "--forms", str(tmp_path / "forms"), "--out", str(tmp_path / "sets"), "--method", "cmns", "--score", "0.5"])
    assert lines(tmp_path / "sets") == ["q1\t0.75\tA"]
    (tmp_path / "gold").write_text("q1\t1\tA\nq2\n")
    main(["evaluate", "--qrels", str(tmp_path / "gold"), "--run", str(tmp_path / "sets"), "--out", str(tmp_path / "eval")])
    assert lines(tmp_path / "eval") == ["q1\t1.0\t1.0\t1.0", "q2\t1.0\t1.0\t1.0"]
    main(["lookup", "--forms", str(tmp_path / "forms"), "--name", "Red Fox"])
    assert "red fox" in capsys.readouterr().out
    spark.createDataFrame([("/m/1", "A")], "fb_id string, en_id string").write.parquet(str(tmp_path / "same"))
    (tmp_path / "a.tsv").write_text("q1\t0\t/m/1\tred fox\t1\n")
    main(["qrels", "--queries", str(tmp_path / "q.tsv"), "--annotations", str(tmp_path / "a.tsv"), "--same_as", str(tmp_path / "same"), "--out", str(tmp_path / "qrels")])
    assert lines(tmp_path / "qrels") == ["q1\t1\t/m/1", "q2"]
    inst = {str(i): {"target": str(i % 2), "features": {"a": float(i % 2), "b": float(i)}, "properties": {"session": f"s{i // 2}"}} for i in range(40)}
    (tmp_path / "i.json").write_text(json.dumps(inst))
    main(["cv", "--instances", str(tmp_path / "i.json"), "--features", "a,b", "--out", str(tmp_path / "scores")])
    assert len(lines(tmp_path / "scores")) == 40
    model = ["--instances", str(tmp_path / "i.json"), "--features", "a,b", "--trees", "5", "--out", str(tmp_path / "model")]
    main(["train", *model])
    main(["score", "--instances", str(tmp_path / "i.json"), "--model", str(tmp_path / "model"), "--out", str(tmp_path / "scored")])
    assert all((float(s) > 0.5) == (int(i) % 2 == 1) for i, s in (x.split("\t") for x in lines(tmp_path / "scored")))


def test_retrieval_from_a_configuration(spark, tmp_path):
    values = S.long_fields(S.toy_documents(spark), "doc_id", ["title", "content", "contents"])
    build_index(values).write(str(tmp_path / "index"))
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "1", "query": "night train"}, {"query_id": "2", "query": "nothing"}]))
    config = {"index_dir": str(tmp_path / "index"), "query_file": str(tmp_path / "q.json"), "run_id": "r", "num_docs": 3}
    runs = {}
    for name, more in {"lm": {}, "dirichlet": {"smoothing_method": "dirichlet"}, "mlm": {"model": "mlm", "field_weights": {"title": 0.4, "contents": 0.6}}, "prms": {"model": "prms"}, "tfidf": {"model": "tfidf"}}.items():
        (tmp_path / "c.json").write_text(json.dumps({**config, "output_file": str(tmp_path / name), **more}))
        main(["retrieve", "--config", str(tmp_path / "c.json")])
        runs[name] = [x.split(" ") for x in lines(tmp_path / name)]
    assert all([r[:4] for r in run][:1] == [["1", "Q0", "1", "1"]] and {r[2] for r in run} <= {"1", "4", "5"} and {r[5] for r in run} == {"r"} for run in runs.values())
