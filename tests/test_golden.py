"""The evaluator against plain Python on files of our own, and over public run and relevance files where GOLDEN_RUNS names their folder."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest

from quillspark.operators import evaluation as E
from quillspark.sources import tables as S

ROOT = Path(os.environ.get("GOLDEN_RUNS", "/nonexistent"))
HERE = (ROOT / "runs").is_dir()

#: Precision, recall, f1 by run and relevance file.
STRICT = {
    ("erd-ltr-greedy", "ERD"): (0.8516, 0.8282, 0.8398), ("erd-ltr-ltr", "ERD"): (0.7582, 0.7476, 0.7529), ("erd-mlmcg-greedy", "ERD"): (0.7143, 0.7125, 0.7134), ("erd-mlmcg-ltr", "ERD"): (0.7253, 0.7308, 0.7280),
    ("yerd-ltr-greedy", "Y-ERD"): (0.7865, 0.7870, 0.7867), ("yerd-ltr-ltr", "Y-ERD"): (0.7310, 0.7317, 0.7314), ("yerd-mlmcg-greedy", "Y-ERD"): (0.7087, 0.7090, 0.7089), ("yerd-mlmcg-ltr", "Y-ERD"): (0.7250, 0.7240, 0.7245),
}
#: Mean average precision, precision at 1, recall at 5, reciprocal rank, recall.
RANKED = {"cmns": (0.7037, 0.7556, 0.7222, 0.7630, 0.7222), "mlm": (0.7675, 0.7333, 0.8622, 0.7948, 0.9333), "mlmcg": (0.8543, 0.8444, 0.9015, 0.8852, 0.9333), "ltr": (0.8606, 0.8222, 0.9289, 0.8674, 0.9333)}


if HERE:

    @pytest.mark.parametrize(("run", "qrels"), list(STRICT))
    def test_strict(spark, run, qrels):
        gold, result = S.read_ragged(spark, str(ROOT / f"qrels/{qrels}_elq.qrels")), S.read_ragged(spark, str(ROOT / f"runs/dis/{run}.run"), scored=True)
        r = E.strict_macro(gold, result).first()
        assert (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) == STRICT[run, qrels]


    @pytest.mark.parametrize("run", (list(RANKED)))
    def test_ranked(spark, run):
        r = E.ranked_means(S.read_trec_qrels(spark, str(ROOT / "qrels/ERD_trec.qrels")), S.read_trec_run(spark, str(ROOT / f"runs/cer/erd-{run}.run"))).first()
        assert (round(r.map, 4), round(r.p_at_1, 4), round(r.recall_at_k, 4), round(r.mrr, 4), round(r.recall, 4)) == RANKED[run]


    def test_run_files_keep_their_invariants(spark):
        rows = S.read_trec_run(spark, str(ROOT / "runs/cer/erd-ltr.run")).collect()
        by: dict = {}
        for r in rows:
            by.setdefault(r.q_id, []).append(r["rank"])
        assert len(rows) == 986 and all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def _plain_strict(gold, result):
    """Macro precision and recall over the queries of gold (id -> sets)."""
    p = r = 0.0
    for q, sets in gold.items():
        found = result.get(q, set())
        both = len(sets & found)
        p += (both / len(found) if found else 0.0) if sets else float(not found)
        r += both / len(sets) if sets else float(not found)
    p, r = p / len(gold), r / len(gold)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def test_strict_on_own_files(spark, tmp_path):
    rng = random.Random(7)
    some = lambda: {frozenset(rng.sample("ABCDE", rng.randint(1, 3))) for _ in range(rng.randint(0, 3))}
    gold = {f"q{i}": some() for i in range(60)}
    result = {f"q{i}": (set(gold[f"q{i}"]) if rng.random() < 0.4 else some()) for i in range(50)}
    (tmp_path / "gold").write_text("".join([f"{q}\n" if not sets else "".join("\t".join([q, "1", *s]) + "\n" for s in sets) for q, sets in gold.items()]))
    (tmp_path / "run").write_text("".join("\t".join([q, "0.5", *rng.sample(sorted(s), len(s))]) + "\n" for q, sets in result.items() for s in sets))
    r = E.strict_macro(S.read_ragged(spark, str(tmp_path / "gold")), S.read_ragged(spark, str(tmp_path / "run"), scored=True)).first()
    assert (r.precision, r.recall, r.f1) == pytest.approx(_plain_strict(gold, result))


def test_ranked_on_own_files(spark, tmp_path):
    rng = random.Random(8)
    rel = {f"q{i}": set(rng.sample(range(20), rng.randint(1, 4))) for i in range(40)}
    run = {f"q{i}": {d: round(rng.random(), 1) for d in rng.sample(range(20), rng.randint(0, 12))} for i in range(50)}
    (tmp_path / "qrels").write_text("".join(f"{q} 0 d{d:02} 1\n" for q, ds in rel.items() for d in ds))
    (tmp_path / "run").write_text("".join(f"{q}\tQ0\td{d:02}\t1\t{s}\tx\n" for q, ds in run.items() for d, s in ds.items()))
    want = []
    for q, ds in rel.items():
        ranked = [d for _, d in sorted(((s, d) for d, s in run[q].items()), reverse=True)]  # ties by falling id
        at = [i + 1 for i, d in enumerate(ranked) if d in ds]
        want.append((sum((n + 1) / i for n, i in enumerate(at)) / len(ds), float(1 in at), 1 / at[0] if at else 0.0, sum(i <= 5 for i in at) / len(ds), len(at) / len(ds)))
    r = E.ranked_means(S.read_trec_qrels(spark, str(tmp_path / "qrels")), S.read_trec_run(spark, str(tmp_path / "run"))).first()
    assert (r.map, r.p_at_1, r.mrr, r.recall_at_k, r.recall) == pytest.approx([sum(x) / len(want) for x in zip(*want, strict=True)])
