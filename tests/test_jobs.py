"""The offline jobs, on references whose labels their vectors tell."""

from __future__ import annotations

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import log, sources
from vicinal.plans import jobs


@pytest.fixture(scope="module")
def references(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = [{"vector": [round(float(x), 4) for x in v], "label": "fraud" if v[0] > 0.5 else "legit"} for v in rng.random((240, 14)) * [1] + np.eye(1, 14) * 0]
    top = tmp_path_factory.mktemp("jobs")
    (top / "refs.json").write_text(json.dumps(rows))
    return jobs.prepare(spark, str(top / "refs.json"), str(top / "refs.parquet")), top


@pytest.mark.parametrize("algorithm", ["dt", "rf", "rf-soft"])
def test_train(references, algorithm):
    refs, top = references
    votes = jobs.relabel(refs, str(top / "votes.parquet")) if algorithm == "rf-soft" else None
    done = jobs.train(refs, algorithm, votes, trees=5, max_depth=5, min_leaf=2)
    row = done.metrics.first()
    assert row["n"] == done.held_out.count() and 0 < row["n"] < 60 and row["threshold"] == (0.6 if algorithm == "rf-soft" else 0.5)
    assert algorithm == "rf-soft" or (row["accuracy"] > 0.9 and row["roc_auc"] > 0.9)
    sources.write_metrics(done.metrics, str(top / f"metrics-{algorithm}"))


def test_soft_needs_votes_and_bands(spark, references):
    refs, _ = references
    with pytest.raises(ValueError, match="distilled"):
        jobs.train(refs, "rf-soft")
    scored = refs.select(F.col("ref_id").alias("id"), "v", (F.col("v")[0] / 10_000).alias("score"), (F.col("label") == 1).alias("fraud"))
    rows = jobs.evaluate_bands(scored, refs, [(0.2, 0.8), (0.4, 0.6)]).orderBy("lo").collect()
    assert rows[0]["uncertain"] > rows[1]["uncertain"] and all(r["confident"] + r["uncertain"] == 240 for r in rows)


def test_log_lines(capsys):
    log.logger("t", "nonsense").info("scored %d", 3, extra={"fields": {"rows": 3}})
    line = json.loads(capsys.readouterr().err)
    assert (line["message"], line["rows"], line["level"]) == ("scored 3", 3, "INFO")
    assert log.logger("t", "debug", "text").level == logging.DEBUG


def test_models_are_saved_and_loaded(spark, references, tmp_path):
    refs, _ = references
    from vicinal.operators import forest

    for name, model in (("t", forest.fit_tree(refs, min_leaf=2)), ("f", forest.fit_forest(refs, trees=3, max_depth=4)), ("s", forest.fit_soft_forest(refs.withColumn("soft", F.col("label") / 2.0), trees=3, max_depth=4))):
        forest.save_model(model, str(tmp_path / name))
        again = forest.load_model(str(tmp_path / name))
        scores = [sorted((r["ref_id"], r["score"]) for r in forest.predict(m, refs).collect()) for m in (model, again)]
        assert scores[0] == scores[1]


def test_node_tables_are_read_in_one_go(references, monkeypatch):
    """The walk over a model's nodes says what the model says, and no node is asked for by itself."""
    refs, _ = references
    from pyspark.ml.tree import _DecisionTreeModel

    from vicinal.operators import forest
    from vicinal.operators.vectorize import dequantize

    models = [forest.fit_tree(refs, min_leaf=2), forest.fit_forest(refs, trees=3, max_depth=6), forest.fit_soft_forest(refs.withColumn("soft", F.col("label") / 2.0), trees=3, max_depth=6)]
    wanted = [{r["ref_id"]: r["score"] for r in forest.predict(m, refs).collect()} for m in models]
    asked = []
    monkeypatch.setattr(_DecisionTreeModel, "_call_java", lambda self, name, *a, _call=_DecisionTreeModel._call_java: asked.append(name) or _call(self, name, *a))
    for model, scores in zip(models, wanted, strict=True):
        rows = forest.node_rows(model)
        for nodes in (forest.node_columns(model), rows):
            got = refs.select("ref_id", forest.walker(nodes)(dequantize(F.col("v"))).alias("score")).collect()
            assert {r["ref_id"]: r["score"] for r in got} == pytest.approx(scores, abs=1e-12)
        assert {r[0] for r in rows} == set(range(len(getattr(model, "trees", [model])))) and len(rows) >= 3
    assert "rootNode" not in asked


def test_samples_from_each_source(spark, tmp_path, references):
    from vicinal.operators import forest

    rows = [{"name": "a", "vector": [0.9] * 14, "expected": "fraud"}, {"name": "b", "vector": [0.1] * 14}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    from_file, from_text = sources.read_samples(spark, str(tmp_path / "s.json")), sources.read_samples(spark, lines=json.dumps(rows))
    assert from_file.collect() == from_text.collect() and sources.read_samples(spark).count() == 2
    found = {r["name"]: r for r in forest.predict_samples(forest.fit_tree(references[0], min_leaf=2), from_file).collect()}
    assert not found["a"]["approved"] and found["a"]["as_expected"] and found["b"]["approved"] and found["b"]["as_expected"]


def test_command_line(spark, references, tmp_path, capsys):
    from vicinal.__main__ import parser, run

    _, top = references
    of = lambda *words: run(spark, parser().parse_args([str(w) for w in words]))
    assert of("generate", "--rows", 50, "--out", tmp_path / "g", "--seed", 3, "--mcc", 5411, 5999) == 0
    rows = spark.read.parquet(str(tmp_path / "g"))
    assert rows.count() == 50 and {r["mcc"] for r in rows.collect()} == {5411, 5999}
    assert rows.select("amount_milli").collect() != sources.generate_payloads(spark, 50).select("amount_milli").collect()
    assert of("relabel", "--references", top / "refs.parquet", "--out", tmp_path / "votes") == 0
    assert of("train", "--references", top / "refs.parquet", "--min-leaf", 2, "--out-model", tmp_path / "m", "--out-metrics", tmp_path / "metrics") == 0
    assert of("predict", "--model", tmp_path / "m") == 0 and "legit sample" in capsys.readouterr().out
    request = {"id": "tx-1", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"}, "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": []},
               "merchant": {"id": "M", "mcc": "5411", "avg_amount": 60.25}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None}
    (tmp_path / "set.json").write_text(json.dumps({"entries": [{"request": request, "expected_approved": True, "expected_fraud_score": 0.0}]}))
    assert of("evaluate", "--model", tmp_path / "m", "--test-set", tmp_path / "set.json") == 0 and "weighted_e" in capsys.readouterr().out


def test_benchmark_counts_rows(references):
    from vicinal.operators import forest

    found = jobs.benchmark(forest.fit_tree(references[0], min_leaf=2), references[0], rounds=1)
    assert found["rows"] == 240 and found["us_per_row"] > 0
