"""Verdicts, hybrids, evaluation, samples, forests, files and streams."""

from __future__ import annotations

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal import sources, streaming
from vicinal.operators import evaluate, forest, sampling, score
from vicinal.plans.queries import example_payload
from vicinal.schema import DIMENSIONS, Config


def scored(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<long>, score double")


def test_two_rules_differ_between_half_and_three_fifths(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.29, 0.3, 0.49, 0.5, 0.55, 0.6, 0.9, 1.0)], "score double")
    got = [(r["approved_service"], r["wire_score"], r["approved_wire"]) for r in score.verdicts(df).collect()]
    assert [g[1] for g in got] == [0.0, 0.2, 0.2, 0.4, 0.4, 0.6, 0.6, 0.6, 1.0, 1.0]
    assert [a for a, _, _ in got] == [True] * 7 + [False] * 3 and [c for _, _, c in got] == [True] * 5 + [False] * 5


def test_hybrid_band_is_open_and_asks_only_the_uncertain(spark):
    refs = spark.createDataFrame([(i, [i, i], int(i > 4)) for i in range(10)], "ref_id long, v array<long>, label int")
    df = scored(spark, [(0, [0, 0], 0.2), (1, [9, 9], 0.8), (2, [9, 9], 0.5), (3, [0, 0], 0.5)])
    rows = {r["id"]: (r["knn_score"], r["final_score"]) for r in score.hybrid(df, refs).collect()}
    assert rows == {0: (None, 0.2), 1: (None, 0.8), 2: (1.0, 1.0), 3: (0.0, 0.0)}
    assert {r["final_score"] for r in score.hybrid(df, refs, mode="forest").collect()} == {0.2, 0.8, 0.5}
    assert score.hybrid(df, refs, mode="knn").where("knn_score is null").count() == 0


def test_detection_score_and_cuts(spark):
    df = spark.createDataFrame([(1.05, 24037, 30022, 0, 0, 0), (0.0, 1, 1, 0, 0, 0), (2500.0, 10, 10, 5, 5, 0), (1.0, 0, 0, 0, 0, 0)], "p99 double, tp long, tn long, fp long, fn long, errors long")
    got = evaluate.detection_score(df).collect()
    assert round(got[0]["final_score"], 2) == 5978.81 and got[1]["p99_score"] == 0.0
    assert (got[2]["p99_score"], got[2]["detection_score"], got[2]["rate_component"]) == (-3000.0, -3000.0, None) and got[3]["detection_score"] == 3000.0
    body = json.loads(evaluate.result_json(evaluate.detection_score(df)).first()[0])
    assert body["p99"] == "1.05ms" and body["scoring"]["detection_score"]["value"] == 3000.0


def test_curves_and_report(spark):
    random.seed(3)
    rows = [(i, random.random() < 0.4, random.choice([0.1, 0.2, 0.5, 0.6, 0.9])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, fraud boolean, score double")
    pos, neg = [s for _, f, s in rows if f], [s for _, f, s in rows if not f]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert evaluate.auc(df).first()["roc_auc"] == pytest.approx(want)
    counts = evaluate.confusion(df, F.col("fraud"), F.col("score") >= 0.6)
    report = {r["class"]: r for r in evaluate.classification_report(counts).collect()}
    assert report["fraud"]["support"] == len(pos) and report["macro avg"]["support"] == 300
    empty = evaluate.classification_report(evaluate.confusion(df.limit(0), F.col("fraud"), F.col("score") >= 0.6)).collect()
    assert all(r["f1"] == 0.0 for r in empty)


def test_load_schedule(spark):
    stages = spark.createDataFrame([(1, 120, 900)], "stage long, duration long, target long")
    assert evaluate.load_schedule(stages, 1).first()["cumulative"] == 54_060


def test_split_takes_the_share_of_each_label_and_reruns_agree(spark):
    df = spark.range(1003).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    once, again = (sorted((r["id"], r["in_train"]) for r in sampling.stratified_split(d).collect()) for d in (df, df.repartition(7)))
    assert once == again and sum(t for _, t in once) == int(251 * 0.8) + int(752 * 0.8)
    assert sampling.hash_sample(df, 100).count() == 100 and sampling.hash_sample(df, 5000).count() == 1003


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 10_001, (600, 14))
    rows = [(i, [int(x) for x in r], int(r[0] + r[2] > 11_000)) for i, r in enumerate(v)]
    data = spark.createDataFrame(rows, "ref_id long, v array<long>, label int")
    return data, forest.fit_forest(data, trees=5, max_depth=6, min_leaf=3)


def test_node_table_walks_like_the_model_and_survives_its_file(spark, trained, tmp_path):
    data, model = trained
    rows = forest.node_rows(model)
    ours = data.select("ref_id", forest.walker(rows)(F.transform("v", lambda x: x / 10_000.0)).alias("s"))
    theirs = {r["ref_id"]: r["score"] for r in forest.predict(model, data).collect()}
    assert all(abs(theirs[r["ref_id"]] - r["s"]) < 1e-9 for r in ours.collect())
    path = tmp_path / "forest.bin"
    path.write_bytes(sources.forest_bytes(rows))
    back = [tuple(r) for r in sources.read_forest(spark, str(path)).orderBy("tree", "node").collect()]
    assert len(back) == len(rows) and all(a[:3] == b[:3] and a[4:6] == b[4:6] and abs(a[6] - b[6]) < 1e-6 for a, b in zip(back, rows, strict=True))
    path.write_bytes(path.read_bytes()[:-5])
    with pytest.raises(ValueError, match="truncated"):
        sources.read_forest(spark, str(path))


def test_single_tree_importances_and_sweep(spark, trained):
    data, model = trained
    tree = forest.fit_tree(data, max_depth=4, min_leaf=5, balanced=True)
    assert forest.node_rows(tree)[0][:2] == (0, 0) and "If" in forest.tree_text(tree)
    top = [r["feature"] for r in forest.importances(spark, model, DIMENSIONS).limit(2).collect()]
    assert set(top) == {"amount", "amount_vs_avg"}
    sweep = forest.depth_sweep(data, depths=(1, 5), folds=2, min_leaf=2)
    assert forest.best_depth(sweep).first()["max_depth"] == 5


def test_packed_vectors_and_distilled_counts(spark, tmp_path):
    v, labels = np.arange(28).reshape(2, 14), np.array([1, 0])
    (tmp_path / "v.bin").write_bytes(sources.packed_bytes(v, labels))
    rows = sources.read_packed(spark, str(tmp_path / "v.bin")).orderBy("ref_id").collect()
    assert [(r["v"], r["label"]) for r in rows] == [(v[0].tolist(), 1), (v[1].tolist(), 0)]
    (tmp_path / "bad.bin").write_bytes(struct.pack("<4I", 1, 2, 0, 14))
    with pytest.raises(Exception, match="bad magic"):
        sources.read_packed(spark, str(tmp_path / "bad.bin")).collect()
    (tmp_path / "d.bin").write_bytes(bytes([5, 2]))
    joined = sources.with_distilled(sources.read_packed(spark, str(tmp_path / "v.bin")), sources.read_distilled(spark, str(tmp_path / "d.bin")))
    assert [(r["soft"], r["y_distilled"]) for r in joined.orderBy("ref_id").collect()] == [(1.0, 1), (0.4, 0)]
    assert sources.load_references(spark, parquet=str(tmp_path / "none"), packed=str(tmp_path / "v.bin")).count() == 2
    with pytest.raises(FileNotFoundError):
        sources.load_references(spark, parquet=str(tmp_path / "none"))


def test_json_sources(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps([{"vector": [0.1] * 14, "label": "fraud"}, {"vector": [-1] * 14, "label": "legit"}]))
    refs = sources.read_references(spark, str(tmp_path / "refs.json"))
    assert [r["v"][0] for r in refs.orderBy("label").collect()] == [-10_000, 1000]
    (tmp_path / "set.json").write_text(json.dumps({"entries": [{"request": json.loads(example_payload()), "expected_approved": True, "expected_fraud_score": 0.0}], "stats": {}}))
    assert sources.read_test_set(spark, str(tmp_path / "set.json")).first()["expected_approved"] is True
    (tmp_path / "payloads.json").write_text(f"[{example_payload()}]")
    assert sources.read_payloads(spark, str(tmp_path / "payloads.json")).first()["merchant"]["mcc"] == "5411"


def test_generated_queries_are_the_generator(spark):
    seed, want = 1, []
    for _ in range(70):
        seed = (seed * 1_664_525 + 1_013_904_223) % 2**32
        want.append(seed % 10_001)
    got = sources.generate_queries(spark, 5).orderBy("query_id", "dim").collect()
    assert [r["x"] for r in got] == want


def test_stream_answers_as_batch_does_and_only_once(spark, tmp_path):
    lines = [example_payload(), "{broken", ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    answers = streaming.score_requests(streaming.requests_from(spark, str(tmp_path / "in")))
    for _ in range(2):
        query = streaming.run_available(answers, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        assert not streaming.ready(query) and not streaming.health(query)["ready"]
    batch = streaming.score_requests(sources.read_requests(spark, str(tmp_path / "in")))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(spark.read.schema(answers.schema).parquet(str(tmp_path / "out"))) == rows(batch)
    quarantined = streaming.score_requests(sources.read_requests(spark, str(tmp_path / "in")), config=Config(on_malformed="quarantine"))
    assert quarantined.where("score is null").count() == quarantined.where("not parse_ok").count() > 0


def test_percentiles_of_each_group_are_exact(spark, monkeypatch):
    import numpy as np

    from vicinal.operators import evaluate

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=5000), "b": np.round(rng.random(700), 1), "c": np.array([4.0]), "d": np.array([1.0, 2.0]), "e": rng.exponential(size=333), None: rng.random(50)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    for sketch in (10_000, 100):
        monkeypatch.setattr(evaluate, "SKETCH", sketch)
        for q in (0.0, 0.5, 0.99, 1.0):
            got = {r["g"]: (r["p"], r["n"]) for r in evaluate.exact_percentile(df, "x", "g", q, "p").collect()}
            assert set(got) == set(groups)
            for g, xs in groups.items():
                assert abs(got[g][0] - float(np.quantile(xs, q))) < 1e-12 and got[g][1] == len(xs), (sketch, q, g)


def test_curve_of_many_scores(spark):
    import numpy as np

    from vicinal.operators import evaluate

    rng = np.random.default_rng(4)
    s, y = rng.random(3000).round(3), rng.random(3000) < 0.4
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y, strict=True)], "score double, fraud boolean")
    for r in evaluate.curve(df).collect():
        assert (r["tp"], r["fp"]) == (int((y & (s >= r["score"])).sum()), int((~y & (s >= r["score"])).sum()))
    pairs = (s[y][:, None] > s[~y][None]).mean() + 0.5 * (s[y][:, None] == s[~y][None]).mean()
    assert abs(evaluate.auc(df).first()["roc_auc"] - pairs) < 1e-9
    assert evaluate.auc(df.where("fraud")).first()["roc_auc"] is None and evaluate.curve(df.limit(0)).count() == 0


def test_expectations_are_met_by_id(spark):
    from vicinal.operators import evaluate

    scored = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.2), ("d", 0.7), ("a", 0.95), ("x", 0.5)], "id string, score double")
    expected = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", False), ("e", True)], "id string, expected_approved boolean")
    found = {r["id"]: r["outcome"] for r in evaluate.expectation_join(scored, expected).collect()}
    assert found == {"a": "tn", "b": "fp", "c": "fn", "d": "tp", "e": "error"}


def test_numbers_as_written(spark):
    from vicinal import functions as V

    cases = {"1": 1000, "1.5": 1500, "1.2344": 1234, "1.2345": 1235, "-3": 0, "12e2": 1200000, "1.2345e1": 12350, "15e-1": 1500, "1.0005E-1": 100, "0.0004": 0, ".5": 500, "7.": 7000, "x": None, "": None, "9e30": 10**14, "1e-30": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["m"] for r in df.select("t", V.scan_milli(F.col("t")).alias("m")).collect()} == cases
