"""The offline jobs end to end: prepare references, relabel them, train, evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal import sources
from vicinal.operators import evaluate, forest, knn, sampling
from vicinal.operators.vectorize import as_array, vectorize

#: Score from which a row counts as fraud, by what was learnt: hard labels, or shares of votes.
HARD_THRESHOLD, SOFT_THRESHOLD = 0.5, 0.6


def prepare(spark: SparkSession, json_path: str, parquet_path: str) -> DataFrame:
    """References from their JSON array, quantized, as Parquet."""
    sources.write_references(sources.read_references(spark, json_path), parquet_path)
    return spark.read.parquet(parquet_path)


def relabel(references: DataFrame, path: str, k: int = 5) -> DataFrame:
    """Votes of each reference's nearest others, written by id."""
    sources.write_distilled(knn.distill(references, k), path)
    return references.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Training:
    model: object
    #: One row: rows, shares, confusion, accuracy, weighted error, areas under the curves.
    metrics: DataFrame
    held_out: DataFrame


def train(references: DataFrame, algorithm: str = "rf", distilled: DataFrame | None = None, trees: int = 30, max_depth: int = 25, min_leaf: int = 50, share: float = 0.8, threshold: float | None = None) -> Training:
    """Fit on a stratified share and measure on the rest.

    ``algorithm``: dt, rf or rf-soft, which learns the shares of the votes. With ``distilled`` the votes' majority replaces the
    label; the labels measured against are those learnt.
    """
    data = references
    if distilled is not None:
        votes = distilled.select("ref_id", (F.col("fraud_count") / 5.0).alias("soft"), F.col("y_distilled"))
        data = data.join(votes, "ref_id").withColumn("label", F.col("y_distilled")).drop("y_distilled")
    if algorithm == "rf-soft" and distilled is None:
        raise ValueError("rf-soft learns from distilled labels")
    fits: dict[str, Callable] = {
        "dt": lambda d: forest.fit_tree(d, max_depth=max_depth, min_leaf=min_leaf),
        "rf": lambda d: forest.fit_forest(d, trees=trees, max_depth=max_depth, min_leaf=min_leaf),
        "rf-soft": lambda d: forest.fit_soft_forest(d, trees=trees, max_depth=max_depth, min_leaf=min_leaf),
    }
    split = sampling.stratified_split(data, share, id_column="ref_id")
    model = fits[algorithm](split.where("in_train").drop("in_train"))
    held = forest.predict(model, split.where(~F.col("in_train")).drop("in_train"))
    least = threshold if threshold is not None else (SOFT_THRESHOLD if algorithm == "rf-soft" else HARD_THRESHOLD)
    judged = held.withColumn("fraud", F.col("label") == 1)
    counts = evaluate.weighted_error(evaluate.confusion(judged, F.col("fraud"), F.col("score") >= least))
    metrics = counts.crossJoin(F.broadcast(evaluate.auc(judged))).withColumns({"algorithm": F.lit(algorithm), "threshold": F.lit(float(least))})  # one row by one row
    return Training(model, metrics, held)


def evaluate_bands(scored: DataFrame, references: DataFrame, bands: list[tuple[float, float]], threshold: float = 0.6) -> DataFrame:
    """Confident and uncertain rows, and errors, of each band, the uncertain answered by neighbours. ``scored``: id, v, score, fraud."""
    votes = knn.vote(knn.knn(scored.select(F.col("id").alias("query_id"), "v"), references))
    answered = scored.join(votes.select(F.col("query_id").alias("id"), F.col("score").alias("knn_score")), "id")
    return evaluate.band_sweep(answered, bands, threshold=threshold)


def judge(model, test_set: DataFrame, threshold: float = 0.6) -> DataFrame:
    """The outcome of each entry of a test set (payload fields, expected_approved) under a model, met by request id."""
    vectors = as_array(vectorize(test_set))
    return evaluate.expectation_join(forest.predict(model, vectors).select("id", "score"), test_set.select("id", "expected_approved"), threshold=threshold)


def benchmark(model, data: DataFrame, rounds: int = 3) -> dict[str, float]:
    """Rows, and microseconds a row that scoring all of ``data`` (ref_id, v) takes, the best of some rounds; nothing is written or collected."""
    import time

    n, best = data.count(), float("inf")
    for _ in range(rounds):
        began = time.perf_counter()
        forest.predict(model, data).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return {"rows": float(n), "us_per_row": best * 1e6 / max(n, 1)}
