"""Scoring a stream of requests: text in, answers out, with the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinal.operators.score import fail_open, response, verdicts
from vicinal.operators.vectorize import parse, vectorize
from vicinal.schema import DIMENSIONS, SCALE, Config


def requests_from(spark: SparkSession, path: str, max_files: int = 32) -> DataFrame:
    """Requests as lines of JSON in files as they arrive; ``max_files`` of them at once is the admission control."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def rule_score(vectors: DataFrame) -> DataFrame:
    """A score without a model: the mean of the amount ratio, the category's risk and the unknown merchant."""
    return vectors.withColumn("score", (F.col("amount_vs_avg") + F.col("mcc_risk") + F.col("unknown_merchant")) / float(3 * SCALE))


def score_requests(requests: DataFrame, model: Callable[[DataFrame], DataFrame] = rule_score, config: Config | None = None) -> DataFrame:
    """id, parse_ok, score, verdicts and the answer's JSON for each request. ``model`` adds score to the feature columns; it has no state, so batch and stream
    give the same. A request that can't be read gets the configured answer and never stops the query."""
    config = config or Config()
    vectors = vectorize(parse(requests), config.mode)
    scored = verdicts(fail_open(model(vectors), config.on_malformed), threshold=config.threshold)
    return scored.select("id", "parse_ok", "score", "approved_service", "wire_score", "approved_wire", response(F.col("approved_wire"), F.col("wire_score")).alias("answer"))


def forest_model(walk) -> Callable[[DataFrame], DataFrame]:
    """A model for ``score_requests`` from a walker of a node table."""
    return lambda vectors: vectors.withColumn("score", walk(F.transform(F.array(*DIMENSIONS), lambda x: x / float(SCALE))))


def run_available(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all that has arrived and stop; run again, it goes on from its checkpoint and answers nothing twice."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ready(query: StreamingQuery) -> bool:
    return query.isActive


def health(query: StreamingQuery) -> dict[str, object]:
    """What a probe asks: whether the query runs, what it does now, and rows answered in the last batch."""
    last = query.lastProgress or {}
    return {"ready": query.isActive, "message": query.status["message"], "rows": last.get("numInputRows", 0)}


__all__ = ["forest_model", "health", "ready", "requests_from", "rule_score", "run_available", "score_requests"]
