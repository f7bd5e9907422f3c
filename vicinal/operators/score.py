"""Verdicts from scores, and the hybrid of forest and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal import functions as V
from vicinal.operators import knn as K
from vicinal.schema import SERVICE_THRESHOLD


def verdicts(df: DataFrame, score: str = "score", threshold: float = SERVICE_THRESHOLD) -> DataFrame:
    """Both rules: approved_service (score below the threshold) and wire_score with approved_wire (the nearest fifth, 0.4 at most)."""
    out = df.withColumns({"approved_service": F.col(score) < threshold, "wire_score": V.wire_score(F.col(score))})
    return out.withColumn("approved_wire", F.col("wire_score") <= 0.4)


def uncertain(score: Column, lo: float, hi: float) -> Column:
    """Inside the open band; scores on its ends are trusted."""
    return (score > lo) & (score < hi)


def hybrid(scored: DataFrame, references: DataFrame, lo: float = 0.2, hi: float = 0.8, k: int = 5, mode: str = "hybrid", id_column: str = "id") -> DataFrame:
    """``scored`` (id, v, score from the forest) with knn_score (where asked for) and final_score.

    Only the uncertain rows are searched for neighbours: a filter before the search, since Spark does not promise to skip a
    branch of a CASE. ``mode``: hybrid, forest or knn.
    """
    if mode == "forest":
        return scored.withColumns({"knn_score": F.lit(None).cast("double"), "final_score": F.col("score")})
    asked = scored if mode == "knn" else scored.where(uncertain(F.col("score"), lo, hi))
    votes = K.vote(K.knn(asked.select(F.col(id_column).alias("query_id"), "v"), references, k), k)
    votes = votes.select(F.col("query_id").alias(id_column), F.col("score").alias("knn_score"))
    return scored.join(votes, id_column, "left").withColumn("final_score", F.coalesce("knn_score", "score"))


def fail_open(df: DataFrame, on_malformed: str = "approve", score: str = "score") -> DataFrame:
    """Rows that could not be read: approved with score 0, or left out of both."""
    value = F.lit(0.0) if on_malformed == "approve" else F.lit(None).cast("double")
    return df.withColumn(score, F.when(F.col("parse_ok"), F.col(score)).otherwise(value))


def response(approved: Column, score: Column) -> Column:
    """The JSON body of an answer."""
    return F.to_json(F.struct(approved.alias("approved"), score.alias("fraud_score")))
