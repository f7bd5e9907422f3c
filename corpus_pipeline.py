"""A corpus pipeline: toxic documents go, boilerplate lines go, of near copies one stays, sources are mixed
to their weights, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of ``documents``, whatever these are named, but for names that begin with two underscores, which are reserved.

Defined results: a null text is empty to all stages and stays null. Rows that repeat an id and text lose the same lines, and are one document to
the n-gram join, so one of them stays; of rows alike in these but not in other columns any one. Rows that repeat an id with other texts are
documents of their own. Rows with a null id, and texts without words, are never taken for copies. The mix takes no document without words. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import line_dedup, mixing, ngram_join, packing, toxicity
from vicinal.llm.common import materialise, table
from vicinal.llm.queries import MIN_SITES, tokenizer_path, training_labels


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from the labels outside the held-out fold."""
    scored = toxicity.score_toxicity(docs, training_labels(spark, sf_dir, 5, 0), names=("__toxicity", "__toxic"))
    return scored.where("__toxic = 0").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that stand on many sites, but in the first document that has them. No document goes."""
    cleaned = line_dedup.dedup_lines(docs, MIN_SITES, names=("__lines", "__removed"))
    n_chars = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles of similarity 0.8 or more."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
