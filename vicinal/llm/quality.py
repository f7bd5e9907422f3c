"""Quality by compression: zstandard dictionaries of good and of bad text, and a calibrated score.

Two dictionaries are made of labelled text, one good and one bad. A document is compressed block
by block with each; the normalised difference of the two sizes tells which text it is more like.
A logistic calibration on other labelled documents than the dictionaries' turns this difference, the
compressed share of the text and its length into the probability of label 1.

Defined results: null text is empty; an empty text has difference 0 and gets the calibrated score of
that. Equal texts get equal scores. With fewer than four sampled documents of either label every score is the smoothed
share of label 1 among those. Repeated rows do not matter, nor do extra columns but those named like the result's; null ids take no part in
learning, and an id that stands on rows of several texts teaches with each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Labelled documents of each class at most, of which half make the dictionary and half calibrate.
MAX_PER_CLASS = 1500
#: Bytes of a sample's texts of one class at most, which is beyond what that many documents usually have.
SAMPLE_BYTES = 64 << 20
#: Bytes of a dictionary, and places of the texts that it is taken from where none can be trained.
DICTIONARY_BYTES, SPREAD = 64 * 1024, 256
#: Bytes compressed at once, so that a dictionary counts alike in all parts of a text.
BLOCK = 2048
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: of the features, and the constant first
    coefficients: list[float]
    mean: list[float]
    scale: list[float]


class Scorer:
    """Features and scores of texts under a model; made once for each task."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        self.by = [z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False) if d else None for d in (good, bad)]

    def features(self, text: str | None) -> tuple[float, ...]:
        raw = (text or "").encode()
        if not raw or None in self.by:
            return (0.0, 1.0, 0.0, 0.0)
        good, bad = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in self.by)
        x, share = (bad - good) / max(good, bad), min(good, bad) / len(raw)
        return (x, share, x * share, math.log(len(raw)))


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second and first derivatives of the rows' log-likelihood at coefficients ``w``."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return (x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p)


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, penalty: float) -> np.ndarray:
    """The n coefficients by Newton's method, the constant first and without penalty, from what ``sums`` makes of the rows."""
    w, ridge = np.zeros(n), penalty * np.eye(n)
    ridge[0, 0] = 1e-6
    for _ in range(30):
        hessian, gradient = sums(w)
        step = np.linalg.solve(hessian + ridge, gradient - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's method, the constant first and without penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    return newton(lambda w: slopes(x, y, w), x.shape[1], penalty)


def sample(documents: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], most_bytes: int = SAMPLE_BYTES) -> list:
    """(text, label) of at most so many labelled documents of value 0 and 1, and so many bytes of each, the first by hash of the id:
    the same on each run. Ids are chosen first, so of the texts only those chosen leave their tasks."""
    spark, documents = documents.sparkSession, documents.select("doc_id", "text")
    there = documents.where("text is not null").select("doc_id", F.octet_length("text").alias("_bytes"))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", label).distinct()
    known = known.join(there, "doc_id").groupBy("doc_id", label).agg(F.sum("_bytes").alias("_bytes"))
    chosen = []
    for value in (0, 1):
        size = 0
        for r in known.where(F.col(label) == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[value]).collect():
            size += r["_bytes"]
            if size > most_bytes:
                break
            chosen.append((r["doc_id"], value))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select("doc_id", label).schema)
    ids = F.broadcast(spark.createDataFrame(chosen, kinds))  # sum(most) rows at most
    rows = documents.where("text is not null").join(ids, "doc_id").select("text", label).collect()
    return sorted(rows, key=lambda r: (r[1], zlib.crc32(r[0].encode()), r[0]))


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    return {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}


def dictionary(texts: list[str]) -> bytes:
    """Learnt from the whole texts, cut into blocks as they are compressed; the number of texts bounds it."""
    import zstandard as z

    parts = [raw[i : i + BLOCK] for t in texts for raw in (t.encode(),) for i in range(0, len(raw), BLOCK)]
    total = sum(map(len, parts))
    if total >= 20 * 1024 and len(parts) >= 8:
        try:
            return z.train_dictionary(min(DICTIONARY_BYTES, total // 4), parts, k=200, d=8).as_bytes()
        except z.ZstdError:
            pass
    return spread(parts)


def spread(parts: list[bytes]) -> bytes:
    """A dictionary without training: everything where it fits, else an equal share of each part of the texts."""
    whole = b"\n".join(parts)
    if len(whole) <= DICTIONARY_BYTES:
        return whole
    return b"\n".join(whole[i * len(whole) // SPREAD :][: DICTIONARY_BYTES // SPREAD - 1] for i in range(SPREAD))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> Model:
    """From documents (doc_id, text) and labels (doc_id, quality: 0 or 1, others are left out), of which a bounded sample is used."""
    rows = sample(documents, labels, "quality", (per_class, per_class))
    good, bad = ([r["text"] for r in rows if r["quality"] == v] for v in (1, 0))
    if len(good) < 4 or len(bad) < 4:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
        return Model(b"", b"", [math.log(share / (1 - share))] + [0.0] * 4, [0.0] * 4, [1.0] * 4)
    counts = class_counts(labels, "quality")
    half = lambda v: (v[::2], v[1::2])
    (good_d, good_c), (bad_d, bad_c) = half(good), half(bad)
    model = Model(dictionary(good_d), dictionary(bad_d), [], [], [])
    scorer = Scorer(model.good, model.bad)
    x = np.array([scorer.features(t) for t in good_c + bad_c])
    y = np.array([1.0] * len(good_c) + [0.0] * len(bad_c))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - mean) / scale, y)
    # the sample has other shares of the classes than all labelled rows
    w[0] += math.log(counts[1] / counts[0]) - math.log(len(good_c) / len(bad_c))
    return Model(model.good, model.bad, w.tolist(), mean.tolist(), scale.tolist())


def score_udf(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.good, model.bad)
        w, mean, scale = (np.array(v) for v in (model.coefficients, model.mean, model.scale))
        for texts in batches:
            x = np.array([scorer.features(t) for t in texts]).reshape(len(texts), 4)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + (x - mean) / scale @ w[1:], -30, 30))))

    return score


def score_quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``documents`` with a score (0 to 1) and a prediction (1 from ``threshold`` on), learnt from ``labels`` (doc_id, quality). Columns of
    ``documents`` that have one of ``names`` are replaced; other names keep them."""
    ship(documents.sparkSession)
    score = score_udf(fit(documents, labels))
    scored = documents.withColumn(names[0], score("text"))
    return scored.withColumn(names[1], (F.col(names[0]) >= threshold).cast("int"))
