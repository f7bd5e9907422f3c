"""What the operators share: tables written in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal import shipping
from vicinal.storage import materialise, release, shared_dir

__all__ = ["WORD", "crc_of_id", "give_back", "materialise", "release", "shared_dir", "ship", "table"]

#: White space that separates words in every contract here: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of rows that a Python worker is sent at once, so that long texts need no more memory than short ones.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this session ready for Python workers: they get this package, and rows in batches of a bounded size."""
    shipping.ship(spark)
    spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Return what a task has freed to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text, for the label folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
