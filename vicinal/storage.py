"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it Spark drops a query's shuffle files when the query ends, and not when the driver happens to collect garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in only where that is unset and the executors run in this machine.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="vicinal-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder; Hadoop deletes what is there when the driver ends."""
    path = f"{shared_dir(spark)}/vicinal-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: lineage ends there, and a lost
    executor costs nothing that was written. The shuffle files of the query that made it are dropped at its end."""
    spark = df.sparkSession
    path = shared_path(spark)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *written: DataFrame) -> None:
    """Free the disk of tables from ``materialise`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in written:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/vicinal-" in path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
