"""Readers and writers: payloads, references, packed binary files, forests, results."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators.forest import NODES
from vicinal.operators.vectorize import quantize_references
from vicinal.schema import PAYLOAD, REFERENCE, SCALE, TEST_SET

#: Magic numbers and versions of the binary files.
VECTORS_MAGIC, VECTORS_VERSION, TREE_MAGIC, TREE_V1, TREE_V2 = 0x52494E48, 2, 0x54524545, 1, 2
WIDTH, NODE_BYTES = 14, 20
#: Categories of generated payloads.
MCCS = (5411, 5812, 5912, 5944, 7801, 7802, 7995, 4511, 5311, 5999)
#: The two sample transactions of the task's description, as features.
SAMPLES = [
    ("legit sample", [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1.0, -1.0, 0.0292, 0.15, 0.0, 1.0, 0.0, 0.15, 0.006], "legit"),
    ("fraud sample", [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1.0, -1.0, 0.9523, 1.0, 0.0, 1.0, 1.0, 0.75, 0.0055], "fraud"),
]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array (or lines) of payloads, under the explicit schema."""
    return spark.read.schema(PAYLOAD).option("multiLine", True).json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON as ``value``, unread."""
    return spark.read.text(path)


def read_references(spark: SparkSession, path: str, quantize: bool = True) -> DataFrame:
    """A (gzipped) JSON array of {vector, label} as ref_id, v, label; or the vectors as they are.

    One array is one task whatever its size: convert it once with ``write_references`` and read that.
    """
    rows = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    rows = quantize_references(rows) if quantize else rows.withColumn("label", (F.col("label") == "fraud").cast("int"))
    return rows.withColumn("ref_id", F.monotonically_increasing_id())


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def load_references(spark: SparkSession, parquet: str | None = None, packed: str | None = None, gzip_json: str | None = None) -> DataFrame:
    """The first of the given forms that exists."""
    for path, read in ((parquet, lambda p: spark.read.parquet(p)), (packed, lambda p: read_packed(spark, p)), (gzip_json, lambda p: read_references(spark, p))):
        if path and _exists(spark, path):
            return read(path)
    raise FileNotFoundError("no references at any of the given paths")


def write_references(references: DataFrame, path: str) -> None:
    references.write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str, check_version: bool = True) -> DataFrame:
    """ref_id, v, label, threshold of packed vector files. For import: a file is read whole by one task."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                data = raw.as_py()
                if len(data) < 16:
                    raise ValueError("packed vectors: file too small")
                magic, version, n, width = struct.unpack_from("<4I", data)
                if magic != VECTORS_MAGIC or width != WIDTH or (check_version and version != VECTORS_VERSION):
                    raise ValueError("packed vectors: bad magic, version or width")
                if len(data) < 16 + n * (2 * WIDTH + 1 + 8):
                    raise ValueError("packed vectors: truncated")
                v = np.frombuffer(data, "<i2", n * WIDTH, 16).astype(np.int64)
                labels = np.frombuffer(data, np.uint8, n, 16 + 2 * n * WIDTH)
                thresholds = np.frombuffer(data, "<i8", n, 16 + 2 * n * WIDTH + n)
                for i in range(0, n, 50_000):
                    j = min(n, i + 50_000)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * WIDTH + 1, WIDTH), pa.int32()), pa.array(v[i * WIDTH : j * WIDTH]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, j)), lists, pa.array(labels[i:j].astype(np.int32)), pa.array(thresholds[i:j])], names=["ref_id", "v", "label", "threshold"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "ref_id long, v array<long>, label int, threshold long")


def packed_bytes(vectors: np.ndarray, labels: np.ndarray, thresholds: np.ndarray | None = None) -> bytes:
    """The packed form of a few references, for export and tests."""
    thresholds = np.zeros(len(labels), np.int64) if thresholds is None else thresholds
    head = struct.pack("<4I", VECTORS_MAGIC, VECTORS_VERSION, len(labels), WIDTH)
    return head + vectors.astype("<i2").tobytes() + labels.astype(np.uint8).tobytes() + thresholds.astype("<i8").tobytes()


def forest_bytes(nodes: Sequence[tuple]) -> bytes:
    """The binary form of a node table (rows of ``NODES``): version 1 for one tree, 2 for more."""
    trees: dict[int, list[tuple]] = {}
    for r in sorted(tuple(r) for r in nodes):
        trees.setdefault(r[0], []).append(r[2:])
    body = b"".join(struct.pack("<hhfiif", f, 0, t, left, right, p) for tree in trees.values() for f, t, left, right, p in tree)
    total = sum(map(len, trees.values()))
    if len(trees) == 1:
        return struct.pack("<3I", TREE_MAGIC, TREE_V1, total) + body
    return struct.pack("<4I", TREE_MAGIC, TREE_V2, len(trees), total) + b"".join(struct.pack("<I", len(t)) for t in trees.values()) + body


def write_forest(spark: SparkSession, nodes: Sequence[tuple], path: str) -> None:
    """The binary form of a node table as a file that every machine can read."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(forest_bytes(nodes)))
    out.close()


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """The node table of a binary forest file (either version). A model's size, whatever the data's."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if len(data) < 12 or struct.unpack_from("<I", data)[0] != TREE_MAGIC:
        raise ValueError("forest: too small or bad magic")
    version, n = struct.unpack_from("<2I", data, 4)
    if version == TREE_V1:
        sizes, at = [n], 12
    elif version == TREE_V2:
        total = struct.unpack_from("<I", data, 12)[0]
        sizes, at = list(struct.unpack_from(f"<{n}I", data, 16)), 16 + 4 * n
        if sum(sizes) != total:
            raise ValueError("forest: number of nodes mismatch")
    else:
        raise ValueError(f"forest: unknown version {version}")
    if len(data) < at + sum(sizes) * NODE_BYTES:
        raise ValueError("forest: truncated")
    rows = []
    for tree, size in enumerate(sizes):
        for node in range(size):
            f, _, t, left, right, p = struct.unpack_from("<hhfiif", data, at)
            rows.append((tree, node, f, t, left, right, p))
            at += NODE_BYTES
    return spark.createDataFrame(rows, NODES)


def read_distilled(spark: SparkSession, path: str) -> DataFrame:
    """ref_id and fraud_count of a raw file of counts, one byte for each reference in order."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                counts = np.frombuffer(raw.as_py(), np.uint8).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["ref_id", "fraud_count"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "ref_id long, fraud_count long")


def with_distilled(references: DataFrame, distilled: DataFrame, k: int = 5) -> DataFrame:
    """References with soft (share of votes) and y_distilled, by id and never by position."""
    d = distilled.select("ref_id", (F.col("fraud_count") / float(k)).alias("soft"), (F.col("fraud_count") >= k // 2 + 1).cast("int").alias("y_distilled"))
    return references.join(d, "ref_id")


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a labelled test set: the payload's fields, expected_approved, expected_fraud_score."""
    e = spark.read.schema(TEST_SET).option("multiLine", True).json(path).select(F.explode("entries").alias("e"))
    return e.select("e.request.*", "e.expected_approved", "e.expected_fraud_score")


def _dealt(i: Column, salt: int, n: int) -> Column:
    """A number below n from a row's number, in arithmetic that any SQL has."""
    prime = 2_147_483_647
    return F.pmod(F.pmod(i, F.lit(prime)) * 48_271 + salt * 16_807, F.lit(prime)) % n


def generate_payloads(spark: SparkSession, n: int, fraud_share: int = 35, seed: int = 0, mccs: Sequence[int] = MCCS) -> DataFrame:
    """n payload rows in whole units (amounts and distances in thousandths) with a label, the same on each run and machine. ``fraud_share`` in hundredths;
    another ``seed`` gives other rows; ``mccs`` are the categories in turn."""
    i = F.col("id")
    dealt = lambda salt, below: _dealt(i, salt + 100 * seed, below)
    mcc = F.element_at(F.array(*[F.lit(m) for m in mccs]), (i % len(mccs) + 1).cast("int"))
    return spark.range(n).select(
        "id", dealt(1, 10_000_000).alias("amount_milli"), (dealt(2, 12) + 1).alias("installments"), dealt(3, 24).alias("hour"), dealt(4, 7).alias("day_of_week"),
        (dealt(5, 5_000_000) + 10_000).alias("avg_milli"), dealt(6, 20).alias("tx_count_24h"), dealt(7, 1_000_000).alias("km_home_milli"),
        (dealt(8, 5_000_000) + 10_000).alias("merchant_avg_milli"), (i % 2 == 0).alias("is_online"), (i.bitwiseAND(2) == 0).alias("card_present"),
        (i.bitwiseAND(4) == 0).alias("unknown_merchant"), (i.bitwiseAND(8) == 0).alias("has_last"), dealt(9, 1_000_000).alias("km_last_milli"),
        dealt(10, 2880).alias("minutes"), mcc.cast("long").alias("mcc"), (dealt(11, 100) < fraud_share).cast("int").alias("label"),
    )


def read_samples(spark: SparkSession, path: str | None = None, lines: str | None = None) -> DataFrame:
    """Named samples (name, vector, expected): of a JSON file, of JSON text (as from standard input), or else the built-in ones."""
    kind = "name string, vector array<double>, expected string"
    if path is not None:
        return spark.read.schema(kind).option("multiLine", True).json(path)
    rows = SAMPLES if lines is None else [(x.get("name"), [float(v) for v in x["vector"]], x.get("expected")) for x in json.loads(lines)]
    return spark.createDataFrame(rows, kind)


def warm(df: DataFrame) -> DataFrame:
    """``df`` read into the executors' memory before it is asked for; ``unpersist`` frees it."""
    df.cache().count()
    return df


def progress(spark: SparkSession) -> dict[str, int]:
    """Tasks of the stages that run now, and how many of them are done."""
    tracker = spark.sparkContext.statusTracker()
    stages = [x for s in tracker.getActiveStageIds() if (x := tracker.getStageInfo(s)) is not None]
    return {"stages": len(stages), "tasks": sum(x.numTasks for x in stages), "done": sum(x.numCompletedTasks for x in stages)}


def generate_queries(spark: SparkSession, n: int, width: int = WIDTH) -> DataFrame:
    """query_id, dim, x: the numbers of a linear congruential generator (modulus 2**32) from seed 1, cut to [0, SCALE].

    Row j needs the generator's (j + 1)-th state, which squaring the step's map 32 times at most gives in closed form: each bit of
    j + 1 applies a precomputed power. So rows need not be made in order.
    """
    a, c, powers = 1_664_525, 1_013_904_223, []
    for _ in range(32):
        powers.append((a, c))
        a, c = a * a % 2**32, (a * c + c) % 2**32
    steps, state = F.col("id") + 1, F.lit(1).cast("long")
    # the product of two numbers below 2**32 is made in halves, since it does not fit into a long
    times = lambda x, m: F.pmod(x * (m >> 16), F.lit(65_536)) * 65_536 + x * (m & 65_535)
    rows = spark.range(n * width)
    for bit, (m, add) in enumerate(powers[: max(1, (n * width).bit_length())]):
        rows = rows.withColumn("_s", state) if bit == 0 else rows
        moved = F.pmod(F.pmod(times(F.col("_s"), m), F.lit(2**32)) + add, F.lit(2**32))
        rows = rows.withColumn("_s", F.when(F.shiftright(steps, bit).bitwiseAND(1) == 1, moved).otherwise(F.col("_s")))
    return rows.select(F.floor(F.col("id") / width).cast("long").alias("query_id"), (F.col("id") % width).cast("int").alias("dim"), (F.col("_s") % (SCALE + 1)).alias("x"))


def write_distilled(distilled: DataFrame, path: str) -> None:
    distilled.select("ref_id", "fraud_count", "y_distilled").write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One row of metrics as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def upsert_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """Results by participant and submission, with those of ``new`` in place of or beside the old ones."""
    keys = ["participant", "submission"]
    values = [c for c in results.columns if c not in keys]
    r, n = results.alias("r"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = r.join(n, [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    pick = lambda c: F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    return joined.select(*[pick(c) for c in keys + values])
