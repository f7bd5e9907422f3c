"""The given tables as inputs of the operators. What the tables lack is made from their keys in whole
numbers, so that SQL can make the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.functions import quantize_signed
from vicinal.operators.vectorize import as_array, vectorize
from vicinal.schema import MCC_RISK

#: Ten listed categories and one that isn't.
MCCS = (*MCC_RISK, "9999")
DIMENSION_BANDS = ((0.2, 0.8), (0.25, 0.75), (0.3, 0.7), (0.35, 0.65), (0.4, 0.6))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each order, with key (the order) and label. The last transaction is the customer's order before: one
    shuffle by customer, whose orders are few."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (o * 37 % 86_400) * 1_000_000)
    before = Window.partitionBy("o_custkey").orderBy("_at", "o_orderkey")
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    joined = orders.withColumn("_at", at).join(customers, F.col("o_custkey") == F.col("c_custkey")).withColumn("_last", F.lag("_at").over(before))
    merchant = lambda n: F.concat(F.lit("MERC-"), n.cast("string"))
    last = F.when(F.col("_last").isNotNull(), F.struct(iso(F.col("_last")).alias("timestamp"), (o * 29 % 200_000 / 100.0).alias("km_from_current")))
    return joined.select(
        o.alias("key"), ((o * 7919 % 100) < 35).cast("int").alias("label"), F.concat(F.lit("tx-"), o.cast("string")).alias("id"),
        F.struct((F.col("o_totalprice") / 40).alias("amount"), (o % 14 + 1).cast("int").alias("installments"), iso(F.col("_at")).alias("requested_at")).alias("transaction"),
        F.struct(F.abs("c_acctbal").alias("avg_amount"), (o % 25).cast("int").alias("tx_count_24h"), F.array(*[merchant((c + i) % 9) for i in range(3)]).alias("known_merchants")).alias("customer"),
        F.struct(merchant(o % 9).alias("id"), F.element_at(F.array(*map(F.lit, MCCS)), (o % 11 + 1).cast("int")).alias("mcc"), (c * 13 % 1_200_000 / 100.0).alias("avg_amount")).alias("merchant"),
        F.struct((o % 2 == 0).alias("is_online"), (o % 3 != 0).alias("card_present"), (o * 17 % 150_000 / 100.0).alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
    )


PAYLOADS_SQL = """
base AS (
  SELECT o_orderkey AS o, o_custkey AS c, o_totalprice, abs(c_acctbal) AS avg_amount,
    o_orderdate + to_seconds((o_orderkey * 37 % 86400)::BIGINT) AS moment
  FROM orders JOIN customer ON o_custkey = c_custkey),
payloads AS (
  SELECT o AS key, (o * 7919 % 100 < 35)::INT AS label, o_totalprice / 40 AS amount, o % 14 + 1 AS installments, moment,
    avg_amount, o % 25 AS tx_count, c, 'MERC-' || (o % 9) AS merchant, ['MERC-' || (c % 9), 'MERC-' || ((c + 1) % 9), 'MERC-' || ((c + 2) % 9)] AS known,
    ['5411','5812','5912','5944','7801','7802','7995','4511','5311','5999','9999'][(o % 11 + 1)::INT] AS mcc,
    (c * 13 % 1200000) / 100.0::DOUBLE AS merchant_avg, o % 2 = 0 AS is_online, o % 3 <> 0 AS card_present, (o * 17 % 150000) / 100.0::DOUBLE AS km_home,
    lag(moment) OVER (PARTITION BY c ORDER BY moment, o) AS last_at, (o * 29 % 200000) / 100.0::DOUBLE AS km_last
  FROM base)
"""
_MILLI = "(CASE WHEN {0} > 0 THEN floor({0} * 1000 + 0.5) ELSE 0 END)::BIGINT"
_QUANT = "(CASE WHEN ({0}) >= {1} THEN 10000 ELSE (({0}) * 10000 + {1} // 2) // {1} END)::BIGINT"


def milli(x: str) -> str:
    return _MILLI.format(x)


def quant(x: str, full: int) -> str:
    return _QUANT.format(x, full)


def _vector_sql(minutes: str) -> str:
    risk = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MCC_RISK.items())
    return f"""
vectors AS (
  SELECT key, label, {quant(milli('amount'), 10_000_000)} AS amount, {quant('installments * 1000', 12_000)} AS installments,
    (CASE WHEN {milli('avg_amount')} = 0 THEN 0 WHEN {milli('amount')} >= 10 * {milli('avg_amount')} THEN 10000
      ELSE ({milli('amount')} * 10000 + 5 * {milli('avg_amount')}) // (10 * {milli('avg_amount')}) END)::BIGINT AS amount_vs_avg,
    {quant('hour(moment) * 1000', 23_000)} AS hour_of_day, {quant('(isodow(moment) - 1) * 1000', 6_000)} AS day_of_week,
    (CASE WHEN last_at IS NULL THEN -10000 ELSE {minutes} END)::BIGINT AS minutes_since_last_tx,
    (CASE WHEN last_at IS NULL THEN -10000 ELSE {quant(milli('km_last'), 1_000_000)} END)::BIGINT AS km_from_last_tx,
    {quant(milli('km_home'), 1_000_000)} AS km_from_home, {quant('tx_count * 1000', 20_000)} AS tx_count_24h,
    (CASE WHEN is_online THEN 10000 ELSE 0 END)::BIGINT AS is_online, (CASE WHEN card_present THEN 10000 ELSE 0 END)::BIGINT AS card_present,
    (CASE WHEN list_contains(known, merchant) THEN 0 ELSE 10000 END)::BIGINT AS unknown_merchant,
    (CASE mcc {risk} ELSE 5000 END)::BIGINT AS mcc_risk, {quant(milli('merchant_avg'), 10_000_000)} AS merchant_avg_amount
  FROM payloads)
"""


VECTORS_SQL = _vector_sql(quant("greatest(0, epoch_us(moment) // 60000000 - epoch_us(last_at) // 60000000)", 1_440))
PRECISE_VECTORS_SQL = _vector_sql(quant("greatest(0, epoch_us(moment) - epoch_us(last_at)) // 60000", 1_440_000))


def vectors(spark: SparkSession, sf_dir: str, mode: str = "service") -> DataFrame:
    """key, label and the fourteen feature columns of each order's payload."""
    from vicinal.schema import DIMENSIONS

    return vectorize(payloads(spark, sf_dir), mode).select("key", "label", *DIMENSIONS)


def vector_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_array(vectors(spark, sf_dir)).withColumnRenamed("key", "ref_id")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as references: ref_id, v (quantized, of any sign), label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("ref_id"), F.transform("embedding", quantize_signed).alias("v"), (F.col("label") >= 5).cast("int").alias("label"))


REFERENCES_SQL = "refs AS (SELECT vec_id AS ref_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 10000 + 0.5)::BIGINT) AS v, (label >= 5)::INT AS label FROM embeddings)"
PAIRS_SQL = f"""{REFERENCES_SQL},
dists AS (
  SELECT q.ref_id AS query_id, r.ref_id, r.label, list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
  FROM refs q JOIN refs r ON q.ref_id <> r.ref_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id)::INT AS rank FROM dists QUALIFY rank <= 5)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, fraud, score and knn_score (in twentieths and fifths) for each order: a stand-in for a model's, in exact arithmetic."""
    o = F.col("o_orderkey")
    fraud = (o * 7919 % 100) < 35
    lean = F.when(fraud, 6).otherwise(0)
    return table(spark, sf_dir, "orders").select(
        o.alias("key"), fraud.alias("fraud"), ((o * 31 % 15 + lean) / 20.0).alias("score"), ((o * 13 % 4 + F.when(fraud, 2).otherwise(0)) / 5.0).alias("knn_score")
    )


SCORES_SQL = """
scores AS (
  SELECT o_orderkey AS key, o_orderkey * 7919 % 100 < 35 AS fraud,
    (o_orderkey * 31 % 15 + CASE WHEN o_orderkey * 7919 % 100 < 35 THEN 6 ELSE 0 END) / 20.0::DOUBLE AS score,
    (o_orderkey * 13 % 4 + CASE WHEN o_orderkey * 7919 % 100 < 35 THEN 2 ELSE 0 END) / 5.0::DOUBLE AS knn_score
  FROM orders)"""


def fixed_forest(trees: int = 5, depth: int = 4) -> list[tuple[int, int, int, float, int, int, float]]:
    """A node table made by a rule, as one that a service would load: whole trees whose splits and leaves come from their numbers. Leaves
    lean to one side with the features of risk, so that a part of the rows stays uncertain."""
    single = lambda x: float(np.float32(x))  # noqa: E731 - as the binary form keeps it
    rows, risky = [], (2, 11, 12, 0, 7)
    inner = 2**depth - 1
    for t in range(trees):
        for node in range(2 * inner + 1):
            if node < inner:
                rows.append((t, node, risky[(node + t) % len(risky)], single((node * 37 + t * 11) % 7 / 10 + 0.15), 2 * node + 1, 2 * node + 2, 0.0))
            else:
                right = bin(node - inner).count("1")
                rows.append((t, node, -1, 0.0, -1, -1, single(((1, 4, 50, 96, 99)[right] * 10 + (node * 7 + t * 3) % 10) / 1000)))
    return rows


def forest_sql(rows: list[tuple], names: tuple[str, ...]) -> str:
    """The mean of the trees' leaves over columns in units of 1 / 10000."""
    table = {(r[0], r[1]): r[2:] for r in rows}

    def walk(t: int, node: int) -> str:
        feature, threshold, left, right, proba = table[t, node]
        if feature < 0:
            return f"'{proba!r}'::DOUBLE"
        return f"CASE WHEN {names[feature]} / 10000.0::DOUBLE <= '{threshold!r}'::DOUBLE THEN {walk(t, left)} ELSE {walk(t, right)} END"

    trees = sorted({r[0] for r in rows})
    return "(0.0::DOUBLE + " + " + ".join(walk(t, 0) for t in trees) + f") / {len(trees)}.0::DOUBLE"
