"""A query for each operator over the given tables, and its SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal import functions as V
from vicinal import sources, streaming
from vicinal.operators import evaluate, forest, knn, sampling, score
from vicinal.operators.vectorize import dequantize, dimensions, float_dimensions, parse, quarantine
from vicinal.plans import bindings as B
from vicinal.schema import DIMENSIONS, MCC_RISK, SENTINEL
from vicinal.storage import materialise, release, shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# vectors


@query("SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, floor(unnest(embedding)::DOUBLE * 10000 + 0.5)::BIGINT AS q FROM embeddings")
def quantize_vectors(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return e.select("vec_id", "dim", V.quantize_signed(F.col("x")).alias("q"))


@query("""
WITH x AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE * 4 AS x FROM embeddings)
SELECT vec_id, dim, (CASE WHEN x < -1.5 THEN -10000 ELSE greatest(0, least(10000, floor(x * 10000 + 0.5))) END)::BIGINT AS q FROM x""")
def quantize_references(spark, sf_dir):
    """Cut to [0, 1], with -1 for what is far below."""
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    x = F.col("x").cast("double") * 4
    return e.select("vec_id", "dim", F.when(x < -1.5, SENTINEL).otherwise(V.cut_unit(x)).cast("long").alias("q"))


@query("SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, floor(unnest(embedding)::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE AS x FROM embeddings")
def dequantize_vectors(spark, sf_dir):
    r = B.references(spark, sf_dir)
    return r.select(F.col("ref_id").alias("vec_id"), F.posexplode(dequantize(F.col("v"))).alias("dim", "x"))


@query(f"WITH {B.PAIRS_SQL} SELECT query_id, min(dist)::BIGINT AS least, max(dist)::BIGINT AS most, sum(dist)::BIGINT AS total FROM dists GROUP BY query_id")
def pairwise_distance(spark, sf_dir):
    r = B.references(spark, sf_dir)
    return knn.distance_summary(r.select(F.col("ref_id").alias("query_id"), "v"), r, exclude_self=True)


def _nearest(spark, sf_dir, impl):
    r = B.references(spark, sf_dir)
    q = r.select(F.col("ref_id").alias("query_id"), "v").repartition(spark.sparkContext.defaultParallelism, "query_id")
    return knn.knn(q, r, 5, exclude_self=True, impl=impl)


_TOP5 = f"WITH {B.PAIRS_SQL} SELECT query_id, rank, ref_id, dist, label::BIGINT AS label FROM near"


@query(_TOP5)
def knn_top5(spark, sf_dir):
    return _nearest(spark, sf_dir, "auto")


@query(_TOP5)
def knn_blocks(spark, sf_dir):
    return _nearest(spark, sf_dir, "blocks")


@query(f"WITH {B.PAIRS_SQL} SELECT query_id, sum(label)::BIGINT AS fraud_count, sum(label) / 5.0::DOUBLE AS score, (sum(label) >= 3)::INT AS majority FROM near GROUP BY query_id")
def knn_vote(spark, sf_dir):
    return knn.vote(_nearest(spark, sf_dir, "blocks"))


_DISTILLED = f"""WITH {B.PAIRS_SQL}, votes AS (SELECT query_id, sum(label)::BIGINT AS fraud_count FROM near GROUP BY query_id),
distilled AS (SELECT ref_id, label, fraud_count, (fraud_count >= 3)::INT AS y_distilled FROM refs JOIN votes ON ref_id = query_id)"""


@query(f"{_DISTILLED} SELECT * FROM distilled")
def knn_distill(spark, sf_dir):
    return knn.distill(B.references(spark, sf_dir))


@query(f"{_DISTILLED} SELECT count(*) AS n, count(*) FILTER (label <> y_distilled) AS n_changed, count(*) FILTER (label <> y_distilled) / count(*)::DOUBLE AS changed_rate FROM distilled")
def label_agreement(spark, sf_dir):
    return knn.agreement(knn.distill(B.references(spark, sf_dir)))


@query(f"""WITH {B.REFERENCES_SQL}, points AS (SELECT * FROM (VALUES (0, 0), (1, 5000), (2, 10000)) t(query_id, x)),
d AS (SELECT query_id, ref_id, list_sum(list_transform(v, lambda y: (y - x) * (y - x)))::BIGINT AS dist FROM refs, points)
SELECT query_id::BIGINT AS query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id)::INT AS rank, ref_id, dist FROM d QUALIFY rank <= 5""")
def knn_probes(spark, sf_dir):
    """The nearest of fixed points: full order, first five."""
    r = B.references(spark, sf_dir)
    probes = spark.createDataFrame([(i, [x] * 64) for i, x in enumerate((0, 5000, 10_000))], "query_id long, v array<long>")
    return knn.knn(probes, r, 5).select("query_id", "rank", "ref_id", "dist")


# payloads


def _dims(*names):
    cols = ", ".join(names)
    return f"WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL} SELECT key, {cols} FROM vectors"


def _some(spark, sf_dir, *names):
    d = dimensions()
    return B.payloads(spark, sf_dir).select("key", *[d[n].alias(n) for n in names])


@query(_dims("amount", "installments", "amount_vs_avg", "merchant_avg_amount"))
def amount_dims(spark, sf_dir):
    return _some(spark, sf_dir, "amount", "installments", "amount_vs_avg", "merchant_avg_amount")


@query(_dims("hour_of_day", "day_of_week", "minutes_since_last_tx"))
def time_dims(spark, sf_dir):
    return _some(spark, sf_dir, "hour_of_day", "day_of_week", "minutes_since_last_tx")


@query(_dims("unknown_merchant", "mcc_risk", "merchant_avg_amount"))
def merchant_dims(spark, sf_dir):
    return _some(spark, sf_dir, "unknown_merchant", "mcc_risk", "merchant_avg_amount")


@query(f"WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL} SELECT * FROM vectors")
def payload_vector_service(spark, sf_dir):
    return B.vectors(spark, sf_dir)


@query(f"WITH {B.PAYLOADS_SQL}, {B.PRECISE_VECTORS_SQL} SELECT * FROM vectors")
def payload_vector_precise(spark, sf_dir):
    return B.vectors(spark, sf_dir, "precise")


_BACK = "floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0})) * 10000 + 0.5)::BIGINT"
_RISK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MCC_RISK.items())


@query(f"""WITH {B.PAYLOADS_SQL} SELECT key, {_BACK.format('amount / 10000')} AS amount, {_BACK.format('installments / 12::DOUBLE')} AS installments,
  CASE WHEN avg_amount > 0 THEN {_BACK.format('amount / avg_amount / 10')} ELSE 0 END::BIGINT AS amount_vs_avg, {_BACK.format('hour(moment) / 23.0::DOUBLE')} AS hour_of_day,
  {_BACK.format('(isodow(moment) - 1) / 6.0::DOUBLE')} AS day_of_week,
  CASE WHEN last_at IS NULL THEN -10000 ELSE {_BACK.format('(epoch_us(moment) - epoch_us(last_at)) / 1000000.0::DOUBLE / 60.0::DOUBLE / 1440.0::DOUBLE')} END::BIGINT AS minutes_since_last_tx,
  CASE WHEN last_at IS NULL THEN -10000 ELSE {_BACK.format('km_last / 1000')} END::BIGINT AS km_from_last_tx, {_BACK.format('km_home / 1000')} AS km_from_home,
  {_BACK.format('tx_count / 20::DOUBLE')} AS tx_count_24h, (CASE WHEN is_online THEN 10000 ELSE 0 END)::BIGINT AS is_online, (CASE WHEN card_present THEN 10000 ELSE 0 END)::BIGINT AS card_present,
  (CASE WHEN list_contains(known, merchant) THEN 0 ELSE 10000 END)::BIGINT AS unknown_merchant, (CASE mcc {_RISK} ELSE 5000 END)::BIGINT AS mcc_risk,
  {_BACK.format('merchant_avg / 10000')} AS merchant_avg_amount FROM payloads""")
def payload_vector_float(spark, sf_dir):
    return B.payloads(spark, sf_dir).select("key", *[c.alias(n) for n, c in float_dimensions().items()])


@query(f"WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL} SELECT p.mcc, count(*) AS n, min(mcc_risk)::BIGINT AS risk FROM vectors JOIN payloads p USING (key) GROUP BY p.mcc")
def mcc_lookup_join(spark, sf_dir):
    """The category's risk by a join with the table of risks, which is as small as the list of categories."""
    risks = spark.createDataFrame(list(MCC_RISK.items()), "mcc string, risk long")
    p = B.payloads(spark, sf_dir).select(F.col("merchant.mcc").alias("mcc"))
    return p.join(F.broadcast(risks), "mcc", "left").groupBy("mcc").agg(F.count("*").alias("n"), F.min(F.coalesce("risk", F.lit(5000))).cast("long").alias("risk"))


@query(f"WITH {B.PAYLOADS_SQL} SELECT key, NOT list_contains(known, merchant) AS unknown FROM payloads")
def known_merchant_flag(spark, sf_dir):
    return B.payloads(spark, sf_dir).select("key", (V.unknown_merchant(F.col("customer.known_merchants"), F.col("merchant.id")) > 0).alias("unknown"))


@query("""WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, CASE WHEN before IS NULL THEN -1 ELSE greatest(0, epoch_us(ts) // 60000000 - epoch_us(before) // 60000000) END::BIGINT AS minutes,
  CASE WHEN before IS NULL THEN -1 ELSE greatest(0, epoch_us(ts) - epoch_us(before)) // 60000 END::BIGINT AS milli_minutes FROM e""")
def last_tx_gap(spark, sf_dir):
    from pyspark.sql import Window

    e = B.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.select("event_id", "ts", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))
    gap = lambda c: F.when(F.col("before").isNull(), F.lit(-1)).otherwise(c).cast("long")
    return e.select("event_id", gap(V.minutes_between(F.col("before"), F.col("ts"))).alias("minutes"), gap(V.milli_minutes_between(F.col("before"), F.col("ts"))).alias("milli_minutes"))


@query("SELECT event_id, (props->>'k')::INT AS k, (CASE WHEN value > 0 THEN floor(value * 1000 + 0.5) ELSE 0 END)::BIGINT AS amount_milli FROM events")
def json_extract_props(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("p"), "value")
    return e.select("event_id", F.col("p.k").alias("k"), V.to_milli(F.col("value")).alias("amount_milli"))


def _requests(spark, sf_dir):
    """The payloads as JSON text, of which one in seventeen is cut off and one in nineteen lacks its amount."""
    p = B.payloads(spark, sf_dir).withColumn("key", F.col("key"))
    fields = ["id", "transaction", "customer", "merchant", "terminal", "last_transaction"]
    whole = F.to_json(F.struct(*fields))
    value = F.when(F.col("key") % 17 == 0, F.substring(whole, 1, 40)).when(F.col("key") % 19 == 0, F.lit('{"id":"x"}')).otherwise(whole)
    return p.select("key", value.alias("value"))


@query(f"""WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL}, s AS (SELECT key, key % 17 <> 0 AND key % 19 <> 0 AS parse_ok, round((amount_vs_avg + mcc_risk + unknown_merchant) / 30000.0::DOUBLE, 6) AS score FROM vectors)
SELECT key, parse_ok, CASE WHEN parse_ok THEN score ELSE 0.0 END::DOUBLE AS score, (NOT parse_ok OR score < 0.6) AS approved FROM s""")
def malformed_fail_open(spark, sf_dir):
    parsed = parse(_requests(spark, sf_dir))
    scored = streaming.rule_score(parsed.withColumns(dimensions()))
    out = score.fail_open(scored).withColumn("score", F.round("score", 6))
    return out.select("key", "parse_ok", "score", (F.col("score") < 0.6).alias("approved"))


# verdicts


_WIRE = "CASE WHEN score < 0.1 THEN 0.0 WHEN score < 0.3 THEN 0.2 WHEN score < 0.5 THEN 0.4 WHEN score < 0.7 THEN 0.6 WHEN score < 0.9 THEN 0.8 ELSE 1.0 END::DOUBLE"


@query(f"WITH {B.SCORES_SQL} SELECT key, {_WIRE} AS wire_score, {_WIRE} <= 0.4 AS approved_wire FROM scores")
def wire_bucket(spark, sf_dir):
    return score.verdicts(B.scores(spark, sf_dir)).select("key", "wire_score", "approved_wire")


@query(f"WITH {B.SCORES_SQL} SELECT key, score < 0.6 AS approved_service, (score < 0.6) <> ({_WIRE} <= 0.4) AS rules_differ FROM scores")
def threshold_verdict(spark, sf_dir):
    return score.verdicts(B.scores(spark, sf_dir)).select("key", "approved_service", (F.col("approved_service") != F.col("approved_wire")).alias("rules_differ"))


@query(f"WITH {B.SCORES_SQL} SELECT key, score > 0.2 AND score < 0.8 AS uncertain, CASE WHEN score > 0.2 AND score < 0.8 THEN knn_score ELSE score END AS final_score FROM scores")
def hybrid_rule(spark, sf_dir):
    u = score.uncertain(F.col("score"), 0.2, 0.8)
    return B.scores(spark, sf_dir).select("key", u.alias("uncertain"), F.when(u, F.col("knn_score")).otherwise(F.col("score")).alias("final_score"))


@query(f"""WITH {B.SCORES_SQL} SELECT key, '{{"approved":' || ({_WIRE} <= 0.4)::VARCHAR || ',"fraud_score":' || ({_WIRE})::VARCHAR || '}}' AS answer FROM scores""")
def response_json(spark, sf_dir):
    s = score.verdicts(B.scores(spark, sf_dir))
    return s.select("key", score.response(F.col("approved_wire"), F.col("wire_score")).alias("answer"))


# evaluation


_COUNTS = "count(*) FILTER (fraud AND score >= 0.6) AS tp, count(*) FILTER (NOT fraud AND score < 0.6) AS tn, count(*) FILTER (NOT fraud AND score >= 0.6) AS fp, count(*) FILTER (fraud AND score < 0.6) AS fn"


def _confusion(spark, sf_dir):
    return evaluate.confusion(B.scores(spark, sf_dir), F.col("fraud"), F.col("score") >= 0.6)


@query(f"WITH {B.SCORES_SQL} SELECT {_COUNTS} FROM scores")
def confusion_matrix(spark, sf_dir):
    return _confusion(spark, sf_dir)


@query(f"""WITH {B.SCORES_SQL}, c AS (SELECT {_COUNTS} FROM scores)
SELECT *, tp + tn + fp + fn AS n, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, (fp + fn) / (tp + tn + fp + fn)::DOUBLE AS failure_rate, fp + 3 * fn AS weighted_e FROM c""")
def weighted_error(spark, sf_dir):
    return evaluate.weighted_error(_confusion(spark, sf_dir))


@query(f"""WITH {B.SCORES_SQL}, bands AS (SELECT * FROM (VALUES (0.2, 0.8), (0.25, 0.75), (0.3, 0.7), (0.35, 0.65), (0.4, 0.6)) t(lo, hi)),
x AS (SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi, fraud, score > lo::DOUBLE AND score < hi::DOUBLE AS unsure, score >= 0.6 AS denied, knn_score >= 0.6 AS knn_denied FROM scores, bands),
y AS (SELECT *, CASE WHEN unsure THEN knn_denied ELSE denied END AS final FROM x)
SELECT lo, hi, count(*) FILTER (NOT unsure) AS confident, count(*) FILTER (unsure) AS uncertain, count(*) FILTER (NOT unsure AND denied AND NOT fraud) AS certain_fp,
  count(*) FILTER (NOT unsure AND NOT denied AND fraud) AS certain_fn, count(*) FILTER (fraud AND final) AS tp, count(*) FILTER (NOT fraud AND NOT final) AS tn,
  count(*) FILTER (NOT fraud AND final) AS fp, count(*) FILTER (fraud AND NOT final) AS fn FROM y GROUP BY lo, hi""")
def band_sweep(spark, sf_dir):
    return evaluate.band_sweep(B.scores(spark, sf_dir), B.DIMENSION_BANDS)


@query(f"""WITH {B.SCORES_SQL}, c AS (SELECT {_COUNTS} FROM scores),
p AS (SELECT 'legit' AS class, tn / (tn + fn)::DOUBLE AS precision, tn / (tn + fp)::DOUBLE AS recall, tn + fp AS support FROM c
  UNION ALL SELECT 'fraud', tp / (tp + fp)::DOUBLE, tp / (tp + fn)::DOUBLE, tp + fn FROM c),
f AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p),
r AS (SELECT class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support)::DOUBLE, sum(recall * support) / sum(support)::DOUBLE, sum(f1 * support) / sum(support)::DOUBLE, sum(support)::BIGINT FROM f)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM r""")
def classification_report(spark, sf_dir):
    return _rounded(evaluate.classification_report(_confusion(spark, sf_dir)), "precision", "recall", "f1")


@query(f"""WITH {B.SCORES_SQL}, b AS (SELECT score, count(*) FILTER (fraud) AS p, count(*) FILTER (NOT fraud) AS n FROM scores GROUP BY score),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM b WINDOW w AS (ORDER BY score DESC)),
d AS (SELECT *, tp - p AS tp0, fp - n AS fp0 FROM c)
SELECT round((sum((fp - fp0) * (tp + tp0)) / (2.0::DOUBLE * max(tp) * max(fp)))::DOUBLE, 6) AS roc_auc, round((sum((tp - tp0)::DOUBLE * tp / (tp + fp)) / max(tp))::DOUBLE, 6) AS pr_auc FROM d""")
def roc_auc(spark, sf_dir):
    return _rounded(evaluate.auc(B.scores(spark, sf_dir)), "roc_auc", "pr_auc")


@query(f"""WITH {B.SCORES_SQL}, b AS (SELECT score, count(*) FILTER (fraud) AS p, count(*) FILTER (NOT fraud) AS n FROM scores GROUP BY score)
SELECT score, p, n, (sum(p) OVER w)::BIGINT AS tp, (sum(n) OVER w)::BIGINT AS fp FROM b WINDOW w AS (ORDER BY score DESC)""")
def roc_curve(spark, sf_dir):
    return evaluate.curve(B.scores(spark, sf_dir))


_LONG = "long AS (UNPIVOT vectors ON " + ", ".join(DIMENSIONS) + " INTO NAME feature VALUE x)"


@query(f"""WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL}, {_LONG}
SELECT feature, min(x)::BIGINT AS min, max(x)::BIGINT AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(avg(x) FILTER (label = 0), 4) AS legit_mean,
  round(avg(x) FILTER (label = 1), 4) AS fraud_mean, round(avg((x = -10000)::INT), 4) AS sentinel_rate FROM long GROUP BY feature""")
def feature_stats(spark, sf_dir):
    return _rounded(evaluate.feature_stats(B.vectors(spark, sf_dir), DIMENSIONS), "mean", "std", "legit_mean", "fraud_mean", "sentinel_rate", digits=4)


@query(f"""WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL}, s AS (SELECT label, minutes_since_last_tx = -10000 OR km_from_last_tx = -10000 AS has FROM vectors)
SELECT count(*) FILTER (has) AS rows_with_sentinel, round(avg(has::INT), 6) AS rate, round(coalesce(avg(label) FILTER (has), 0), 6) AS fraud_rate_within, round(coalesce(avg(label) FILTER (NOT has), 0), 6) AS fraud_rate_outside FROM s""")
def sentinel_split(spark, sf_dir):
    out = evaluate.sentinel_split(B.vectors(spark, sf_dir), ["minutes_since_last_tx", "km_from_last_tx"])
    return _rounded(out, "rate", "fraud_rate_within", "fraud_rate_outside")


@query("SELECT (label >= 5)::INT AS label, count(*) AS n FROM embeddings GROUP BY 1")
def class_balance(spark, sf_dir):
    return B.references(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT avg((label >= 5)::INT) AS fraud_rate, count(*) AS n FROM embeddings")
def fraud_rate(spark, sf_dir):
    return B.references(spark, sf_dir).agg(F.avg("label").alias("fraud_rate"), F.count("*").alias("n"))


_PAIRED = "(VALUES " + ", ".join(f"('{a}', '{b}')" for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[i:]) + ") t(a, b)"


@query(f"""WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL}, {_LONG}
SELECT t.a, t.b, round(corr(x.x, y.x), 4) + 0.0 AS corr FROM {_PAIRED} JOIN long x ON x.feature = t.a JOIN long y ON y.feature = t.b AND y.key = x.key GROUP BY t.a, t.b""")
def corr_matrix(spark, sf_dir):
    return evaluate.correlation(B.vectors(spark, sf_dir), DIMENSIONS).withColumn("corr", F.round("corr", 4) + F.lit(0.0))


@query(f"WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL}, {_LONG} SELECT feature, label, floor(x / 500.0)::BIGINT AS bin, count(*) AS n FROM long GROUP BY 1, 2, 3")
def feature_histogram(spark, sf_dir):
    return evaluate.histogram(B.vectors(spark, sf_dir), DIMENSIONS)


@query("SELECT bool_or(isnan(x)) AS any_nan, bool_or(isinf(x)) AS any_inf FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def nan_inf_check(spark, sf_dir):
    return evaluate.validity(B.table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x")), F.col("x"))


@query(f"WITH {B.SCORES_SQL} SELECT count(*) AS n, count(*) FILTER (score <= 0.2) AS certain_low, count(*) FILTER (score >= 0.8) AS certain_high, count(*) FILTER (score > 0.2 AND score < 0.8) AS uncertain FROM scores")
def soft_bands(spark, sf_dir):
    return evaluate.soft_bands(B.scores(spark, sf_dir), "score", 0.2, 0.8)


@query("SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99, count(value) AS n FROM events GROUP BY event_type")
def latency_p99(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return evaluate.exact_percentile(e, "value", "event_type", 0.99, "p99").withColumn("p99", F.round("p99", 6))


@query("""WITH s AS (SELECT r_regionkey::BIGINT + 1 AS stage, (r_regionkey::BIGINT + 1) * 24 AS duration, (r_regionkey::BIGINT + 1) * 180 AS target FROM region),
f AS (SELECT *, coalesce(lag(target) OVER (ORDER BY stage), 1) AS from_rate FROM s), t AS (SELECT *, ((from_rate + target) * duration // 2)::BIGINT AS stage_requests FROM f)
SELECT *, (sum(stage_requests) OVER (ORDER BY stage))::BIGINT AS cumulative FROM t""")
def load_schedule(spark, sf_dir):
    n = F.col("r_regionkey").cast("long") + 1
    return evaluate.load_schedule(B.table(spark, sf_dir, "region").select(n.alias("stage"), (n * 24).alias("duration"), (n * 180).alias("target")), 1)


_MEASURED = """m AS (SELECT event_type, quantile_cont(value, 0.99) AS p99, count(*) FILTER (event_id % 3 = 0) AS tp, count(*) FILTER (event_id % 3 <> 0 AND event_id % 50 <> 1) AS tn,
  count(*) FILTER (event_id % 3 <> 0 AND event_id % 100 = 1) AS fp, count(*) FILTER (event_id % 3 <> 0 AND event_id % 100 = 51) AS fn, 0::BIGINT AS errors FROM events GROUP BY event_type)"""


def _measured(spark, sf_dir):
    i = F.col("event_id")
    e = B.table(spark, sf_dir, "events")
    counts = e.groupBy("event_type").agg(
        F.count_if(i % 3 == 0).alias("tp"), F.count_if((i % 3 != 0) & (i % 50 != 1)).alias("tn"),
        F.count_if((i % 3 != 0) & (i % 100 == 1)).alias("fp"), F.count_if((i % 3 != 0) & (i % 100 == 51)).alias("fn"), F.lit(0).cast("long").alias("errors"),
    )
    return counts.join(evaluate.exact_percentile(e, "value", "event_type", 0.99, "p99").drop("n"), "event_type")


@query(f"""WITH {_MEASURED}, c AS (SELECT *, fp + 3 * fn + 5 * errors AS e, tp + tn + fp + fn + errors AS n FROM m),
s AS (SELECT *, CASE WHEN p99 <= 0 THEN 0.0 WHEN p99 > 2000 THEN -3000.0 ELSE 1000 * log10(1000 / greatest(p99, 1.0)) END AS p99_score, (fp + fn + errors) / n::DOUBLE > 0.15 AS detection_cut,
  1000 * log10(1 / greatest(e / n::DOUBLE, 0.001)) - 300 * log10(1 + e) AS d FROM c)
SELECT event_type, e AS weighted_errors, round(p99_score, 4) AS p99_score, detection_cut, round(CASE WHEN detection_cut THEN -3000.0 ELSE d END, 4) AS detection_score,
  round(p99_score + CASE WHEN detection_cut THEN -3000.0 ELSE d END, 4) AS final_score FROM s""")
def detection_score(spark, sf_dir):
    s = evaluate.detection_score(_measured(spark, sf_dir))
    s = s.select("event_type", "weighted_errors", "p99_score", "detection_cut", "detection_score", "final_score")
    return _rounded(s, "p99_score", "detection_score", "final_score", digits=4)


@query(f"""WITH {_MEASURED}, c AS (SELECT *, fp + 3 * fn + 5 * errors AS e, tp + tn + fp + fn + errors AS n FROM m),
s AS (SELECT *, CASE WHEN p99 <= 0 THEN 0.0 WHEN p99 > 2000 THEN -3000.0 ELSE 1000 * log10(1000 / greatest(p99, 1.0)) END::DOUBLE AS p99_score, (fp + fn + errors) / n::DOUBLE AS failing,
  1000 * log10(1 / greatest(e / n::DOUBLE, 0.001)) AS rate, -300 * log10(1 + e) AS penalty FROM c),
d AS (SELECT *, failing > 0.15 AS cut, CASE WHEN failing > 0.15 THEN -3000.0 ELSE rate + penalty END::DOUBLE AS detection FROM s)
SELECT '{{"p99":"' || format('{{:,.2f}}', p99) || 'ms","scoring":{{"breakdown":{{"false_positive_detections":' || fp || ',"false_negative_detections":' || fn || ',"true_positive_detections":' || tp
  || ',"true_negative_detections":' || tn || ',"http_errors":' || errors || '}},"failure_rate":"' || round(failing * 100, 2) || '%","weighted_errors_E":' || e || ',"error_rate_epsilon":' || round(e / n::DOUBLE, 6)
  || ',"p99_score":{{"value":' || round(p99_score, 2) || ',"cut_triggered":' || (p99 > 2000) || '}},"detection_score":{{"value":' || round(detection, 2)
  || CASE WHEN cut THEN '' ELSE ',"rate_component":' || round(rate, 2) || ',"absolute_penalty":' || round(penalty, 2) END || ',"cut_triggered":' || cut || '}},"final_score":' || round(p99_score + detection, 2) || '}}}}' AS result FROM d""")
def result_json(spark, sf_dir):
    return evaluate.result_json(evaluate.detection_score(_measured(spark, sf_dir)))


# samples, generators, sinks


_HASH = "((o_orderkey % 2147483647) * 48271 + 42 * 16807) % 2147483647"


@query(f"""WITH o AS (SELECT o_orderkey AS key, (o_orderkey * 7919 % 100 < 35)::INT AS label, {_HASH} AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h % 1000, h, key) AS r, count(*) OVER (PARTITION BY label) AS n FROM o)
SELECT key, label, r <= floor(n * 0.8::DOUBLE) AS in_train FROM r""")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(B.scores(spark, sf_dir).select("key", F.col("fraud").cast("int").alias("label")), id_column="key")


@query(f"SELECT o_orderkey AS key FROM orders ORDER BY {_HASH}, o_orderkey LIMIT 500")
def hash_sample(spark, sf_dir):
    """A sample of exactly 500 rows: the limit is the operator."""
    return sampling.hash_sample(B.scores(spark, sf_dir).select("key"), 500, "key")


@query("SELECT event_type, round(avg(value) * 1000, 4) AS mean_us, count(value) AS n FROM events GROUP BY event_type")
def latency_means(spark, sf_dir):
    return _rounded(evaluate.latency_means(B.table(spark, sf_dir, "events"), "value", "event_type"), "mean_us", digits=4)


@query("SELECT event_id, event_type FROM events WHERE event_id < 1000")
def input_cap(spark, sf_dir):
    """The first thousand inputs by their number: the cap is the operator."""
    return sampling.cap_by_index(B.table(spark, sf_dir, "events").select("event_id", "event_type"), 1000, "event_id")


def _dealt(salt: int, n: int) -> str:
    return f"((id * 48271 + {salt} * 16807) % 2147483647) % {n}"


@query(f"""WITH i AS (SELECT unnest(range(2000)) AS id)
SELECT id, {_dealt(1, 10_000_000)} AS amount_milli, {_dealt(2, 12)} + 1 AS installments, {_dealt(3, 24)} AS hour, {_dealt(4, 7)} AS day_of_week, {_dealt(5, 5_000_000)} + 10000 AS avg_milli,
  {_dealt(6, 20)} AS tx_count_24h, {_dealt(7, 1_000_000)} AS km_home_milli, {_dealt(8, 5_000_000)} + 10000 AS merchant_avg_milli, id % 2 = 0 AS is_online, id & 2 = 0 AS card_present,
  id & 4 = 0 AS unknown_merchant, id & 8 = 0 AS has_last, {_dealt(9, 1_000_000)} AS km_last_milli, {_dealt(10, 2880)} AS minutes,
  [5411, 5812, 5912, 5944, 7801, 7802, 7995, 4511, 5311, 5999][(id % 10 + 1)::INT]::BIGINT AS mcc, ({_dealt(11, 100)} < 35)::INT AS label FROM i""")
def generated_payloads(spark, sf_dir):
    return sources.generate_payloads(spark, 2000)


@query("""WITH RECURSIVE s AS (SELECT 0::BIGINT AS i, (1 * 1664525 + 1013904223)::BIGINT AS s UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM s WHERE i < 1399)
SELECT i // 14 AS query_id, (i % 14)::INT AS dim, s % 10001 AS x FROM s""")
def generated_queries(spark, sf_dir):
    return sources.generate_queries(spark, 100)


@query("""WITH old AS (SELECT n_name AS participant, 'a' AS submission, n_nationkey::BIGINT AS points FROM nation),
new AS (SELECT n_name AS participant, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS submission, 100 + n_nationkey::BIGINT AS points FROM nation WHERE n_nationkey % 3 = 0)
SELECT coalesce(new.participant, old.participant) AS participant, coalesce(new.submission, old.submission) AS submission, coalesce(new.points, old.points) AS points
FROM old FULL JOIN new ON old.participant = new.participant AND old.submission = new.submission""")
def leaderboard_upsert(spark, sf_dir):
    n, k = B.table(spark, sf_dir, "nation"), F.col("n_nationkey").cast("long")
    old = n.select(F.col("n_name").alias("participant"), F.lit("a").alias("submission"), k.alias("points"))
    new = n.where(k % 3 == 0).select(F.col("n_name").alias("participant"), F.when(k % 2 == 0, "a").otherwise("b").alias("submission"), (k + 100).alias("points"))
    return sources.upsert_results(old, new)


@query(f"{_DISTILLED} SELECT ref_id, label, fraud_count / 5.0::DOUBLE AS soft, y_distilled FROM distilled")
def distilled_labels(spark, sf_dir):
    """Votes joined to their references by id."""
    r = B.references(spark, sf_dir)
    return sources.with_distilled(r.select("ref_id", "label"), knn.distill(r))


# forests: what is learnt has no SQL, what a given node table says has


def _training(spark, sf_dir):
    """The vectors with a label that depends on them, so that there is something to learn. Written once: fits and scores read them many times."""
    v = B.vectors(spark, sf_dir)
    risky = F.col("amount_vs_avg") + F.col("mcc_risk") + F.col("unknown_merchant") + F.col("key") * 7919 % 6000
    return materialise(v.select(F.col("key").alias("ref_id"), F.array(*DIMENSIONS).alias("v"), (risky > 16_000).cast("int").alias("label")))


_LABELLED = f"""{B.PAYLOADS_SQL}, {B.VECTORS_SQL},
labelled AS (SELECT * EXCLUDE (label), (amount_vs_avg + mcc_risk + unknown_merchant + key * 7919 % 6000 > 16000)::INT AS label FROM vectors)"""
_FOREST = B.fixed_forest()
_FOREST_SQL = f"{_LABELLED}, walked AS (SELECT *, {B.forest_sql(_FOREST, DIMENSIONS)} AS score FROM labelled)"


def _stored_forest(spark):
    """The node table as a service has it: written in its binary form, and read."""
    path = shared_path(spark)
    sources.write_forest(spark, _FOREST, path)
    return [tuple(r) for r in sources.read_forest(spark, path).collect()]  # a model's size


def _walked(spark, data):
    walk = forest.walker(_stored_forest(spark))
    return data.select(F.col("ref_id").alias("id"), "v", "label", walk(dequantize(F.col("v"))).alias("score"))


@query(f"WITH {_FOREST_SQL} SELECT key AS id, round(score, 5) AS score, label FROM walked")
def forest_walk(spark, sf_dir):
    """Scores by a stored node table."""
    return _walked(spark, _training(spark, sf_dir)).select("id", F.round("score", 5).alias("score"), "label")


@query(f"WITH {_FOREST_SQL} SELECT key AS id, round(score, 5) AS score FROM walked")
def forest_columns(spark, sf_dir):
    """The same, with the trees as one expression over the feature columns."""
    x = [F.col(d) / 10_000.0 for d in DIMENSIONS]
    return B.vectors(spark, sf_dir).select(F.col("key").alias("id"), F.round(forest.walk_columns(_FOREST, x), 5).alias("score"))


@query(f"""WITH {_FOREST_SQL}, j AS (SELECT key, label = 0 AS wanted, CASE WHEN key % 23 = 0 THEN NULL ELSE round(score, 5) END AS score FROM walked),
o AS (SELECT CASE WHEN score IS NULL THEN 'error' WHEN score < 0.6 AND wanted THEN 'tn' WHEN score < 0.6 THEN 'fn' WHEN wanted THEN 'fp' ELSE 'tp' END AS outcome FROM j)
SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'tn') AS tn, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
  count(*) FILTER (outcome = 'error') AS errors FROM o""")
def expected_outcomes(spark, sf_dir):
    """Predictions met with expectations by request id; one in twenty-three got no answer."""
    scored = _walked(spark, _training(spark, sf_dir)).withColumn("score", F.round("score", 5))
    expected = scored.select("id", (F.col("label") == 0).alias("expected_approved"))
    return evaluate.outcome_counts(evaluate.expectation_join(scored.where("id % 23 <> 0").select("id", "score"), expected))


@query()
def forest_score(spark, sf_dir):
    """A forest learnt on four fifths of the rows, and scores of the others by walking its node table."""
    split = materialise(sampling.stratified_split(_training(spark, sf_dir), id_column="ref_id"))
    model = forest.fit_forest(split.where("in_train").drop("in_train"))
    return forest.predict(model, split.where(~F.col("in_train"))).select("ref_id", "label", "score")


@query()
def forest_soft(spark, sf_dir):
    """A regression forest learnt on the shares of the neighbours' votes, on four fifths of the rows, and its scores of the others."""
    data = _training(spark, sf_dir)
    votes = knn.distill(data)
    soft = materialise(data.join(votes.select("ref_id", (F.col("fraud_count") / 5.0).alias("soft")), "ref_id"))
    split = materialise(sampling.stratified_split(soft, id_column="ref_id"))
    release(spark, data, soft)
    model = forest.fit_soft_forest(split.where("in_train").drop("in_train"))
    return forest.predict(model, split.where(~F.col("in_train"))).select("ref_id", "soft", "score")


@query("SELECT count(*) AS n, 0::BIGINT AS n_differ FROM orders JOIN customer ON o_custkey = c_custkey")
def saved_model(spark, sf_dir):
    """A tree that was saved and loaded says what it said before: rows, and those whose score differs (none)."""
    data, path = _training(spark, sf_dir), shared_path(spark)
    model = forest.fit_tree(data)
    forest.save_model(model, path)
    before, after = forest.predict(model, data).select("ref_id", "score"), forest.predict(forest.load_model(path), data).select("ref_id", F.col("score").alias("again"))
    return before.join(after, "ref_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") != F.col("again")).alias("n_differ"))


@query()
def sample_predictions(spark, sf_dir):
    """The built-in samples under a tree."""
    return forest.predict_samples(forest.fit_tree(_training(spark, sf_dir)), sources.read_samples(spark))


@query()
def tree_report(spark, sf_dir):
    """A single tree on a stratified split, and its report on the held-out part."""
    split = sampling.stratified_split(_training(spark, sf_dir), id_column="ref_id")
    model = forest.fit_tree(split.where("in_train"), balanced=True)
    held = forest.predict(model, split.where(~F.col("in_train")))
    return evaluate.classification_report(evaluate.confusion(held, F.col("label") == 1, F.col("score") >= 0.5))


@query()
def feature_importance(spark, sf_dir):
    return forest.importances(spark, forest.fit_forest(_training(spark, sf_dir)), DIMENSIONS)


@query()
def depth_sweep(spark, sf_dir):
    return forest.depth_sweep(_training(spark, sf_dir))


_HYBRID = f"""WITH {_FOREST_SQL}, asked AS (SELECT * FROM walked WHERE score > 0.2 AND score < 0.8),
near AS (SELECT q.key AS id, unnest(min(({' + '.join(f'(q.{d} - r.{d}) * (q.{d} - r.{d})' for d in DIMENSIONS)}) * 10000000 + r.key, 5)) % 10000000 AS ref_id FROM asked q, labelled r GROUP BY q.key),
votes AS (SELECT id, sum(label) / 5.0::DOUBLE AS knn_score FROM near JOIN labelled ON ref_id = key GROUP BY id),
final AS (SELECT key AS id, label, round(score, 5) AS score, knn_score, coalesce(knn_score, round(score, 5)) AS final_score FROM walked LEFT JOIN votes ON key = id)
SELECT *, final_score < 0.6 AS approved_service, {_WIRE.replace('score', 'final_score')} AS wire_score, {_WIRE.replace('score', 'final_score')} <= 0.4 AS approved_wire FROM final"""


@query(_HYBRID)
def hybrid_score(spark, sf_dir):
    """A stored forest first, neighbours where it is unsure, then both verdicts."""
    data = _training(spark, sf_dir)
    scored = materialise(_walked(spark, data).withColumn("score", F.round("score", 5)))
    return score.verdicts(score.hybrid(scored, data, 0.2, 0.8), "final_score").drop("v")


@query(f"""WITH {B.PAYLOADS_SQL}, {B.VECTORS_SQL}, s AS (SELECT key, key % 17 <> 0 AND key % 19 <> 0 AS parse_ok, (amount_vs_avg + mcc_risk + unknown_merchant) / 30000.0::DOUBLE AS score FROM vectors),
f AS (SELECT CASE WHEN parse_ok THEN 'tx-' || key END AS id, parse_ok, CASE WHEN parse_ok THEN score ELSE 0.0 END::DOUBLE AS score FROM s)
SELECT id, parse_ok, round(score, 6) AS score, score < 0.6 AS approved_service, {_WIRE} AS wire_score, {_WIRE} <= 0.4 AS approved_wire,
  '{{"approved":' || ({_WIRE} <= 0.4)::VARCHAR || ',"fraud_score":' || ({_WIRE})::VARCHAR || '}}' AS answer FROM f""")
def stream_score(spark, sf_dir):
    """Requests written as files, read and answered as a stream until none are left. What id a request that can't be read had is not told."""
    top = shared_path(spark)
    _requests(spark, sf_dir).select("value").write.text(f"{top}/in")
    scored = streaming.score_requests(streaming.requests_from(spark, f"{top}/in"))
    streaming.run_available(scored, f"{top}/out", f"{top}/checkpoint").awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{top}/out").withColumns({"id": F.when(F.col("parse_ok"), F.col("id")), "score": F.round("score", 6)})


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice * 100)::BIGINT AS c FROM lineitem),
w AS (SELECT l_orderkey, l_linenumber, c, l_orderkey % 4 AS kind, c // 100 AS whole, c % 100 AS cents FROM t)
SELECT l_orderkey, l_linenumber, (CASE kind WHEN 0 THEN whole * 1000 + cents * 10 + 1 WHEN 1 THEN (whole * 1000 + cents * 10 + 1) * 100 WHEN 2 THEN (whole * 1000 + cents * 10 + 5) // 10 ELSE 0 END)::BIGINT AS milli FROM w""")
def scanned_numbers(spark, sf_dir):
    """Numbers as they are written, digit by digit: a fourth digit that rounds up, exponents after that, and numbers below zero."""
    c = F.round(F.col("l_extendedprice") * 100).cast("long")
    plain = F.concat(F.expr("div(c, 100)").cast("string"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    kind = F.col("l_orderkey") % 4
    text = F.when(kind == 0, F.concat("plain", F.lit("05"))).when(kind == 1, F.concat("plain", F.lit("07e2"))).when(kind == 2, F.concat("plain", F.lit("0E-1"))).otherwise(F.concat(F.lit("-"), "plain"))
    rows = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.alias("c")).withColumn("plain", plain)
    return rows.select("l_orderkey", "l_linenumber", V.scan_milli(text).alias("milli"))


@query(f"""WITH {B.PAYLOADS_SQL}, n AS (SELECT key, (installments - 1) * CASE WHEN key % 5 = 0 THEN 40 WHEN key % 7 = 0 THEN -1 ELSE 1 END AS i FROM payloads)
SELECT count(*) FILTER (i BETWEEN 0 AND 255) AS fine, count(*) FILTER (NOT i BETWEEN 0 AND 255) AS held_back FROM n""")
def quarantined_requests(spark, sf_dir):
    """Payloads whose numbers no rule covers are kept apart."""
    k, i = F.col("key"), F.col("transaction.installments") - 1
    odd = i * F.when(k % 5 == 0, 40).when(k % 7 == 0, -1).otherwise(1)
    p = B.payloads(spark, sf_dir).withColumn("transaction", F.col("transaction").withField("installments", odd))
    fine, held_back = quarantine(p)
    return fine.select(F.lit(1).alias("f"), F.lit(0).alias("h")).unionByName(held_back.select(F.lit(0).alias("f"), F.lit(1).alias("h"))).agg(F.sum("f").alias("fine"), F.sum("h").alias("held_back"))


def example_payload() -> str:
    """One request as JSON, for trying out."""
    return json.dumps({
        "id": "tx-1", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]}, "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
    })
