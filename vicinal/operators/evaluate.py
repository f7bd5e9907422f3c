"""How well scores and verdicts do, and what the vectors look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal import functions as V
from vicinal.storage import materialise

#: Ranges of scores for running sums, and the accuracy of a percentile's sketch.
RANGES, SKETCH = 64, 10_000
_REPORT = ("precision", "recall", "f1", "support")


def confusion(df: DataFrame, expected: Column, denied: Column, *by: str) -> DataFrame:
    """tp, tn, fp, fn; positive is denied."""
    return df.groupBy(*by).agg(
        F.count_if(expected & denied).alias("tp"), F.count_if(~expected & ~denied).alias("tn"), F.count_if(~expected & denied).alias("fp"), F.count_if(expected & ~denied).alias("fn")
    )


def weighted_error(counts: DataFrame, errors: Column | None = None) -> DataFrame:
    """``counts`` with n, accuracy and weighted_e: a false positive counts 1, a false negative 3, an error 5."""
    errors = F.lit(0) if errors is None else errors
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + errors
    return counts.withColumns({
        "n": n, "accuracy": F.when(n > 0, (F.col("tp") + F.col("tn")) / n).otherwise(0.0),
        "failure_rate": F.when(n > 0, (F.col("fp") + F.col("fn") + errors) / n).otherwise(0.0), "weighted_e": F.col("fp") + 3 * F.col("fn") + 5 * errors,
    })


def band_sweep(df: DataFrame, bands: Sequence[tuple[float, float]], score: str = "score", expected: str = "fraud", oracle: str = "knn_score", threshold: float = 0.6) -> DataFrame:
    """For each band: confident and uncertain rows, errors among the confident, and the confusion if the uncertain are answered by ``oracle``.

    The bands are a handful of literals, so each row is counted for all of them in one pass without a join.
    """
    s, fraud = F.col(score), F.col(expected)
    wide = df.select(
        F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in bands])).alias("band"), s.alias("s"), fraud.alias("f"), F.col(oracle).alias("o")
    )
    unsure = (F.col("s") > F.col("band.lo")) & (F.col("s") < F.col("band.hi"))
    denied, final = F.col("s") >= threshold, F.when(unsure, F.col("o")).otherwise(F.col("s")) >= threshold
    return wide.groupBy(F.col("band.lo").alias("lo"), F.col("band.hi").alias("hi")).agg(
        F.count_if(~unsure).alias("confident"), F.count_if(unsure).alias("uncertain"),
        F.count_if(~unsure & denied & ~F.col("f")).alias("certain_fp"), F.count_if(~unsure & ~denied & F.col("f")).alias("certain_fn"),
        F.count_if(F.col("f") & final).alias("tp"), F.count_if(~F.col("f") & ~final).alias("tn"),
        F.count_if(~F.col("f") & final).alias("fp"), F.count_if(F.col("f") & ~final).alias("fn"),
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of both classes, and their macro and weighted means, from one row of counts."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))

    def line(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        p, r = ratio(hit, hit + wrong), ratio(hit, hit + missed)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), (hit + missed).cast("long").alias("support"))

    two = counts.select(line("legit", tn, fn, fp).alias("a"), line("fraud", tp, fp, fn).alias("b"))
    total = F.col("a.support") + F.col("b.support")
    means = lambda weight: [ratio(F.col(f"a.{m}") * weight("a") + F.col(f"b.{m}") * weight("b"), weight("a") + weight("b")).alias(m) for m in _REPORT[:3]]
    macro = F.struct(F.lit("macro avg").alias("class"), *means(lambda _: F.lit(1.0)), total.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("class"), *means(lambda x: F.col(f"{x}.support").cast("double")), total.alias("support"))
    return two.select(F.explode(F.array("a", "b", macro, weighted)).alias("r")).select("r.*")


def curve(df: DataFrame, score: str = "score", expected: str = "fraud") -> DataFrame:
    """For each distinct score, from high to low: rows, and true and false positives if it is the threshold.

    Rows are summed by score first. Scores may be as many as rows, so the running sums are made in ranges of scores, which approximate
    quantiles cut: each range in a task, and one row for each range to say what lies above it.
    """
    by = materialise(df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(expected)).alias("p"), F.count_if(~F.col(expected)).alias("n")))
    cuts = sorted(set(by.approxQuantile("score", [i / RANGES for i in range(1, RANGES)], 0.2 / RANGES)))  # a few numbers
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    ranged = by.withColumn("_range", place)
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    sums = sums.select("_range", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_fp"))
    down = Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = ranged.join(F.broadcast(sums), "_range")  # RANGES rows
    return whole.select("score", "p", "n", (F.col("_tp") + F.sum("p").over(down)).alias("tp"), (F.col("_fp") + F.sum("n").over(down)).alias("fp"))


def auc(df: DataFrame, score: str = "score", expected: str = "fraud") -> DataFrame:
    """roc_auc by trapezoids and pr_auc as average precision; null where one of the classes is missing."""
    steps = curve(df, score, expected).withColumns({"tp0": F.col("tp") - F.col("p"), "fp0": F.col("fp") - F.col("n")})
    area = F.try_divide(F.sum((F.col("fp") - F.col("fp0")) * (F.col("tp") + F.col("tp0"))), 2.0 * F.max("tp") * F.max("fp"))
    precise = F.try_divide(F.sum((F.col("tp") - F.col("tp0")) * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("tp"))
    return steps.agg(area.alias("roc_auc"), precise.alias("pr_auc"))


def exact_percentile(df: DataFrame, value: str, by: str, q: float, name: str = "percentile") -> DataFrame:
    """``by``, name and n: the percentile of each group, between two values where it falls between them, as if all were sorted.

    A sketch of each group tells a narrow range that the percentile is in. What lies below is counted, and only the distinct values
    within are put in order, so no task holds a group. Null values do not count.
    """
    wide = 2.0 / SKETCH
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    about = rows.groupBy(by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", [max(q - wide, 0.0), min(q + wide, 1.0)], SKETCH).alias("_b"))
    about = materialise(about)
    marked = rows.join(about, rows[by].eqNullSafe(about[by])).select(about[by], "_v", "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    # beside the range the values next to it: a sketch's rank may be one off in a small group
    outer = marked.groupBy(by).agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.max(F.when(F.col("_v") < F.col("_lo"), F.col("_v"))).alias("_before"), F.min(F.when(F.col("_v") > F.col("_hi"), F.col("_v"))).alias("_after"), F.first("_n").alias("n"))
    counts = marked.where(inside).groupBy(by, "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy("_v"))
    ranked = counts.withColumn("_upto", upto).alias("c").join(outer.alias("o"), F.col(f"c.{by}").eqNullSafe(F.col(f"o.{by}")))
    at = (F.col("n") - 1) * F.lit(q)
    def pick(i: str) -> Column:
        within = F.min(F.when(F.col("_upto") > F.col(i) - F.col("_below"), F.col("_v")))
        return F.coalesce(F.when(F.first(i) < F.first("_below"), F.first("_before")), within, F.first("_after"))

    ranked = ranked.select(F.col(f"o.{by}").alias(by), "_v", "_upto", "_below", "_before", "_after", "n", F.floor(at).alias("lo_i"), F.ceil(at).alias("hi_i"), (at - F.floor(at)).alias("_part"))
    two = ranked.groupBy(by).agg(
        pick("lo_i").alias("_a"), pick("hi_i").alias("_z"), F.first("_part").alias("_part"), F.first("n").alias("n")
    )
    return two.select(by, (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_part")).alias(name), "n")


def _turned(wide: DataFrame, names: Sequence[str], columns: Sequence[str], first: str = "feature") -> DataFrame:
    """One row of columns ``name|column`` as a row for each name."""
    rows = [F.struct(F.lit(n).alias(first), *[F.col(f"`{n}|{c}`").alias(c) for c in columns]) for n in names]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def feature_stats(vectors: DataFrame, names: Sequence[str], label: str = "label", sentinel: int = -10_000) -> DataFrame:
    """min, max, mean, population deviation, mean by label and rate of sentinels for each feature column: each row is read once, as it is."""
    of = lambda n: {
        "min": F.min(n), "max": F.max(n), "mean": F.avg(n), "std": F.stddev_pop(n), "legit_mean": F.avg(F.when(F.col(label) == 0, F.col(n))),
        "fraud_mean": F.avg(F.when(F.col(label) == 1, F.col(n))), "sentinel_rate": F.avg((F.col(n) == sentinel).cast("int")),
    }
    wide = vectors.agg(*[c.alias(f"{n}|{k}") for n in names for k, c in of(n).items()])
    return _turned(wide, names, list(of(names[0])))


def sentinel_split(vectors: DataFrame, columns: Sequence[str], label: str = "label", sentinel: int = -10_000) -> DataFrame:
    """Rows with a sentinel in any of ``columns``, and the fraud rate within and outside them (0 where there are none)."""
    has = F.lit(False)
    for c in columns:
        has = has | (F.col(c) == sentinel)
    rate = lambda cond: F.coalesce(F.avg(F.when(cond, F.col(label))), F.lit(0.0))
    return vectors.agg(
        F.count_if(has).alias("rows_with_sentinel"), F.avg(has.cast("int")).alias("rate"), rate(has).alias("fraud_rate_within"), rate(~has).alias("fraud_rate_outside")
    )


def correlation(vectors: DataFrame, names: Sequence[str], centre: int = 5000) -> DataFrame:
    """Pearson correlation of each pair of feature columns, as rows; a constant feature gives null. One pass of sums and products about
    ``centre``, the middle of a feature's range; the rest is arithmetic on one row."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moved = vectors.select(*[(F.col(n) - centre).cast("double").alias(n) for n in names])
    wide = moved.agg(F.count("*").cast("double").alias("n"), *[F.sum(n).alias(f"s|{n}") for n in names], *[F.sum(F.col(a) * F.col(b)).alias(f"p|{a}|{b}") for a, b in pairs])
    s, p = (lambda a: F.col(f"`s|{a}`")), (lambda a, b: F.col(f"`p|{a}|{b}`"))
    spread = lambda a: F.col("n") * p(a, a) - s(a) * s(a)
    there = lambda a: spread(a) > 1e-12 * F.col("n") * p(a, a)
    corr = lambda a, b: F.when(there(a) & there(b), (F.col("n") * p(a, b) - s(a) * s(b)) / F.sqrt(spread(a) * spread(b)))
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(a, b).alias("corr")) for a, b in pairs]))
    return wide.select(rows.alias("r")).select("r.*")


def histogram(vectors: DataFrame, names: Sequence[str], label: str = "label", width: int = 500) -> DataFrame:
    """Rows for each feature, label and bin of ``width``: the class-conditional density."""
    long = vectors.select(label, F.expr(f"stack({len(names)}, {', '.join(f"'{n}', `{n}`" for n in names)}) as (feature, x)"))
    return long.groupBy("feature", label, F.floor(F.col("x") / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def soft_bands(df: DataFrame, score: str, lo: float, hi: float) -> DataFrame:
    """How many scores are surely low, surely high and neither."""
    s = F.col(score)
    return df.agg(F.count("*").alias("n"), F.count_if(s <= lo).alias("certain_low"), F.count_if(s >= hi).alias("certain_high"), F.count_if((s > lo) & (s < hi)).alias("uncertain"))


def expectation_join(scored: DataFrame, expected: DataFrame, id_column: str = "id", score: str = "score", threshold: float = 0.6) -> DataFrame:
    """Predictions beside what was expected (id, expected_approved), by request id: approved, outcome (tp, tn, fp, fn; error where no
    prediction came) for each expected request. Of a request that was answered more than once the least score counts."""
    answers = scored.groupBy(F.col(id_column).alias("_id")).agg(F.min(score).alias("score"))
    joined = expected.select(F.col(id_column), "expected_approved").join(answers, F.col(id_column) == F.col("_id"), "left").drop("_id")
    approved, wanted = F.col("score") < threshold, F.col("expected_approved")
    outcome = F.when(F.col("score").isNull(), "error").when(approved & wanted, "tn").when(approved, "fn").when(wanted, "fp").otherwise("tp")
    return joined.withColumns({"approved": approved, "outcome": outcome})


def latency_means(df: DataFrame, milliseconds: str, *by: str) -> DataFrame:
    """Mean microseconds of a sample, and samples, for each of ``by``. Null values do not count."""
    return df.groupBy(*by).agg((F.avg(milliseconds) * 1000).alias("mean_us"), F.count(milliseconds).alias("n"))


def outcome_counts(judged: DataFrame) -> DataFrame:
    """tp, tn, fp, fn and errors of ``expectation_join``'s outcomes."""
    return judged.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("tp", "tp"), ("tn", "tn"), ("fp", "fp"), ("fn", "fn"), ("error", "errors"))])


def load_schedule(stages: DataFrame, start_rate: int) -> DataFrame:
    """Requests of each stage (stage, duration, target) of a ramp, and their running total."""
    order = Window.orderBy("stage")
    before = F.coalesce(F.lag("target").over(order), F.lit(start_rate))
    out = stages.withColumn("from_rate", before)
    out = out.withColumn("stage_requests", V.div((F.col("from_rate") + F.col("target")) * F.col("duration"), 2).cast("long"))
    return out.withColumn("cumulative", F.sum("stage_requests").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def detection_score(measured: DataFrame) -> DataFrame:
    """``measured`` (p99, tp, tn, fp, fn, errors) with the scores of a load test."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("errors")
    return measured.withColumns(V.log_score(F.col("p99"), F.col("fp"), F.col("fn"), F.col("errors"), n))


def result_json(scored: DataFrame) -> DataFrame:
    """The nested result of a load test as one JSON column."""
    r = lambda c, n=2: F.round(F.col(c), n)
    body = F.struct(
        F.concat(F.format_number("p99", 2), F.lit("ms")).alias("p99"),
        F.struct(
            F.struct(F.col("fp").alias("false_positive_detections"), F.col("fn").alias("false_negative_detections"), F.col("tp").alias("true_positive_detections"), F.col("tn").alias("true_negative_detections"), F.col("errors").alias("http_errors")).alias("breakdown"),
            F.concat(F.round(F.col("failure_rate") * 100, 2).cast("string"), F.lit("%")).alias("failure_rate"), F.col("weighted_errors").alias("weighted_errors_E"), r("error_rate", 6).alias("error_rate_epsilon"),
            F.struct(r("p99_score").alias("value"), F.col("p99_cut").alias("cut_triggered")).alias("p99_score"),
            F.struct(r("detection_score").alias("value"), r("rate_component").alias("rate_component"), r("absolute_penalty").alias("absolute_penalty"), F.col("detection_cut").alias("cut_triggered")).alias("detection_score"),
            r("final_score").alias("final_score"),
        ).alias("scoring"),
    )
    return scored.select(F.to_json(body).alias("result"))


def validity(vectors: DataFrame, x: Column) -> DataFrame:
    """Whether any value is no number or infinite."""
    return vectors.agg(F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)).alias("any_nan"), F.coalesce(F.bool_or(F.abs(x) == float("inf")), F.lit(False)).alias("any_inf"))
