"""Column functions of fixed-point features and scores; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vicinal.schema import MCC_DEFAULT, MCC_RISK, RATIO_FULL, SCALE, SENTINEL

#: Amounts are cut off here, far above any full scale, so that products fit into a long.
_MOST = 1.0e14


def to_milli(x: Column) -> Column:
    """Thousandths, rounded half up; 0 for what is null, negative, infinite or no number."""
    usable = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when(usable, F.floor(F.least(x, F.lit(_MOST / 1000)) * 1000 + 0.5)).otherwise(F.lit(0)).cast("long")


def scan_milli(text: Column) -> Column:
    """Thousandths of a number as it is written, digit by digit: three digits of the fraction, rounded up from the fourth on 5 or more, and only then
    the exponent, which divides with rounding at each step. Below zero it is 0; null for what doesn't begin like a number."""
    part = lambda i: F.regexp_extract(text, r"^(-?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?)([0-9]+))?", i)
    digits = lambda c: F.coalesce(c.try_cast("long"), F.lit(0))
    value = digits(part(2)) * 1000 + digits(F.rpad(F.substring(part(3), 1, 3), 3, "0")) + (F.substring(part(3), 4, 1) >= "5").cast("long")
    steps = F.least(digits(part(5)), F.lit(18))
    power = F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1)))
    moved = F.when(steps == 0, value).when(part(4) == "-", F.aggregate(power, value, lambda x, _: div(x + 5, 10))).otherwise(
        F.aggregate(power, value, lambda x, _: F.when(x > F.lit(int(_MOST) // 10), F.lit(int(_MOST))).otherwise(x * 10)))
    return F.when(~text.rlike(r"^-?([0-9]|\.[0-9])"), F.lit(None).cast("long")).when(part(1) == "-", F.lit(0).cast("long")).otherwise(F.least(moved, F.lit(int(_MOST))))


def div(a: Column, b: Column | int) -> Column:
    """Whole division of longs."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def quant(n: Column, full: int) -> Column:
    """n / full in units of 1 / SCALE, rounded half up, at most SCALE."""
    if full == 0:
        return F.lit(SCALE).cast("long")
    n = F.greatest(n.cast("long"), F.lit(0))
    return F.when(n >= full, SCALE).otherwise(div(F.least(n, F.lit(full)) * SCALE + full // 2, full)).cast("long")


def amount_ratio(amount: Column, average: Column) -> Column:
    """amount / average over RATIO_FULL, with one rounding; 0 where the average is 0."""
    top = RATIO_FULL * average
    part = div(F.least(amount, top) * SCALE + div(top, 2), F.greatest(top, F.lit(1)))
    return F.when(average == 0, 0).when(amount >= top, SCALE).otherwise(part).cast("long")


def flag(b: Column) -> Column:
    return F.when(b, SCALE).otherwise(0).cast("long")


def unknown_merchant(known: Column, merchant: Column, most: int | None = None) -> Column:
    """Full where the merchant isn't among the known ones (of which the first ``most`` count); a null list knows none."""
    listed = F.slice(known, 1, most) if most else known
    return flag(~F.coalesce(F.array_contains(listed, merchant), F.lit(False)))


def mcc_risk(mcc: Column, numeric: bool = True) -> Column:
    """The category's risk from the table; the category as a number (leading zeros don't matter) or as written."""
    if numeric:
        table = F.create_map(*[F.lit(v) for k, r in MCC_RISK.items() for v in (int(k), r)])
        return F.coalesce(F.element_at(table, mcc.try_cast("int")), F.lit(MCC_DEFAULT)).cast("long")
    table = F.create_map(*[F.lit(v) for k, r in MCC_RISK.items() for v in (k, r)])
    return F.coalesce(F.element_at(table, mcc), F.lit(MCC_DEFAULT)).cast("long")


def minute_of(text: Column) -> Column:
    """The wall-clock minute of an ISO time, whatever follows it; null if it can't be read."""
    return F.try_to_timestamp(F.substring(text, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm"))


def instant_of(text: Column) -> Column:
    """The instant of an ISO time with its zone."""
    return text.try_cast("timestamp")


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes between two wall-clock minutes, 0 at least."""
    minute = lambda t: div(F.unix_seconds(F.date_trunc("minute", t)), 60)
    return F.greatest(F.lit(0).cast("long"), minute(later) - minute(earlier))


def milli_minutes_between(earlier: Column, later: Column) -> Column:
    """Elapsed thousandths of a minute, 0 at least."""
    return div(F.greatest(F.lit(0).cast("long"), F.unix_micros(later) - F.unix_micros(earlier)), 60_000)


def cut_unit(x: Column) -> Column:
    """Cut to [0, 1] and rounded half up; null and what is no number are above all, as in SQL's order."""
    cut = F.greatest(F.lit(0), F.least(F.lit(SCALE), F.floor(x * SCALE + 0.5)))
    return F.when(F.isnan(x), SCALE).otherwise(cut).cast("long")


def quantize_unit(x: Column) -> Column:
    """A reference component: -1 is the sentinel, others are cut to [0, 1] and rounded half up."""
    return F.when(x == -1, SENTINEL).otherwise(cut_unit(x)).cast("long")


def quantize_signed(x: Column) -> Column:
    """A component of any sign, rounded half up, not cut."""
    return F.floor(x.cast("double") * SCALE + 0.5).cast("long")


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)


def squared_distance_of(pairs: list[tuple[Column, Column]]) -> Column:
    """Of vectors held as columns: one sum of products, which generated code does best."""
    total = F.lit(0).cast("long")
    for a, b in pairs:
        total = total + (a - b) * (a - b)
    return total


def wire_score(score: Column) -> Column:
    """The score as the service writes it: the nearest fifth, halves upwards."""
    out = F.lit(1.0)
    for cut, value in ((0.9, 0.8), (0.7, 0.6), (0.5, 0.4), (0.3, 0.2), (0.1, 0.0)):
        out = F.when(score < cut, F.lit(value)).otherwise(out)
    return out


def log_score(p99: Column, fp: Column, fn: Column, errors: Column, n: Column) -> dict[str, Column]:
    """Scores of a load test: latency, detection, and their sum. Cut-offs: 2 s, and 15 % failures."""
    k, slowest, least_p99 = 1000.0, 2000.0, 1.0
    weighted = fp + 3 * fn + 5 * errors
    p99_score = F.when(p99 <= 0, 0.0).when(p99 > slowest, -3000.0).otherwise(k * F.log10(k / F.greatest(p99, F.lit(least_p99))))
    share = F.when(n > 0, weighted / n).otherwise(F.lit(0.0))
    failing = F.when(n > 0, (fp + fn + errors) / n).otherwise(F.lit(0.0))
    rate = k * F.log10(1 / F.greatest(share, F.lit(0.001)))
    penalty = -300.0 * F.log10(1 + weighted.cast("double"))
    cut = failing > 0.15
    detection = F.when(cut, -3000.0).otherwise(rate + penalty)
    return {
        "weighted_errors": weighted, "error_rate": share, "failure_rate": failing, "p99_score": p99_score, "p99_cut": p99 > slowest,
        "rate_component": F.when(~cut, rate), "absolute_penalty": F.when(~cut, penalty), "detection_score": detection, "detection_cut": cut, "final_score": p99_score + detection,
    }
