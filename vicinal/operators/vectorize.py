"""From transaction payloads to feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal import functions as V
from vicinal.schema import DIMENSIONS, FULL, PAYLOAD, SCALE, SENTINEL

#: Known merchants that the service looks at.
SERVICE_MERCHANTS = 32


def parse(requests: DataFrame, column: str = "value") -> DataFrame:
    """The payload's fields and parse_ok: whether the JSON has what scoring needs. Other columns stay."""
    fields = [f.name for f in PAYLOAD]
    parsed = requests.withColumn("_p", F.from_json(F.col(column), PAYLOAD))
    parsed = parsed.select(*[c for c in requests.columns if c not in (column, *fields)], *[F.col(f"_p.{f}").alias(f) for f in fields])
    needed = ["transaction.amount", "transaction.installments", "transaction.requested_at", "customer.avg_amount", "merchant.id", "merchant.mcc"]
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    return parsed.withColumn("parse_ok", F.coalesce(ok & V.minute_of(F.col("transaction.requested_at")).isNotNull(), F.lit(False)))


def dimensions(mode: str = "service") -> dict[str, Column]:
    """The fourteen features of a payload.

    ``service`` reads wall-clock minutes and numbers of categories, as the running service does;
    ``precise`` counts seconds and zones, takes categories as written and looks at all known merchants.
    """
    if mode not in ("service", "precise"):
        raise ValueError(mode)
    service = mode == "service"
    tx, customer, merchant, terminal, last = (F.col(c) for c in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    time_of = V.minute_of if service else V.instant_of
    at, before = time_of(tx["requested_at"]), time_of(last["timestamp"])
    amount, average = V.to_milli(tx["amount"]), V.to_milli(customer["avg_amount"])
    if service:
        minutes = V.quant(V.minutes_between(before, at), FULL["minutes"])
    else:
        minutes = V.quant(V.milli_minutes_between(before, at), FULL["minutes"] * 1000)
    with_last = lambda c: F.when(last.isNull(), SENTINEL).otherwise(F.coalesce(c, F.lit(0))).cast("long")
    thousandths = lambda c: F.coalesce(c, F.lit(0)).cast("long") * 1000
    return dict(
        zip(
            DIMENSIONS,
            (
                V.quant(amount, FULL["amount"]),
                V.quant(thousandths(tx["installments"]), FULL["installments"]),
                V.amount_ratio(amount, average),
                V.quant(thousandths(F.hour(at)), FULL["hour"]),
                V.quant(thousandths(F.weekday(at)), FULL["day"]),
                with_last(minutes),
                with_last(V.quant(V.to_milli(last["km_from_current"]), FULL["km"])),
                V.quant(V.to_milli(terminal["km_from_home"]), FULL["km"]),
                V.quant(thousandths(customer["tx_count_24h"]), FULL["tx_count"]),
                V.flag(terminal["is_online"]),
                V.flag(terminal["card_present"]),
                V.unknown_merchant(customer["known_merchants"], merchant["id"], SERVICE_MERCHANTS if service else None),
                V.mcc_risk(merchant["mcc"], numeric=service),
                V.quant(V.to_milli(merchant["avg_amount"]), FULL["merchant_avg"]),
            ),
            strict=True,
        )
    )


def vectorize(payloads: DataFrame, mode: str = "service") -> DataFrame:
    """``payloads`` with a column for each feature: one projection, no array, no Python."""
    return payloads.withColumns(dimensions(mode))


def as_array(vectors: DataFrame, name: str = "v") -> DataFrame:
    """The feature columns as one array."""
    return vectors.withColumn(name, F.array(*DIMENSIONS)).drop(*DIMENSIONS)


def float_dimensions() -> dict[str, Column]:
    """The features as plain ratios cut to [0, 1], rounded to SCALE at the end: the form that offline evaluation uses. Times are instants with
    their zones, whose hour and weekday are read in the session's time zone (UTC here); a time that can't be read gives nulls."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    back = lambda c: F.greatest(F.lit(0), F.least(F.lit(SCALE), F.floor(clamp(c) * SCALE + 0.5))).cast("long")
    tx, customer, merchant, terminal, last = (F.col(c) for c in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    at, before, average = V.instant_of(tx["requested_at"]), V.instant_of(last["timestamp"]), or_zero(customer["avg_amount"])
    minutes = (F.unix_micros(at) - F.unix_micros(before)) / 1_000_000.0 / 60.0
    with_last = lambda c: F.when(last.isNull(), SENTINEL).otherwise(back(c)).cast("long")
    return {
        "amount": back(tx["amount"] / 10_000), "installments": back(tx["installments"] / 12), "amount_vs_avg": back(F.when(average > 0, tx["amount"] / average / 10).otherwise(F.lit(0.0))),
        "hour_of_day": back(F.hour(at) / 23.0), "day_of_week": back(F.weekday(at) / 6.0), "minutes_since_last_tx": with_last(minutes / 1440.0),
        "km_from_last_tx": with_last(or_zero(last["km_from_current"]) / 1000), "km_from_home": back(terminal["km_from_home"] / 1000), "tx_count_24h": back(customer["tx_count_24h"] / 20),
        "is_online": V.flag(terminal["is_online"]), "card_present": V.flag(terminal["card_present"]), "unknown_merchant": V.unknown_merchant(customer["known_merchants"], merchant["id"]),
        "mcc_risk": V.mcc_risk(merchant["mcc"], numeric=False), "merchant_avg_amount": back(or_zero(merchant["avg_amount"]) / 10_000),
    }


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed payloads that can be scored, and those whose numbers no rule covers: installments or counts below zero or beyond a byte, amounts
    below zero or no numbers. A null counts as zero and is no reason."""
    tx, customer = F.col("transaction"), F.col("customer")
    byte = lambda c: F.coalesce(c.between(0, 255), F.lit(True))
    number = lambda c: F.coalesce((c >= 0) & ~F.isnan(c) & (c < float("inf")), F.lit(True))
    fine = byte(tx["installments"]) & byte(customer["tx_count_24h"]) & number(tx["amount"]) & number(customer["avg_amount"])
    return parsed.where(fine), parsed.where(~fine)


def quantize_references(references: DataFrame) -> DataFrame:
    """``vector`` (array of double) as ``v`` (array of long), and label 1 for fraud, else 0."""
    return references.withColumns({"v": F.transform("vector", V.quantize_unit), "label": (F.col("label") == "fraud").cast("int")}).drop("vector")


def dequantize(v: Column) -> Column:
    return F.transform(v, lambda x: x / float(SCALE))
