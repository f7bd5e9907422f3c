"""Types, constants and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import types as T

#: Fixed-point units of a feature, and the value of a feature that has no previous transaction.
SCALE, SENTINEL = 10_000, -10_000
DIMENSIONS = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last_tx", "km_from_last_tx",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)
#: Risk of a merchant category in units of 1 / SCALE, and of one that isn't listed.
MCC_RISK = {"5411": 1500, "5812": 3000, "5912": 2000, "5944": 4500, "7801": 8000, "7802": 7500, "7995": 8500, "4511": 3500, "5311": 2500, "5999": 5000}
MCC_DEFAULT = 5000
#: The amounts at which a feature is full, in thousandths.
FULL = {"amount": 10_000_000, "installments": 12_000, "hour": 23_000, "day": 6_000, "minutes": 1_440, "km": 1_000_000, "tx_count": 20_000, "merchant_avg": 10_000_000}
RATIO_FULL = 10
NEIGHBOURS = 5
SERVICE_THRESHOLD = 0.6

PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("transaction", T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("installments", T.IntegerType()), T.StructField("requested_at", T.StringType())])),
    T.StructField("customer", T.StructType([T.StructField("avg_amount", T.DoubleType()), T.StructField("tx_count_24h", T.IntegerType()), T.StructField("known_merchants", T.ArrayType(T.StringType()))])),
    T.StructField("merchant", T.StructType([T.StructField("id", T.StringType()), T.StructField("mcc", T.StringType()), T.StructField("avg_amount", T.DoubleType())])),
    T.StructField("terminal", T.StructType([T.StructField("is_online", T.BooleanType()), T.StructField("card_present", T.BooleanType()), T.StructField("km_from_home", T.DoubleType())])),
    T.StructField("last_transaction", T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("km_from_current", T.DoubleType())])),
])
REFERENCE = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType())])
TEST_SET = T.StructType([
    T.StructField("entries", T.ArrayType(T.StructType([T.StructField("request", PAYLOAD), T.StructField("expected_approved", T.BooleanType()), T.StructField("expected_fraud_score", T.DoubleType())]))),
])


@dataclass(frozen=True)
class Config:
    """Settings of a scoring job; ``from_env`` reads them, and takes the default where a value can't be read."""

    hybrid_enabled: bool = True
    band_lo: float = 0.2
    band_hi: float = 0.8
    neighbours: int = NEIGHBOURS
    threshold: float = SERVICE_THRESHOLD
    mode: str = "service"
    on_malformed: str = "approve"

    @classmethod
    def from_env(cls, prefix: str = "VICINAL_", env: dict[str, str] | None = None, dotenv: str | None = None) -> Config:
        env = {**read_dotenv(dotenv), **(os.environ if env is None else env)}
        found = {}
        for f in fields(cls):
            raw, default = env.get(prefix + f.name.upper()), f.default
            if raw:
                try:
                    found[f.name] = _boolean(raw) if isinstance(default, bool) else type(default)(raw)
                except ValueError:
                    continue
        return cls(**found)


def _boolean(raw: str) -> bool:
    if raw.lower() in ("1", "t", "true"):
        return True
    if raw.lower() in ("0", "f", "false"):
        return False
    raise ValueError(raw)


def read_dotenv(path: str | None) -> dict[str, str]:
    """The KEY=value lines of a file; none if it isn't there."""
    if not path or not os.path.exists(path):
        return {}
    with open(path) as lines:
        pairs = (line.strip().split("=", 1) for line in lines if "=" in line and not line.lstrip().startswith("#"))
        return {k.strip().removeprefix("export ").strip(): v.strip().strip("\"'") for k, v in pairs}
