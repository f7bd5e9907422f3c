"""Golden vectors, both modes, and the edges of the fixed-point functions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vicinal import functions as V
from vicinal.operators.vectorize import dequantize, parse, quantize_references, vectorize
from vicinal.schema import DIMENSIONS, REFERENCE, SENTINEL, Config, read_dotenv

S = SENTINEL
LEGIT = {
    "id": "tx-1329056812", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]}, "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
}
FRAUD = {
    "id": "tx-3330991687", "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]}, "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27}, "last_transaction": None,
}


def changed(base: dict, **parts) -> dict:
    out = json.loads(json.dumps(base))
    for name, values in parts.items():
        out[name] = values if not isinstance(out.get(name), dict) or values is None else out[name] | values
    return out


def vector(spark, *payloads, mode="service"):
    df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "i long, value string")
    return [tuple(r[n] for n in DIMENSIONS) for r in vectorize(parse(df), mode).orderBy("i").collect()]


@pytest.mark.parametrize("mode", ["service", "precise"])
def test_golden_vectors(spark, mode):
    assert vector(spark, LEGIT, FRAUD, mode=mode) == [
        (41, 1667, 500, 7826, 3333, S, S, 292, 1500, 0, 10000, 0, 1500, 60),
        (9506, 8333, 10000, 2174, 8333, S, S, 9523, 10000, 0, 10000, 10000, 7500, 55),
    ]


def test_last_transaction_by_minute_and_by_second(spark):
    p = changed(LEGIT, transaction={"requested_at": "2026-03-11T18:45:10Z"}, last_transaction={"timestamp": "2026-03-11T18:44:50Z", "km_from_current": 42.5})
    assert vector(spark, p)[0][5:7] == (7, 425)  # another wall-clock minute
    assert vector(spark, p, mode="precise")[0][5:7] == (2, 425)  # a third of a minute
    day = changed(p, last_transaction={"timestamp": "2026-03-10T18:45:10Z", "km_from_current": 0.0})
    after = changed(p, last_transaction={"timestamp": "2026-03-12T18:45:10Z", "km_from_current": -1.0})
    assert [v[5:7] for v in vector(spark, day, after)] == [(10000, 0), (0, 0)]


def test_zone_counts_in_precise_mode_only(spark):
    p = changed(LEGIT, transaction={"requested_at": "2026-03-11T18:45:53-03:00"})
    assert vector(spark, p)[0][3] == 7826 and vector(spark, p, mode="precise")[0][3] == 9130


def test_merchants_and_categories(spark):
    many = [f"M{i}" for i in range(33)]
    p = changed(LEGIT, customer={"known_merchants": many}, merchant={"id": "M32", "mcc": "05411"})
    assert vector(spark, p)[0][11:13] == (10000, 1500) and vector(spark, p, mode="precise")[0][11:13] == (0, 5000)
    none, null, odd = changed(LEGIT, customer={"known_merchants": []}), changed(LEGIT, customer={"known_merchants": None}), changed(LEGIT, merchant={"mcc": "x"})
    assert [v[11:13] for v in vector(spark, none, null, odd)] == [(10000, 1500), (10000, 1500), (0, 5000)]


def test_clamps(spark):
    p = changed(LEGIT, transaction={"amount": 1e300, "installments": 300}, customer={"avg_amount": 0.0, "tx_count_24h": 99}, terminal={"km_from_home": -5.0})
    v = vector(spark, p)[0]
    assert (v[0], v[1], v[2], v[7], v[8]) == (10000, 10000, 0, 0, 10000)


def test_malformed_requests_do_not_stop(spark):
    rows = ["", "{", "null", '{"id": "a"}', json.dumps(changed(LEGIT, transaction={"requested_at": "2026-13-40T99:99:99Z"})), json.dumps(LEGIT)]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "value string")
    assert sorted(r[0] for r in vectorize(parse(df)).select("parse_ok").collect()) == [False] * 6 + [True]


def test_to_milli_and_quant(spark):
    df = spark.createDataFrame([(x,) for x in (None, float("nan"), float("inf"), -1.0, 0.0005, 1.2344, 1.2345)], "x double")
    assert [r[0] for r in df.select(V.to_milli(F.col("x"))).collect()] == [0, 0, 0, 0, 1, 1234, 1235]
    whole = spark.range(1).select(V.quant(F.lit(-5), 10).alias("a"), V.quant(F.lit(1), 3).alias("b"), V.quant(F.lit(7), 0).alias("c"), V.quant(F.lit(3), 3).alias("d"))
    assert tuple(whole.first()) == (0, 3333, 10000, 10000)


def test_reference_quantization(spark):
    df = spark.createDataFrame([([-1.0, 0.0041, -0.5, 1.2], "fraud"), ([0.5], "else")], REFERENCE)
    assert [(r["v"], r["label"]) for r in quantize_references(df).collect()] == [([S, 41, 0, 10000], 1), ([5000], 0)]
    assert quantize_references(df).select(dequantize(F.col("v"))).first()[0] == [-1.0, 0.0041, 0.0, 1.0]


def test_config(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nVICINAL_BAND_LO=0.3\nexport VICINAL_MODE='precise'\n")
    got = Config.from_env(env={"VICINAL_NEIGHBOURS": "x", "VICINAL_HYBRID_ENABLED": "false"}, dotenv=str(env))
    assert got == Config(hybrid_enabled=False, band_lo=0.3, mode="precise") and read_dotenv("/none") == {}
