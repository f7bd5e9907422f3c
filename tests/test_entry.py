"""The driver's entry: names match, and queries give what their SQL gives on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from vicinal.operators import forest
from vicinal.plans.queries import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
QUICK = ["quantize_vectors", "knn_blocks", "payload_vector_service", "malformed_fail_open", "band_sweep", "feature_stats", "corr_matrix", "stratified_split", "detection_score"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_like_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TABLES}/{f}')")
    got = QUERIES[name](spark, TABLES)
    columns = sorted(got.columns)
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    number = lambda r: tuple(float(x) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(number, (tuple(r) for r in got.select(*columns).collect())))) == sorted(map(repr, map(number, cursor.fetchall())))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 500


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_forests_are_registered_whole(spark, monkeypatch):
    assert [r["max_depth"] for r in QUERIES["depth_sweep"](spark, TABLES).collect()] == [8, 12, 16, 20, 24, 28]
    made = []
    for name in ("fit_forest", "fit_soft_forest"):
        monkeypatch.setattr(forest, name, lambda *a, _fit=getattr(forest, name), **kw: made.append(_fit(*a, **kw)) or made[-1])
    for name in ("feature_importance", "forest_soft"):
        QUERIES[name](spark, TABLES)
    assert [(m.getNumTrees, m.getOrDefault("maxDepth")) for m in made] == [(30, 25)] * 2


def test_references_are_cut_as_sql_cuts_them(spark, tmp_path):
    """A component of exactly -1 (times 4) isn't far below; so are edges, no numbers, and nulls."""
    path = str(tmp_path / "embeddings.parquet")
    odd = [-0.25, -0.375, -0.3750001, 0.0, 0.25, 3.0, -3.0, float("nan"), float("inf"), float("-inf"), None, 1e30]
    spark.createDataFrame([(1, odd), (2, []), (3, None)], "vec_id long, embedding array<float>").write.parquet(path)
    wanted = duckdb.sql(ORACLES["quantize_references"].replace("FROM embeddings", f"FROM read_parquet('{path}/*.parquet')")).fetchall()
    got = QUERIES["quantize_references"](spark, str(tmp_path)).select("vec_id", "dim", "q").collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and (1, 0, 0) in wanted
