"""Each stage of the pipeline on its own input, against plain Python; and the queries against their SQL."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_native import plain_dedup
from tests.llm.test_pairs import brute
from tests.llm.test_texts import check_sequences
from vicinal.llm import mixing, packing, queries
from vicinal.llm.common import materialise, table

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, TABLES, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, TABLES))
        out[name] = (docs, after)
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]
    for name, (before, after) in stages.items():
        assert name == "packing" or (after.columns == before.columns and after.dtypes == before.dtypes)


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages["toxicity"]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    words = {"idiot", "moron", "trash", "scum", "loser", "pathetic", "disgusting", "clown", "worthless", "stupid"}
    toxic = [r["doc_id"] for r in before.collect() if len(words & set(r["text"].lower().split())) >= 3]
    assert sum(i not in kept for i in toxic) >= 0.9 * len(toxic) > 0
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, TABLES, "labels").collect()}
    clean = [i for i, x in labels.items() if not x]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    assert sorted((str(r["doc_id"]), r["text"]) for r in after.collect()) == plain_dedup(rows, queries.MIN_SITES)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_join"]
    want = [i for i, _, c in brute([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100) if i == c]
    assert sorted(str(r["doc_id"]) for r in after.collect()) == sorted(want)


def test_mixing_takes_as_planned(stages):
    before, after = stages["mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan_mix(before).collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == +Counter(plan)


def test_packing_loses_nothing(spark, stages):
    before, after = stages["packing"]
    rows = after.collect()
    n = check_sequences(rows)
    cut = packing.pieces(before, queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in cut) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)
    assert n <= sum(r["length"] for r in rows) / 2048 * 1.02 + 2


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r["doc_id"], r["piece"], r["length"], r["ids_crc32"])
    assert sorted(map(key, corpus_pipeline.run(spark, TABLES).collect())) == sorted(map(key, stages["packing"][1].collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{TABLES}/{f}')")
    got = queries.QUERIES[name](spark, TABLES)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_a_row_for_each_input(spark, name):
    if name in ("op3_pack", "op6_top_k"):
        pytest.skip("rows are pieces or neighbours")
    source = "pages" if name.startswith(("op4", "op8")) else "documents"
    assert queries.QUERIES[name](spark, TABLES).count() == table(spark, TABLES, source).count()


def tables_of(spark, path, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, n_lines double, n_removed int")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_run_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables_of(spark, tmp_path, [], [])).count() == 0


def test_stages_keep_clashing_columns_null_texts_and_repeated_ids(spark, tmp_path):
    text = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    of = lambda i, t, source="s": (i, t, "en", source, len(t or ""), 9.5, "yes", 7.25, -3)
    rows = [of(1, text("a")), of(2, text("a") + " end"), of(2, text("b")), of(3, None), of(None, text("c")), of(4, ""), of(5, text("d")), of(5, text("d")), of(6, text("e"), None), of(None, None)]
    path = tables_of(spark, tmp_path, rows, [(1, 1, 0), (2, 0, None), (None, 1, 1)])
    docs = table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, docs, path))
        assert after.columns == docs.columns and all((r["score"], r["predicted"], r["n_lines"], r["n_removed"]) == (9.5, "yes", 7.25, -3) for r in after.collect()), name
        if name == "ngram_join":
            # 2 with the text of 1 goes, 2 with a text of its own stays, of the rows that repeat 5 one stays
            want = [of(1, text("a")), of(2, text("b")), of(3, None), of(None, text("c")), of(4, ""), of(5, text("d")), of(6, text("e"), None), of(None, None)]
            assert sorted(map(repr, map(tuple, after.collect()))) == sorted(map(repr, want))
        docs = after
    assert {r["text"] for r in docs.collect()} <= {text(x) for x in "abcde"} and docs.count() >= 4
    pieces = corpus_pipeline.run(spark, path)
    assert Counter(r["doc_id"] for r in pieces.collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_rows_that_repeat_are_dealt_to_packers(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "")] * 300, "doc_id long, text string").repartition(3)
    cut = materialise(packing.pieces(docs, queries.tokenizer_path("word_bpe_49k.json")))
    packed = packing.pack(cut, 2048, 50).collect()
    assert check_sequences(packed) <= 6 and len({r["sequence_id"] for r in packed}) > 1
