"""N-gram join, components and top-k search, against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.llm import knn_join, ngram_join
from vicinal.llm.components import components
from vicinal.llm.kernels import shingle_sets, texts_of


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute(rows, k, num, den):
    """(id as text, size, component) of each row, sorted."""
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if sets[i] and find(j) == find(i) and rows[j][0] is not None]
        out.append((str(doc), len(sets[i]), str(min(ids, default=None) if sets[i] else doc)))
    return sorted(out)


def joined(spark, rows, k, num, den=100):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.ngram_components(df, k, num, den).collect())


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("k", "num", "narrow", "wide", "star"), [(4, 85, 5, 5, 512), (5, 80, 1, 3, 2), (5, 80, 2, 64, 1)])
def test_join_like_brute_force(spark, k, num, narrow, wide, star, monkeypatch):
    for name, value in (("NARROW", narrow), ("WIDE", wide), ("STAR", star), ("TILE_GRAMS", 300), ("COLUMNS", 7)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(k)
    base = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (120, 60, 30, 12)]
    common = " ".join(f"c{i}" for i in range(10))
    texts = [edited(b, e, rng) for b in base for e in (0, 0, 1, 1, 2, 2, 3, 4, 5)]
    texts += [f"{common} {' '.join(f'y{rng.randrange(10**6)}' for _ in range(n))}" for n in (0, 1, 2, 5, 30, 30)]
    chain = list(base[0])
    for _ in range(25):  # each much like the one before, the last little like the first
        chain[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    texts += ["", " \t\n", None, "one", "ONE", "one two", "one  two", "a b c", "É é", "é é", "long " * 20_000]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (None, "lonely null id"), (7, "another text")]
    assert joined(spark, rows, k, num) == brute(rows, k, num, 100)


def test_join_where_sets_are_joined_and_not_sent(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MAX_SENT", 0)
    monkeypatch.setattr(ngram_join, "KEPT_NODES", 1)  # so equal sets are given by a task more than once
    rows = [(i, " ".join(f"w{j}" for j in range(30)) + (f" t{i}" if i % 2 else "")) for i in range(6)]
    assert joined(spark, rows, 4, 85) == brute(rows, 4, 85, 100)


def test_join_of_nothing_and_keep_one(spark):
    assert joined(spark, [], 4, 85) == []
    text = " ".join(f"w{j}" for j in range(50))
    rows = [(5, text), (2, text + " end"), (2, text + " end"), (9, "other words stand here now"), (None, "x"), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = ngram_join.keep_one(df)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["11", "12", "2", "9", "None"] and kept.columns == df.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x1c", max_size=12)), max_size=6), st.integers(1, 5))
def test_shingle_sets_have_the_right_sizes_and_overlaps(texts, k):
    got = list(shingle_sets(*texts_of(pa.array(texts, pa.string())), k))
    want = [shingles(t, k) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for (a, x), (b, y) in combinations(zip(got, want, strict=True), 2):
        assert len(np.intersect1d(a, b)) == len(x & y)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(7, 7)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_top(rows, is_query, k, scale=1024):
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            whole.setdefault(i, []).append([int(np.floor(scale * float(np.float32(x)))) for x in v])
    out = []
    for q in (i for i in whole if is_query(i)):
        for x in {tuple(v) for v in whole[q]}:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i in whole if i != q for y in {tuple(v) for v in whole[i]} if len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def top(spark, rows, k=10, every=20):
    df = spark.createDataFrame([(i, v, "a", 1.0) for i, v in rows], "vec_id long, embedding array<float>, x string, g double")
    got = knn_join.top_k(df, F.col("vec_id") % every == 0, k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_top_k_like_brute_force(spark, monkeypatch):
    for name, value in (("BIN", 70), ("LEAST_BIN", 1), ("ASKED", 3), ("AT_ONCE", 500)):
        monkeypatch.setattr(knn_join, name, value)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] * (1 + i % 3) + 0.1 * rng.normal(size=12)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(600, None), (601, []), (602, [1.0] * 11 + [float("nan")]), (603, [None] * 12), (604, [float("inf")] * 12), (None, rows[0][1]), (20, rows[20][1])]
    assert top(spark, rows) == brute_top(rows, lambda i: i % 20 == 0, 10)


def test_top_k_of_few_none_and_other_lengths(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, 0.5]), (3, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (5, [3.0, 2.0, 1.0])]
    assert top(spark, rows) == brute_top(rows, lambda i: i % 20 == 0, 10)
    assert top(spark, []) == [] and top(spark, [(1, [1.0])]) == [] and top(spark, [(0, [1.0])]) == []
    large = [(0, [2.0**18 + 1, -(2.0**18)]), (1, [2.0**18, 1.0]), (2, [-3.0, 2.0**18])]
    assert top(spark, large) == brute_top(large, lambda i: i % 20 == 0, 10)


def test_top_k_of_an_id_with_many_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [float(x) for x in 50 + rng.normal(size=4)]) for _ in range(40)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(1, 60)]
    got = [r for r in top(spark, rows, 5, 100) if r[0] == 0]
    whole = {(i, tuple(int(np.floor(1024 * float(np.float32(x)))) for x in v)) for i, v in rows}
    pairs = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for j, x in whole if j == 0 for i, y in whole if i != 0)[:5]
    assert got == [(0, n + 1, i, -s) for n, (s, i) in enumerate(pairs)]


def test_keep_one_of_an_id_with_two_texts(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(40))
    rows = [(1, text("a")), (5, text("a")), (5, text("b")), (9, text("b")), (5, text("b")), (7, None), (7, ""), (None, text("a"))]
    kept = ngram_join.keep_one(spark.createDataFrame([(i, t, 2) for i, t in rows], "doc_id long, text string, x int")).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == sorted([("1", text("a")), ("5", text("b")), ("7", "None"), ("7", ""), ("None", text("a"))])


def test_top_k_sends_rows_once_and_queries_where_they_must(spark, monkeypatch):
    monkeypatch.setattr(knn_join, "LEAST_BIN", 1)
    monkeypatch.setattr(knn_join, "BIN", 100)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    centres *= 20 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(x) for x in centres[i // 7 % 40] + 0.05 * rng.normal(size=16)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = knn_join.whole_vectors(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", 1024).cache()
    sent, asked, places = knn_join.routes(whole, 10)
    assert places >= 30 and sent.count() <= 4000
    assert asked.count() <= 0.25 * 200 * places  # some clusters have no pivot of their own
    assert top(spark, rows) == brute_top(rows, lambda i: i % 20 == 0, 10)
    # nothing can be pruned: still each row is sent once
    apart = [(i, [float(x) for x in y / np.linalg.norm(y)]) for i, y in enumerate(rng.normal(size=(1500, 32)))]
    whole = knn_join.whole_vectors(spark.createDataFrame(apart, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, "vec_id", "embedding", 1024).cache()
    sent, asked, places = knn_join.routes(whole, 10)
    assert sent.count() == 1500 and asked.count() <= 75 * places
    assert top(spark, apart) == brute_top(apart, lambda i: i % 20 == 0, 10)


def test_bins_hold_all_cells():
    rng = np.random.default_rng(5)
    points, sizes = rng.normal(size=(50, 3)), rng.integers(0, 400, 50)
    sizes[7] = 5000
    first, parts = knn_join.bins_of(points, sizes, 600)
    assert parts[7] == 9 and (parts[np.arange(50) != 7] == 1).all()
    load = np.bincount(first, np.where(parts == 1, sizes, 0), minlength=(first + parts).max())
    assert load.max() <= 600 and set(range(first[7], first[7] + 9)).isdisjoint(first[np.arange(50) != 7])
