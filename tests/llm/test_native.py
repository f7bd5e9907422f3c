"""Mixing, line dedup and the URL filter, against plain Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vicinal.llm import line_dedup, mixing, url_filter
from vicinal.llm.queries import URL_RULES

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENTS)


def water_level(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by capping and resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


@pytest.fixture(scope="module")
def mixed_rows():
    rows = [(i, " ".join(["w"] * (i % 23 + 1)), f"s{i % 4}" if i % 3 else "s0") for i in range(900)]
    return rows + [(901, None, "s1"), (902, "", None), (903, "a\tb\x0bc  d", None), (904, "  ", "zz"), (5, "w w", "s1"), (5, "w w", "s1"), (None, "x y", "s2"), (None, "x y", "s2")]


def test_mix_targets_sizes_and_copies(spark, mixed_rows):
    rows = mixing.plan_mix(documents(spark, mixed_rows)).collect()
    assert len(rows) == len(mixed_rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[901]["size"], by_id[902]["size"], by_id[903]["size"], by_id[904]["size"]) == (0, 0, 4, 0)
    sizes = defaultdict(int)
    for _, t, s in mixed_rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water_level(dict(sizes))
    source = {i: s for i, _, s in mixed_rows}
    taken, longest = Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= 4 * longest[s] for s in want)


def test_mix_reruns_agree_and_rows_come_as_often_as_planned(spark, mixed_rows):
    d = documents(spark, mixed_rows).withColumns({"size": F.lit("x"), "copies": F.lit(9)})
    plan = [sorted(map(str, mixing.plan_mix(x).collect())) for x in (d, d.repartition(5))]
    assert plan[0] == plan[1]
    planned, got = Counter(), Counter(r["doc_id"] for r in mixing.mix(d).collect())
    for r in mixing.plan_mix(d).collect():
        planned[r["doc_id"]] += r["copies"]
    assert got == +planned and mixing.mix(d).columns == d.columns


def test_mix_of_nothing(spark):
    assert mixing.plan_mix(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
    blank = mixing.plan_mix(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert all((r["target"], r["taken"]) == (0.0, 0) for r in blank)


def plain_dedup(rows, least):
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for line in (t or "").split("\n"):
            if key := line.strip(" \t\r"):
                if s is not None:
                    sites[key].add(s)
                if i is not None:
                    first[key] = min(first.get(key, i), i)
    common = {k for k, s in sites.items() if len(s) >= least}
    goes = lambda i, line: (k := line.strip(" \t\r")) in common and i != first.get(k)
    return sorted((str(i), None if t is None else "\n".join(x for x in t.split("\n") if not goes(i, x))) for i, t, _ in rows)


def test_line_dedup_like_plain_python(spark):
    rows = [(i, f"only {i}\n  menu here \n\nline {i % 12}\nhome\r", f"s{i % 30}") for i in range(150)]
    rows += [(200 + i, f"edge {i % 7}\nkept", f"t{i}") for i in range(9)] + [(300, None, "a"), (301, "", None), (302, "home\nhome", None), (303, "home", "x"), (303, "home", "x"), (None, "home", "q")]
    for least in (3, 9, 10, 30):
        d = documents(spark, rows).withColumns({"n_lines": F.lit("clash"), "_hash": F.lit(1)})
        got = line_dedup.dedup_lines(d, least)
        assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == plain_dedup(rows, least)


def test_line_dedup_of_nothing_and_counts(spark):
    assert line_dedup.dedup_lines(documents(spark, []), 2).count() == 0
    got = line_dedup.dedup_lines(documents(spark, [(1, "a\nb", "x"), (2, "a\nc\na", "y")]), 2).orderBy("doc_id").collect()
    assert [(r["text"], r["n_lines"], r["n_removed"]) for r in got] == [("a\nb", 2, 0), ("c", 3, 2)]


URLS = [
    ("https://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://blog.example.com/en/x", "blog.example.com", "/en/x", "example.com/en/", "block"),
    ("http://blog.example.com/fr/x", "blog.example.com", "/fr/x", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://x.net/es/?a", "x.net", "/es/", "net/es/", "block"), ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"), ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("x.com/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"), ("http://ÄB.org?x", "Äb.org", "", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, n_bad string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = url_filter.filter_urls(pages, none, URL_RULES).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == URLS
    assert url_filter.filter_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_reputation_blocks_bad_hosts_only_with_enough_pages(spark):
    rows, outcomes = [], []
    for host, n, bad in (("spam.farm.org", 60, 58), ("good.site.org", 60, 3), ("few.site.org", 1, 1), ("other.net", 40, 6)):
        for _ in range(n):
            outcomes.append((len(rows), bad > 0))
            rows.append((len(rows), f"http://{host}/p"))
            bad -= 1
    rows += [(9000, "http://unknown.org/"), (None, "http://spam.farm.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(outcomes, "page_id long, bad boolean"), [])
    verdict = {r["host"]: r["verdict"] for r in got.collect()}
    assert verdict == {"spam.farm.org": "block", "good.site.org": "allow", "few.site.org": "allow", "other.net": "allow", "unknown.org": "allow"}


def test_hosts_without_labels_have_the_prior_of_their_domain(spark):
    hosts = [f"h{i}.bad.org" for i in range(10)] + [f"h{i}.good.net" for i in range(10)]
    urls = [f"http://{h}/{j}" for h in hosts for j in range(30)]
    n = len(urls)
    outcomes = [(i, "bad.org" in u) for i, u in enumerate(urls)] + [(n + 3, None)]
    urls += ["http://new.bad.org/", "http://new.good.net/", "http://other.org/", "http://null.bad.org/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, spark.createDataFrame(outcomes, "page_id long, bad boolean"), []).collect()}
    assert len(got) == len(urls) and [got[i]["n_labelled"] for i in range(n, n + 5)] == [0] * 5
    assert [got[i]["verdict"] for i in (n, n + 1, n + 3, n + 4)] == ["block", "allow", "block", "allow"]
