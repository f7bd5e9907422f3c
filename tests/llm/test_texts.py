"""Fingerprints, packing, extraction, toxicity and quality."""

from __future__ import annotations

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.llm import fingerprint, html_text, packing, quality, toxicity
from vicinal.llm.queries import tokenizer_path

TOKENIZER = tokenizer_path("word_bpe_49k.json")


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# fingerprints


def test_fingerprints_of_neighbours(spark):
    rng = random.Random(4)
    rows = [(i * 3, prose(rng, rng.randrange(1, 300))) for i in range(60)] + [(500, None), (501, ""), (502, "é" * 3000), (503, "x" * 200_000), (30, "again"), (None, "no id")]
    rows += [(600, rows[5][1]), (601, rows[5][1])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _guest int").repartition(5)
    got = fingerprint.fingerprints(df).collect()
    assert len(got) == len(rows)
    known = {i: t or "" for i, t in rows if i not in (30, None)}
    order = sorted((i for i, _ in rows if i is not None), reverse=True)
    for r in got:
        i = r["doc_id"]
        if i in known:
            text = known[i]
            assert r["n_chars"] == len(text) and r["fingerprint"] == fingerprint.written(fingerprint.fingerprint(text))
            after = order[order.index(i) + 1] if order.index(i) + 1 < len(order) else None
            if after in known:
                edited = text[: len(text) - len(text) // 2] + known[after][: len(text) // 2]
                assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert r["edited_fingerprint"] == fingerprint.written(fingerprint.fingerprint(edited))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[601]["near_next"] == 1.0 and by_id[601]["fingerprint"] == by_id[600]["fingerprint"]
    assert by_id[501]["near_next"] == 1.0  # empty, then null
    last = next(r for r in got if r["doc_id"] is None)
    assert last["n_chars"] == 5 and last["edited_sha256"] == hashlib.sha256(("no " + by_id_text(rows, max(order))[:2]).encode()).hexdigest()


def by_id_text(rows, i):
    return next(t for j, t in rows if j == i)


def test_fingerprint_of_one_and_none(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    assert fingerprint.fingerprints(one).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprint.fingerprints(one.limit(0)).count() == 0


def test_chunks_resist_shifts_and_cover_the_text():
    rng = random.Random(1)
    text = prose(rng, 3000, 10**6)
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint("some words put before " + text)
    assert fingerprint.likeness(a, b) > 0.98 and fingerprint.likeness(a, fingerprint.fingerprint(prose(rng, 3000, 10**6))) < 0.02
    data = np.frombuffer(text.encode(), np.uint8)
    lengths = np.diff([0, *fingerprint.chunk_ends(data)])
    assert lengths.sum() == len(data) and lengths.max() <= fingerprint.MOST and (lengths[:-1] >= fingerprint.LEAST).all()
    assert (fingerprint.read(fingerprint.written(a)) == a).all()
    e = fingerprint.edited_text(text, prose(rng, 3000, 10**6))
    assert 0.45 < fingerprint.likeness(a, fingerprint.fingerprint(e)) < 0.55


# packing


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 50, 900, 2600)] + [None, "", "A<|endoftext|>b it's 12,5 É ΣΑΣ x\x1cy\x85z", "ﬁ é don't!!! $$$ 日本語", "word " * 2047, "word " * 2048]
    df = spark.createDataFrame([(i, x, 5) for i, x in enumerate(texts)] + [(None, "a b", 5), (0, texts[0], 5)], "doc_id long, text string, piece int")
    rows = packing.pack_documents(df, TOKENIZER, with_ids=True).collect()
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        parts = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        parts = parts[::2] if i == 0 else parts  # that row repeats
        assert [y for r in parts for y in r["ids"]] == ids and [r["start"] for r in parts] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in parts)
    check_sequences(rows)
    plain = packing.pack_documents(df, TOKENIZER).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in plain) == sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in rows)
    assert packing.pack_documents(df.limit(0), TOKENIZER).count() == 0


SIGNS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]


@pytest.fixture(scope="module")
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_ids_of_all_pairs_of_signs(whole_tokenizer):
    words = packing.WordIds(TOKENIZER)
    texts = [f"{core}{a}{b} x {a}{b}{core} {core}{a}9{b}" for core in ("f", "Word", "7", "é", "") for a in SIGNS for b in SIGNS]
    for text, found in zip(texts, whole_tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == found.ids, text


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aB1é \n.,;:!?$%&#*|()[]{}<>\"'`’“”…Σςİßﬁ日½²\u0301\u0338\u00a0\u200b"), st.characters()), max_size=40))
def test_ids_of_any_text(whole_tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(packing.WordIds(TOKENIZER).encode(text), "<u4").tolist() == whole_tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_ids_of_the_documents(whole_tokenizer, scale):
    import pyarrow.parquet as pq

    path = f"/root/testdata/sf{scale}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    texts = [t or "" for t in pq.read_table(path, columns=["text"]).column("text").to_pylist()]
    words = packing.WordIds(TOKENIZER)
    assert not [t for t, x in zip(texts, whole_tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if words.encode(t) != np.array(x.ids, "<u4").tobytes()]


def brute_sum_of_squares(lengths, capacity):
    """The rule from its words: of all places, a new sequence too if none has room, the least sum of squares of counts by gap."""
    sequences = []
    placed = []
    for s in lengths:
        ways = []
        for i in range(len(sequences)):
            if sum(sequences[i]) + s <= capacity:
                after = [capacity - sum(x) - (s if j == i else 0) for j, x in enumerate(sequences)]
                counts = {g: after.count(g) for g in after if 0 < g < capacity}
                ways.append((sum(n * n for n in counts.values()), capacity - sum(sequences[i]), i))
        if ways:
            i = min(ways)[2]
        else:
            sequences.append([])
            i = len(sequences) - 1
        placed.append((sum(sequences[i]), capacity - sum(sequences[i])))
        sequences[i].append(s)
    return len(sequences), placed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=60))
def test_sum_of_squares_as_the_rule_says(lengths):
    sequence, offset = packing.sum_of_squares(np.array(lengths, np.int64), 16)
    n, placed = brute_sum_of_squares(lengths, 16)
    # which of the sequences of equal gaps is taken is free, so places are compared by their gaps
    assert (int(sequence.max()) + 1 if lengths else 0) == n and offset.tolist() == [at for at, _ in placed]


def check_sequences(rows, capacity=2048):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=200))
def test_sum_of_squares_is_whole_and_tight(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    sequence, offset = packing.sum_of_squares(lengths, 32)
    n = check_sequences([{"sequence_id": s, "offset": o, "length": x} for s, o, x in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True)], 32)
    assert n <= 1.3 * lengths.sum() / 32 + 2


def test_packs_nearly_as_few_as_can_be():
    rng = np.random.default_rng(6)
    lengths = np.sort(np.minimum(2047, rng.lognormal(6, 1, 5000)).astype(np.int64) + 1)[::-1]
    assert packing.sum_of_squares(lengths)[0].max() + 1 <= lengths.sum() / 2048 * 1.005 + 1


# pages


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body>
<header><h1>The site</h1></header><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We set cookies, much text here to be dense, more text and more of it.</div><div class="ad big">Buy this thing now, it is very good and cheap.</div>
%s<aside><p>Also read these other things on the site today.</p></aside><section id="comments"><p>I do not agree with a word of this, says a reader.</p></section>
<form><label>Your name</label><input></form><footer>&copy; 2026 nobody &middot; all words reserved</footer></body></html>"""
TEXT = "Title &amp; more\nFirst  paragraph with a link in it and some words.\nSecond, &lt;b&gt; shown, broken line.\none\ntwo\nLast words of the article stand here."


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", "<div id=content>%s</div>", "<div><div><section>%s</section></div></div>"])
def test_extracts_the_article_only(frame):
    body = "<h1>Title &amp; more</h1><p><b>First&nbsp; paragraph <a href=x>with a link</a> in it\n and some words.<br><p>Second, &lt;b&gt; shown,<br>broken line.</p><ul><li>one<li>two</ul><p>Last words of the article stand here."
    want = "Title & more\nFirst paragraph with a link in it and some words.\nSecond, <b> shown, broken line.\none\ntwo\nLast words of the article stand here."
    assert html_text.extract(PAGE % (frame % body)) == want


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain text", "<p>a", "a < b", "<", "<p title='x>y'>q", "<script>never ends <p>x", "<div>" * 5000 + "deep", "<p>&am &amp &#65;&#x42;", "<table><tr><td>a<td>b</table>", "<nav>only menu</nav>", "</p></div>x"]
    want = ["", "", "", "plain text", "a", "a < b", "<", "q", "", "deep", "&am & AB", "a\nb", "", "x"]
    df = spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    rows = html_text.extract_pages(df).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == want and [r["n_chars"] for r in rows] == [len(w) for w in want]
    assert html_text.extract_pages(df.limit(0)).count() == 0


# toxicity and quality


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(400):
        toxic, good = i % 5 == 0, i % 4 != 0
        text = prose(rng, 60) if good else " ".join(f"w{rng.randrange(400)}%%%" for _ in range(60))
        if toxic:
            words = text.split()
            for w in rng.sample(["idiot", "moron", "trash", "scum", "loser"], 3):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        docs.append((i, text, 7))
        labels.append((i, int(good), int(toxic), "x"))
    docs += [(1000, None, 7), (1001, "", 7), (None, "idiot scum", 7), (1002, prose(rng, 30) + " 1d10t m.o.r.o.n", 7), (1003, prose(rng, 30) + " l o s e r and scuum", 7), (1004, "clean words " * 20_000, 7), (5, docs[5][1], 7)]
    return spark.createDataFrame(docs, "doc_id long, text string, quality int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_learns_and_sees_through(spark, labelled):
    docs, labels = labelled
    train = labels.where("doc_id % 3 <> 0")
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, train).collect()}
    held = [rows[i] for i in range(0, 400, 3)]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)
    assert rows[1002]["predicted"] == rows[1003]["predicted"] == 1 and rows[1004]["predicted"] == 0
    assert rows[1000]["score"] == rows[1001]["score"] and all(0 <= r["score"] <= 1 for r in rows.values())


def test_toxicity_learns_from_every_label(spark):
    """A word that only the last of many labelled documents have is learnt too."""
    rng = random.Random(3)
    order = [r["id"] for r in spark.range(7000).orderBy(F.xxhash64("id"), "id").collect()]
    toxic = {i for k, i in enumerate(order) if k % 4 == 0}
    last = set([i for i in order if i in toxic][-60:])
    text = lambda i: prose(rng, 8) + (" zorblax" if i in last else " idiot" if i in toxic else "")
    docs = spark.createDataFrame([*((i, text(i)) for i in range(7000)), (8000, prose(rng, 8) + " zorblax"), (8001, prose(rng, 9))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(7000)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs, labels).where("doc_id >= 8000").collect()}
    assert rows == {8000: 1, 8001: 0}


def test_quality_learns(spark, labelled):
    docs, labels = labelled
    rows = {r["doc_id"]: r for r in quality.score_quality(docs, labels.where("doc_id % 3 <> 0")).collect()}
    held = [rows[i] for i in range(0, 400, 3)]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.95 * len(held)
    assert rows[1000]["score"] == rows[1001]["score"] and len(rows) == docs.select("doc_id").distinct().count()


def test_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    for score in (toxicity.score_toxicity, quality.score_quality):
        none = score(docs, labels.limit(0))
        assert none.select("score").distinct().count() == 1 and none.count() == docs.count()
        assert score(docs.limit(0), labels.limit(0)).count() == 0
    only = toxicity.score_toxicity(docs, labels.where("toxic = 0")).first()["score"]
    assert only < 0.05


def test_restore():
    words = [(w, 5.0) for w in ("idiot", "moron", "disgusting", "the", "and", "loser")]
    model = toxicity.CharacterModel.of(words)
    assert [toxicity.restore(x, model) for x in ("1d10t", "idiooot", "i.d.i.o.t", "m0r0n", "l-0-s-e-r", "d1sgust1ng")] == ["idiot", "idiot", "idiot", "moron", "loser", "disgusting"]
    assert toxicity.plain("word,") == "word" and toxicity.plain("w0rd") is None and toxicity.restore("", model) == ""


def test_sample_is_bounded_and_ids_are_no_input(spark, labelled):
    docs, labels = labelled
    assert len(quality.sample(docs, labels, "toxic", (7, 3))) == 10
    some = quality.sample(docs, labels, "toxic", (100, 100), 2000)
    assert 0 < len(some) < 30 and max(sum(len(r[0].encode()) for r in some if r[1] == v) for v in (0, 1)) <= 2000
    moved = docs.withColumn("doc_id", F.col("doc_id") + 10**6)
    a = {r["text"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    shifted = labels.withColumn("doc_id", F.col("doc_id") + 10**6)
    assert set(a) == {r["text"] for r in quality.score_quality(moved, shifted).collect()}


SPOKEN = toxicity.CharacterModel.of([(w, 5.0) for w in ("idiot", "moron", "disgusting", "the", "and", "loser", "you", "are", "a", "man", "scum", "stupid", "is", "it", "to")])


@pytest.mark.parametrize("text", ["you are a s t u p i d man", "it is $ t u p 1 d", "s t u p i d, you", "s   t   u   p   i   d", "s\nt\nu\np\ni\nd", "are s\tt\tu\tp\ti\td"])
def test_spaced_words_are_restored_with_their_boundaries(text):
    assert "stupid" in toxicity.tokens_of(text, SPOKEN)


def test_words_spaced_together_come_apart():
    assert {"you", "idiot"} <= toxicity.tokens_of("y o u i d i o t", SPOKEN) and "idiot" in toxicity.tokens_of("i d ! o t", SPOKEN)
    evidence = toxicity.Evidence({"stupid": 5.0}, SPOKEN)
    assert evidence.features("you are a s t u p i d man")[0] == 5.0 and evidence.features("you are a man")[0] == 0.0


def test_long_tokens_and_signs_at_ends_are_restored():
    evidence = toxicity.Evidence({"stupid": 5.0, "idiot": 5.0, "scum": 5.0}, SPOKEN)
    for token in ("st" + "u" * 60 + "pid", ".......".join("idiot"), "sc**", "scu#", "st*p*d***", "1d10t" + "!" * 40):
        assert evidence[token] == 5.0, token
    assert evidence["the,"] == evidence["and***"] == 0.0


def test_matrices_give_what_the_lattice_gives():
    rng = random.Random(2)
    dense = toxicity.Dense(SPOKEN)
    for _ in range(200):
        token = "".join(rng.choice("idotursm*#@$!.1-") for _ in range(rng.randrange(1, 6)))
        if all(x in dense.at for c in token for x in toxicity.LETTERS.get(c, "")):
            assert dense.restore(token) == "".join(toxicity.decode(token, SPOKEN)), token


def test_dictionaries_learn_from_whole_texts():
    rng = random.Random(5)
    texts = [prose(rng, 1500, 10**6) + " a phrase that only stands late in texts " * 5 for _ in range(40)]
    assert min(map(len, texts)) > 8000 and b"phrase that only stands late" in quality.dictionary(texts)
    parts = [bytes([65 + i]) * 8000 for i in range(20)]
    found = quality.spread(parts)
    assert len(found) <= quality.DICTIONARY_BYTES and all(bytes([65 + i]) * 200 in found for i in range(20))
    assert quality.spread(parts[:2]) == b"\n".join(parts[:2])


@pytest.mark.parametrize("named", ["<div id=page class='has-sidebar'>%s</div>", "<div class='no-sidebar wide'>%s</div>", "<div class='elementor-widget-container'>%s</div>", "<div class='search-result'>%s</div>",
    "<section class=commentary>%s</section>", "<div class=widget><article>%s</article></div>", "<div class='promo'>%s</div>", "<div class='related'><main>%s</main></div>"])
def test_a_name_alone_does_not_lose_the_article(named):
    body = "".join(f"<p>Paragraph {i} of the article, with enough words in it to be the text of this page.</p>" for i in range(8))
    want = "\n".join(f"Paragraph {i} of the article, with enough words in it to be the text of this page." for i in range(8))
    assert html_text.extract(PAGE % (named % body)) == want


def test_large_notices_go_where_an_article_stands_elsewhere():
    notice = "<div class=ad><p>Buy this thing now, it is good and cheap, and there is more of it than of the article.</p></div>"
    assert html_text.extract(f"<body>{notice}<article><h1>Short</h1><p>Text.</p></article></body>") == "Short\nText."


BARE = """<html><head><title>No</title></head><body><div><div><h1>The site</h1></div></div><div><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a><li><a href=/c>Menu three</a></ul></div>
<div class="x1">Buy this thing now, it is very good and cheap, and there is more of it.</div>%s<div class=x3><ul><li><a href=/d>Another page of this site</a><li><a href=/e>And one more of them</a></ul></div>
<div id=x4>&copy; 2026 nobody &middot; all words reserved</div></body></html>"""
PARTS = [f"Part {i} of the text tells of this and that, and of what comes after it, in so many words." for i in range(6)]


@pytest.mark.parametrize("frame", ["<div>%s</div>", "<div class=x2><div>%s</div></div>", "<section id=q7>%s</section>", "<div><span>%s</span></div>"])
def test_extracts_by_density_without_tags_or_names_that_tell(frame):
    body = "<h1>What it is about</h1>" + "".join(f"<p>{x}</p>" for x in PARTS)
    assert html_text.extract(BARE % (frame % body)) == "\n".join(["What it is about", *PARTS])


def test_without_densities_the_article_is_not_found(monkeypatch):
    body = "<div>" + "".join(f"<p>{x}</p>" for x in PARTS) + "</div>"
    measured = html_text.measure

    def flat(root):
        order = measured(root)
        for x in order:
            x.density, x.sum = 1.0, 1.0
        return order

    assert html_text.extract(BARE % body) == "\n".join(PARTS)
    monkeypatch.setattr(html_text, "measure", flat)
    assert html_text.extract(BARE % body) != "\n".join(PARTS)
    assert html_text.extract(PAGE % body) != "\n".join(PARTS)


def test_a_title_and_parts_apart_belong_to_the_text():
    two = f"<h1>Title</h1><div><p>{PARTS[0]}</p><p>{PARTS[1]}</p><p>{PARTS[2]}</p></div><div class=ad>Buy this.</div><div><p>{PARTS[3]}</p><p>{PARTS[4]}</p></div>"
    assert html_text.extract(BARE % f"<div>{two}</div>") == "\n".join(["Title", *PARTS[:5]])


def test_densities_as_the_formula_says():
    import math
    import re

    rng = random.Random(4)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ""
        tag = rng.choice(["div", "section", "a", "b", "ul"])
        return f"<{tag}>{'x' * rng.randrange(30)} {kids}</{tag}>"

    for _ in range(60):
        page = tree(4)
        root = html_text.parse(page)
        order = html_text.measure(root)

        def written(x):
            return "".join(c if isinstance(c, str) else f"<{c.tag}>{written(c)}</{c.tag}>" for c in x.children)

        def counts(x):
            inner = written(x)
            tags = len(re.findall(r"<\w+>", inner))
            linked, depth, links = 0, x.tag == "a", 0
            for token in re.findall(r"</?\w+>|[^<]+", f"{inner}"):
                if token == "<a>":
                    depth, links = depth + 1, links + 1
                elif token == "</a>":
                    depth -= 1
                elif not token.startswith("<") and depth:
                    linked += len(token.replace(" ", ""))
            return len(re.sub(r"<[^>]+>| ", "", inner)), tags, linked, links + (x.tag == "a")

        body_c, _, body_l, _ = counts(root)
        for x in order:
            c, t, lc, lt = counts(x)
            if c:
                base = math.log(c / max(c - lc, 1) * max(lc, 1) + body_l / body_c * c + math.e)
                t, inner = max(t, 1), c / max(lc, 1) * max(t, 1) / max(lt, 1)
                want = c / t * max(math.log(inner), 0) / math.log(base) if math.log(base) > 1e-9 else c / t
                assert x.density == pytest.approx(want, rel=1e-6), (page, x.tag)


def plain_chunks(data: bytes):
    """Chunk ends byte by byte, as the rule says."""
    h, start, ends = 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(fingerprint._GEAR[b])) % 2**32
        d = i + 1 - start
        small = h < 2**32 // (fingerprint.LOOSE if d >= fingerprint.NORMAL else fingerprint.STRICT)
        if d >= fingerprint.MOST or (small and d >= fingerprint.LEAST):
            start = i + 1
            ends.append(start)
    return ends if not data or (ends and ends[-1] == len(data)) else [*ends, len(data)]


def plain_digest(chunk: bytes):
    m, odd = 2**64, 0x9E3779B97F4A7C15
    x = sum(int(fingerprint._PLAIN[b]) * pow(odd, i, m) for i, b in enumerate(chunk)) % m
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % m
    return ((x ^ (x >> 31)) & ~0xFF) | len(chunk)


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.text(max_size=400), st.integers(0, 2**32).map(lambda s: prose(random.Random(s), 150, 10**6))), st.text(max_size=200))
def test_fingerprints_byte_by_byte(text, other):
    text, other = (t.encode("utf-8", "ignore").decode() for t in (text, other))
    sets = []
    for t in (text, other, text + other):
        data = t.encode()
        ends = plain_chunks(data)
        sets.append({plain_digest(data[a:z]) for a, z in zip([0, *ends], ends, strict=False)})
        assert fingerprint.fingerprint(t).tolist() == sorted(sets[-1])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want = sum(x & 0xFF for x in a & b) / sum(x & 0xFF for x in a) if a else float(not b)
            x, y = (fingerprint.fingerprint((text, other, text + other)[k]) for k in (i, j))
            assert fingerprint.likeness(x, y) == pytest.approx(want, abs=1e-12)


def disguised(word, rng):
    """A word as it is hidden: signs for letters, letters repeated, spaced or cut."""
    signs = {"o": "0", "i": "1!", "e": "3", "a": "4@", "s": "5$", "t": "7+"}
    letters = [rng.choice(signs[c]) if c in signs and rng.random() < 0.6 else c for c in word]
    way = rng.randrange(4)
    if way == 0:
        at = rng.randrange(1, len(letters))
        letters[at] *= rng.randrange(3, 7)
        return "".join(letters)
    return (("", ".", " ")[way - 1]).join(letters)


def test_the_decoder_earns_its_place(monkeypatch):
    """Recall of disguised words, which no text of the learning sample holds, with the decoder and without."""
    rng = random.Random(11)
    bad = ["idiot", "moron", "disgusting", "stupid", "pathetic", "worthless", "loser", "scum"]
    common = [f"{a}{b}" for a in ("the", "man", "tion", "ver", "ing", "con") for b in ("er", "and", "is", "ort", "al")]
    model = toxicity.CharacterModel.of([*((w, 3.0) for w in common), *((w, 50.0) for w in bad)])
    lexicon = dict.fromkeys(bad, 5.0)
    hidden = [w for w in (disguised(rng.choice(bad), rng) for _ in range(300)) if not w.isalpha() or w not in bad]
    texts = [f"{' '.join(rng.choices(common, k=8))} {w} {' '.join(rng.choices(common, k=8))}" for w in hidden]
    seen = np.mean([toxicity.Evidence(lexicon, model).features(t)[0] > 0 for t in texts])
    clean = np.mean([toxicity.Evidence(lexicon, model).features(" ".join(rng.choices(common, k=16)))[0] > 0 for _ in range(100)])
    monkeypatch.setattr(toxicity, "restore", lambda token, _: token)
    monkeypatch.setattr(toxicity, "decode", lambda raw, _: raw.split())
    blind = np.mean([toxicity.Evidence(lexicon, model).features(t)[0] > 0 for t in texts])
    print(f"recall with the decoder {seen:.3f}, without {blind:.3f}")
    assert seen >= 0.9 and blind <= seen - 0.3 and clean == 0


def test_quality_by_hand(spark, labelled):
    """Scores against sizes that zstandard gives for each block, and the logistic formula."""
    import zstandard as z

    docs, labels = labelled
    model = quality.fit(docs, labels)
    got = {(r["doc_id"], r["text"]): r["score"] for r in quality.score_quality(docs, labels).collect()}
    for (_, text), score in got.items():
        raw = (text or "").encode()
        if not raw:
            continue
        sizes = []
        for d in (model.good, model.bad):
            c = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False, write_checksum=False)
            sizes.append(sum(len(c.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)))
        x = (sizes[1] - sizes[0]) / max(sizes)
        share = min(sizes) / len(raw)
        at = [(v - m) / s for v, m, s in zip((x, share, x * share, np.log(len(raw))), model.mean, model.scale, strict=True)]
        assert score == pytest.approx(1 / (1 + np.exp(-(model.coefficients[0] + np.dot(at, model.coefficients[1:])))), abs=1e-9)


@pytest.mark.parametrize("per_range", [20_000, 7])
def test_rows_that_repeat_an_id_are_dealt_to_ranges(spark, monkeypatch, per_range):
    """A third of the rows has no id, a third one id: each is followed by the next in the order of id and hash of the text."""
    monkeypatch.setattr(fingerprint, "RANGE", per_range)
    rng = random.Random(8)
    rows = [(None, prose(rng, 5)) for _ in range(60)] + [(40, prose(rng, 5)) for _ in range(60)] + [(i, prose(rng, 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    want = sorted((str(i), hashlib.sha256(fingerprint.edited_text(t, order[(n + 1) % len(order)][1]).encode()).hexdigest()) for n, (i, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fingerprint.fingerprints(df).collect()) == want
    if per_range == 7:
        sizes = [len(x) for x in fingerprint.with_next(df).rdd.glom().collect()]
        assert max(sizes) < 40 and sum(n > 0 for n in sizes) > 15


def test_texts_without_pieces_are_not_searched_for_them(monkeypatch):
    """Nothing that the patterns would find is passed by, and plain text is not searched; what was restored once is not restored again."""
    import random

    from vicinal.llm import toxicity

    rng = random.Random(5)
    bits = ["a", "b", "1", "_", ".", "-", "*", " ", "  ", "\n", "\t", "\u00a0", "word", "is", "!", "#", "\u00e9", "...", "x."]
    hits = 0
    for _ in range(20_000):
        low = "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        spaced, stretched = toxicity.in_pieces(low.split())
        found = toxicity._spaced.search(low), toxicity._stretch.search(low)
        assert (spaced or not found[0]) and (stretched or not found[1]), low
        hits += bool(found[0]) + bool(found[1])
    assert hits > 1000
    assert toxicity.in_pieces("this is an ordinary line of text, with a stop.".split()) == (False, False)
    model, decoded = toxicity.CharacterModel.of([("idiot", 50.0)]), []
    monkeypatch.setattr(toxicity, "decode", lambda raw, m, _of=toxicity.decode: decoded.append(raw) or _of(raw, m))
    assert [toxicity.restore("1d!ot", model) for _ in range(3)] == ["idiot"] * 3 and len(decoded) == 1


def test_only_what_may_be_in_the_lexicon_is_restored(monkeypatch):
    """Tokens whose lattice begins as nothing in the lexicon does are not decoded, and no weight changes by that."""
    from vicinal.llm import toxicity

    lexicon = {"idiot": 5.0, "idio~": 3.0, "stupid": 6.0, "scum": 5.0, "ass": 4.0, "loooser": 4.0, "looo~": 2.5}
    model = toxicity.CharacterModel.of([*((w, 50.0) for w in lexicon if not w.endswith("~")), *((w, 5.0) for w in ("the", "and", "ordinary", "asset", "scale"))])
    rng = random.Random(8)
    bits = [*"asdioutlcmper", "oo", "ss", "$", "!", "1", "0", "*", "#", ".", "-", ",", "(", "@", "id", "st", "sc", "lo", "é"]
    tokens = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(4000)]
    for w in ("idiot", "idiots", "stupid", "scum", "ass", "loooser"):
        for _ in range(200):
            signs = "".join(rng.choice([c, c, c, c, c + c, c + ".", {"i": "1", "s": "$", "o": "0"}.get(c, "*")]) for c in w)
            tokens.append(rng.choice(["", "(", "*", "'"]) + signs + rng.choice(["", "!", "$$$", "**", ",", "..."]))
    evidence = toxicity.Evidence(lexicon, model)
    wanted = [max((evidence.weight(w) for w in toxicity.words_of(t, model)), default=0.0) for t in tokens]
    assert [evidence[t] for t in tokens] == wanted and sum(w > 0 for w in wanted) > 500 and wanted.count(0.0) > 1000
    model.forget()
    restored = []
    monkeypatch.setattr(toxicity, "restore", lambda token, m, _of=toxicity.restore: restored.append(token) or _of(token, m))
    fresh = toxicity.Evidence(lexicon, model)
    assert [fresh[t] for t in ("ordinary$$$", "thee!!", "and***", "w0rd", "1d10t", "$cum")] == [0.0, 0.0, 0.0, 0.0, 5.0, 5.0]
    assert set(restored) == {"1d10t", "$cum"}


def test_searches_after_white_space_find_the_same_pieces():
    from vicinal.llm import toxicity

    rng = random.Random(6)
    bits = ["a", "b", "1", "_", ".", "-", "*", " ", " ", "  ", "\n", "\t", " ", "word", "is", "!", "#", "é", "...", "x."]
    hits = 0
    for _ in range(20_000):
        low = "".join(rng.choice(bits) for _ in range(rng.randint(1, 24)))
        spaced, stretched = toxicity._spaced.findall(low), toxicity._stretch.findall(low)
        assert (toxicity._spaced_after.findall(f" {low}"), toxicity._stretch_after.findall(f" {low}")) == (spaced, stretched), low
        hits += len(spaced) + len(stretched)
    assert hits > 1000
