"""Language, toxicity, cross-entropy and page text."""

import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_extract, langid, lm_score, toxicity


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


EN = "the house of many windows stands near quiet river where children play with small boats".split()
DE = "das haus mit vielen fenstern steht nahe dem ruhigen fluss wo kinder mit kleinen booten spielen".split()


def test_language_words_first_then_grams(spark, docs_of):
    rng = random.Random(1)
    train = docs_of([(i, sentences(rng, (EN, DE)[i % 2], 20), ("en", "de")[i % 2]) for i in range(40)] + [(None, "x", "xx"), (98, None, "xx"), (99, "y", None)])
    model = langid.learn(train)
    assert sorted(model["langs"]) == ["de", "en"]
    texts = [(1, "The house"), (2, "fenstern"), (3, "fensterlein kindern"), (4, "windowed houses"), (5, None), (6, ""), (7, "123 !?"), (8, "漢字"),
             (9, "das haus " * 20000), (9, "das haus " * 20000)]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(docs_of(texts, clashing=True), model).collect()]
    pred = {i: p for i, p, _ in got}
    assert pred == {1: "en", 2: "de", 3: "de", 4: "en", 5: "und", 6: "und", 7: "und", 8: model["langs"][0], 9: "de"} and len(got) == 10
    assert all(0 <= s <= 1 for _, _, s in got)
    empty = langid.learn(train.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs_of(texts), empty).collect()} == {"und"}
    assert langid.identify(docs_of([]), model).count() == 0


def test_language_brute_force_scores():
    model = {"langs": ["a", "b"], "words": {"ab": (-1.0, -2.0)}, "grams": {"^ab": (-3.0, -1.0), "b": (-1.0, -5.0)}}
    scores = langid._Scores(model)
    assert scores["ab"] == (-1.0, -2.0)  # known word
    assert scores["abz"] == (-3.0, -1.0)  # longest known n-gram
    assert scores["zb"] == (-1.0, -5.0)  # single letter
    assert scores["zz"] == (0.0, 0.0)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b) if False else _next(row, i, x, b)
    return row


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_matcher_equals_edit_distances():
    rng = random.Random(3)
    terms = ["idiot", "moron", "scum", "trash", "lowerand*", "veq*", "idiom"]
    matcher = toxicity.Matcher(terms)
    letters = "idotmrnscuahlweavq"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    for term in terms:
        stem = term.rstrip("*")
        for _ in range(200):
            w = list(stem + ("xyz"[: rng.randint(0, 3)] if term != stem else ""))
            for _ in range(rng.randint(0, 2)):
                k = rng.randint(0, len(w))
                w[k:k + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
            words.append("".join(w))
    for word in words:
        best = 9
        for term in terms:
            stem = term.rstrip("*")
            if stem != term:
                d = min(edits(stem, word)) if True else 9  # the end of the word is free
                limit = 1 if len(stem) >= toxicity.FUZZY_STEM else 0
            else:
                d, limit = edits(term, word)[-1], 1 if len(term) >= toxicity.FUZZY_WORD else 0
            best = min(best, d if d <= limit else 9)
        found = matcher.find(word)
        assert (found[1] if found else 9) == best, word


def toxic_tables(spark, docs_of):
    rng = random.Random(5)
    plain = [f"w{a}{b}" for a in "bcdfg" for b in "aeiou"] + EN
    rows, labels = [], []
    for i in range(300):
        text, kind = sentences(rng, plain, 30).split(), i % 5
        if kind == 0:
            text[10:10] = ["you", "idiot"]
        elif kind == 1:
            text[10:10] = ["quoted", '"', "idiot", '"', "wrote"]
        rows.append((i, " ".join(text)))
        labels.append((i, 1 if kind == 0 else 0))
    return docs_of(rows), spark.createDataFrame(labels + [(None, 1), (7000, None)], "doc_id long, toxic int")


def test_toxicity_parts_quotation_from_abuse(spark, docs_of):
    docs, labels = toxic_tables(spark, docs_of)
    model = toxicity.learn(docs, labels)
    assert any(t.rstrip("*") in "idiot" and "idiot".startswith(t.rstrip("*")) for t in model["terms"])
    texts = [(1, "wba wca the you idiot wga wfa of"), (2, 'wba wca the quoted " idiot " wrote wga of'), (3, None), (4, ""), (5, "wba wca the house"),
             (6, "the house " * 30000 + "you idiot"), (6, "the house " * 30000 + "you idiot")]
    scored = docs_of(texts, clashing=True)
    got = [(r["doc_id"], r["s"]) for r in scored.select("doc_id", toxicity.scorer(spark, model)("text").alias("s")).collect()]
    by = dict(got)
    assert by[1] > 0.7 and by[2] < 0.5 and by[5] < 0.2 and by[3] == by[4] and len(got) == 7
    assert all(0 <= s <= 1 for _, s in got)
    kept = toxicity.clean_documents(scored, model)
    assert kept.columns == scored.columns and 1 not in {r["doc_id"] for r in kept.collect()} and 3 in {r["doc_id"] for r in kept.collect()}


def test_toxicity_misspelled(spark, docs_of):
    docs, labels = toxic_tables(spark, docs_of)
    found = toxicity._Found(toxicity.Matcher(["idiot"]))
    assert [(t, e) for t, e, _ in toxicity.matches("an idiott, an id1ot, an idiot, an indigo", found)] == [("idiot", 1), ("idiot", 1), ("idiot", 0)]
    empty = toxicity.learn(docs, labels.limit(0))
    assert {r["s"] for r in docs.select(toxicity.scorer(spark, empty)("text").alias("s")).collect()} == {0.0}


def brute_losses(seqs, size):
    pairs, singles, before, followers = {}, {}, {}, {}
    for seq in seqs:
        for a, b in zip(seq, seq[1:]):
            pairs[a, b] = pairs.get((a, b), 0) + 1
            singles[b] = singles.get(b, 0) + 1
            before[a] = before.get(a, 0) + 1
            followers.setdefault(a, set()).add(b)
    total = sum(singles.values())

    def loss(a, b):
        one = (singles.get(b, 0) + 1) / (total + size)
        kinds = len(followers.get(a, ()))
        n = before.get(a, 0)
        return -math.log((pairs.get((a, b), 0) + kinds * one) / (n + kinds) if n + kinds else one)

    return loss


def test_cross_entropy_brute_force(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, sentences(rng, EN if i % 3 else DE, 25)) for i in range(60)] + [(900, None), (901, ""), (902, "Unheard words ½ 7"), (None, "the house"), (1, "das haus")]
    docs = docs_of(rows, clashing=True).withColumn("wanted", F.col("doc_id") % 3 != 0)
    model = lm_score.learn(docs, F.col("wanted"), words=20)
    vocab = model[0]
    assert len(vocab) == 20
    numbers = {w: i + 2 for i, w in enumerate(vocab)}
    seqs = {k: lm_score.numbered(t, numbers).tolist() for k, (_, t) in enumerate(rows) if lm_score.words_of(t)}
    wanted = brute_losses([s for k, s in seqs.items() if rows[k][0] is not None and rows[k][0] % 3 != 0], 22)
    everything = brute_losses(list(seqs.values()), 22)
    got = sorted(((r["doc_id"], r["n_tokens"], r["loss_target"], r["loss_background"], r["difference"]) for r in lm_score.score(docs, model).collect()), key=repr)
    want = []
    for k, (i, _) in enumerate(rows):
        steps = list(zip(seqs[k], seqs[k][1:])) if k in seqs else []
        t, b = (sum(f(*s) for s in steps) / len(steps) if steps else 0.0 for f in (wanted, everything))
        want.append((i, len(steps), t, b, t - b))
    for g, w in zip(got, sorted(want, key=repr)):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-5)
    assert lm_score.score(docs_of([]), lm_score.learn(docs_of([]), F.lit(True))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-banner">We use cookies, sure.</div>
{body}
<aside>Side, bar, text, with, many, commas, in, it, and, more.</aside><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><h1>Head</h1><p>One &amp; two,<br>three\n four.<p>Five</article>", "Head One & two, three four. Five"),
    ("<div class='content'><h2>Head</h2><p>Long text, with commas, and so on, for a while.</p><ul><li>Item</li></ul></div>", "Head Long text, with commas, and so on, for a while. Item"),
    ("<article><p>Text<b>bold</b></p><div class='comments'><p>Nice, very, nice, comment, here.</p></div></article>", "Textbold"),
    ("<article></article>", ""),
    ("<article><div>" * 400 + "Deep, text." + "</div></article>" * 400, "Deep, text."),
    ("<main><p>Main&nbsp;text.</p></main>", "Main text."),
])
def test_main_text(body, want):
    assert html_extract.main_text(PAGE.format(body=body)) == want


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a</p>" * 3, "a a a"), ("<", "<"), ("a <b", "a <b"),
                                        ("<script>x", ""), ("<!-- c -->t", "t"), ("<p title='>'>q</p>", "q")])
def test_odd_pages(html, want):
    assert html_extract.main_text(html) == want


def test_pages_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é, x</p></article>"), (1, "u", "<article><p>é, x</p></article>"), (2, None, None), (None, "v", "<p>" + "word " * 50000)],
                                  "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS made")
    got = sorted(((r["page_id"], r["text"][:4], r["n_chars"]) for r in html_extract.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "é, x", 4), (1, "é, x", 4), (2, "", 0), (None, "word", 249999)], key=repr)


@pytest.mark.parametrize("page", [
    "<div>" * 60_000 + "text, more text here" + "</div>" * 60_000,
    "".join(f"<div>word {i}, more" for i in range(50_000)),
    "<p>Some text, here.</p>" + "<a " * 330_000,
    "<span>" * 100_000 + "<p>x" * 50_000 + "</section>" * 20_000,
    "<div>" * 100_000 + "</section>" * 50_000,
    "<p>Some text, here.</p><!-- " + "<b>" * 330_000,
])
def test_odd_pages_of_a_megabyte_take_linear_time(page):
    start = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - start < 20


def test_points_reach_all_levels():
    deep = "<div>" * 200 + "<p>Some text, that is long enough to be an article, with commas, here.</p>" * 3 + "</div>" * 200
    assert html_extract.main_text(deep).count("Some text") == 3
    assert html_extract.main_text("<p>Text, here and there.</p> tail <!-- gone <p>gone</p>") == "Text, here and there. tail"
    assert html_extract.main_text("<p>Text, here and there.</p><p>a < b and <a ") .endswith("a < b and <a")
