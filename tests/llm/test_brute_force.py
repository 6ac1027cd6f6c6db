"""Operators without SQL against plain versions of their definitions."""

import random
import re
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketflow.llm import decontaminate, html_text, langid, pieces, queries, rollup, spotsigs

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


# -- language: profiles and distances


def plain_profile(texts, top=300):
    counts = Counter()
    for text in texts:
        word = []
        for c in (text or "") + " ":
            if c.isalpha():
                word.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
            elif word:
                pad = (0, *word, 0)
                for n in (1, 2, 3):
                    counts.update(g for g in (pad[i : i + n] for i in range(len(pad) - n + 1)) if any(g) and (n < 3 or g[1]))
                word = []
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:top]


def test_language_is_the_plain_out_of_place_distance(spark):
    rng = random.Random(4)
    words = {"en": "the and of house over there", "de": "der und die Haus über dort Straße"}
    texts = [" ".join(rng.choice((words["en"], words["de"])[i % 3 % 2].split() + ["ab" + rng.choice("xyzéß"), "İ", "q1r"]) for _ in range(rng.randrange(1, 60))) for i in range(30)] + [None, "", "123 !"]
    rows = docs(spark, texts).cache()
    by = langid.profiles(rows)
    learned = defaultdict(list)
    for r in rows.where("lang is not null").collect():
        learned[r.lang].append(r.text)
    want = {lang: {g: k for k, g in enumerate(plain_profile(t))} for lang, t in learned.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(rows, by).collect()}
    for i, t in enumerate(texts):
        own = plain_profile([t])
        far = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in want.items()}
        best = min(sorted(far), key=far.get) if own else "und"
        assert got[i] == (best, pytest.approx(1 - far[best] / (300 * len(own)) if own else 0.0)), t


def test_language_of_very_long_texts_is_that_of_their_counts():
    text = " ".join(["the house over there"] * 120_000)
    k, c = langid.grams(text)
    short, few = langid.grams(" ".join(["the house over there"] * 12))
    assert len(text) > 2 * langid.SEGMENT and k.tolist() == short.tolist() and c.tolist() == (few * 10_000).tolist()


# -- decontamination: every alignment of every item


TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def plain_tokens(text):
    """(template, own, kind) of each token, as the module's docstring says."""
    raw = [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text or "")]
    out, before, number = [], 0, False
    for k, (a, b, w) in enumerate(raw):
        opens = k == 0 or any(c in ".!?\n" for c in text[before:a])
        before = b
        low = w.lower()
        if w[0].isdigit() and w[0].isascii():
            if number:
                out[-1] = ("#", out[-1][1] + (low,), 1)
            else:
                out.append(("#", (low,), 1))
            number = True
            continue
        kind = 2 if number and low in decontaminate.UNITS.split() else 0
        if not kind and w[0].isupper() and len(w) > 1 and w[1].islower():
            kind = 3 if not opens else 4 if low not in decontaminate.OPENERS.split() else 0
        number = False
        out.append(({2: "@", 3: "$"}.get(kind, low), (low,), kind))
    return out


def plain_leaks(texts, items, window=6, cover=0.6):
    found = set()
    for item, text in items:
        want = plain_tokens(text)
        n, width = len(want), min(window, len(want))
        for r, t in enumerate(texts):
            have = plain_tokens(t)
            for q in range(-n + 1, len(have)):
                for named in (False, True):
                    def alike(i, q=q, named=named, have=have):
                        x, y = want[i], have[q + i]
                        return x[0] == y[0] or (named and x[2] in (3, 4) and y[2] in (3, 4))

                    places = {i + k for i in range(n - width + 1) if 0 <= q + i and q + i + width <= len(have) and all(alike(i + j) for j in range(width)) for k in range(width)}
                    slots = defaultdict(set)
                    for i in places:
                        if want[i][2] in (1, 2, 3) or (named and want[i][2] == 4):
                            slots[min(want[i][2], 3), want[i][1]].add(have[q + i][1])
                    exact = q >= 0 and q + n <= len(have) and n and all(want[i][1] == have[q + i][1] for i in range(n))
                    if n and (exact or (len(places) >= cover * n and all(len(v) == 1 for v in slots.values()))):
                        found.add((r, item, bool(exact)))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_finds_every_alignment(seed, monkeypatch):
    monkeypatch.setattr(decontaminate, "STATES", 0)  # no chains over several alignments
    rng = random.Random(seed)
    frames = ["A train leaves {N} at {d} and travels {d} km before {N} calls . It then goes {d} miles to {N} .", "{N} has {d} red apples . {N} eats {d} of the apples each day until none are left", "what is {d} plus {d} when {d} is added twice by the teacher", "short one {d}", "what is {d} plus {d} when {d} is added twice by {N}"]

    def made(f):
        names, numbers = rng.sample(["Paris", "Rome", "Oslo", "Bern"], 2), [str(rng.randrange(1, 4)) for _ in range(2)] + ["3.5"]
        return re.sub(r"\{(.)\}", lambda m: rng.choice(names if m[1] == "N" else numbers), f)

    items = [(i, made(frames[i % len(frames)])) for i in range(12)] + [(99, ""), (98, None)]
    texts = [None, "", "nothing of it here"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            t = made(rng.choice(frames)) if rng.random() < 0.6 else rng.choice(items[:12])[1]
            words = t.split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(["blue", "7", "Wien"])
            parts.append(" ".join(words))
        texts.append(rng.choice([" ", ". ", " filler words here and there "]).join(parts))
    want = plain_leaks(texts, items)
    index = decontaminate.Index(items)
    of = {x: c for c in index.classes for xs in c.items.values() for x in xs}
    got = {(r, item, v) for r, item, _, _, v in index.found(pa.array(texts, pa.string()))}
    assert {x for x in got if x[2]} == {x for x in want if x[2]}  # verbatim: by item
    assert {(r, id(of[i])) for r, i, _ in got} == {(r, id(of[i])) for r, i, _ in want}  # else by class of items
    assert len(want) > 20 and any(not x[2] for x in want)


def test_decontamination_of_dumps_and_variants():
    f = "What is the value of {} plus {} when both are added together by the teacher".format
    pair = decontaminate.Index([(1, f(3, 4)), (2, f(6, 7))])
    got = [sorted((r, i, v) for r, i, _, _, v in pair.found(pa.array([t]))) for t in (f"{f(3, 4)} {f(6, 7)}", f"{f(3, 4)} {f(8, 9)}", f"{f(6, 7)} some filler words in between {f(3, 4)}", f"{f(8, 9)} {f(1, 2)}")]
    assert got == [[(0, 1, True), (0, 2, True)], [(0, 1, True)], [(0, 1, True), (0, 2, True)], [(0, 1, False)]]
    many = [(i, f(i, 2 * i + 5)) for i in range(400)]
    began = time.time()
    dump = list(decontaminate.Index(many).found(pa.array([" ".join(t for _, t in many[:50]), " ".join(t for _, t in many)])))
    assert sum(v for *_, v in dump) == 450 and time.time() - began < 5
    twelve = decontaminate.Index([(1, "the plank measures 12 cm by five and is cut into three equal parts each sold")])
    assert [v for *_, v in twelve.found(pa.array(["the plank measures twelve cm by five and is cut into three equal parts each sold"]))] == [False]
    pi = decontaminate.Index([(1, "Pi is about 3.14 and e is about 2.71 in most of the older school books")])
    assert [v for *_, v in pi.found(pa.array(["Pi is about 3.14 and e is about 2.72 in most of the older school books"]))] == [False]
    assert [i for _, i, *_ in pi.found(pa.array(["Pi is about 3.14 and then e is about 2.71 in most of the older school books"]))] == [1]  # a word between: a chain


def test_leaks_and_clean_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    items = [(i, f"question {w} asks how many {w} there are in the {w} box of {i} toys") for i, w in enumerate(("ants", "bees", "cats"))] + [(None, ""), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = docs(spark, [items[0][1], "clean text about nothing in particular at all", f"x {items[2][1]} y", None, "", items[0][1]])
    got = sorted((r.doc_id, r.item_id, r.verbatim) for r in decontaminate.leaks(rows, bench).collect())
    assert got == [(0, 0, True), (2, 2, True), (5, 0, True)]
    assert sorted(r.doc_id for r in decontaminate.clean(rows, bench).collect()) == [1, 3, 4] and decontaminate.clean(rows, bench).columns == rows.columns
    assert decontaminate.leaks(rows, bench.limit(0)).count() == 0 and decontaminate.clean(rows, bench.limit(0)).count() == 6 and decontaminate.leaks(rows.limit(0), bench).count() == 0


# -- fingerprints: chains of words


def plain_chains(text):
    words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS and (i == 0 or words[i - 1] not in spotsigs.ANCHORS):
            run = next((k for k in range(i, len(words)) if words[k] not in spotsigs.ANCHORS), len(words))
            content = [x for x in words[run:] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(content) == spotsigs.CHAIN:
                out.add((*words[i:run], *content))
    return out


def test_signatures_are_the_plain_chains(spark):
    rng = random.Random(8)
    vocabulary = [*spotsigs.ANCHORS, *"cat dog Haus maison straße niño x1 42 été house".split()]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", ",", " -", "\n"]) for _ in range(rng.randrange(0, 40))) for _ in range(80)] + [None, "", "the", "the the a", "the cat", "cat dog", "the cat dog", "a the cat is dog"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n for r in rows.select("doc_id", F.size(spotsigs.signatures(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    sets = {i: plain_chains(t) for i, t in enumerate(texts)}
    assert got == {i: len(s) or int(bool(texts[i])) for i, s in sets.items()}
    digest = {r.doc_id: r for r in spotsigs.digest(rows).collect()}
    whole = lambda t: {("whole", *[w for w in re.split(r"[^\w]+|_", t.lower()) if w])} if t else set()
    for i, t in enumerate(texts):
        nxt = texts[i - 1]
        a, b = (plain_chains(x) or whole(x or "") for x in (t, nxt))
        assert digest[i].near_next == pytest.approx(1.0 if not a and not b else len(a & b) / len(a | b)), (t, nxt)
        half = len(t or "") // 2
        c = (t or "")[: len(t or "") - half] + (nxt or "")[:half]
        edited = plain_chains(c) or whole(c)
        assert digest[i].near_edited == pytest.approx(1.0 if not a and not edited else len(a & edited) / len(a | edited)), (t, c)


# -- token counts


def test_rollup_query_is_a_plain_count(spark, tmp_path):
    texts = ["a few words", "", None, "des mots en plus", "a few words", "日本語 and more"] * 3
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op2_token_counts(spark, str(tmp_path)).collect()}
    counts = rollup.counted(docs(spark, texts), rollup.MANY_RANKS, version=rollup.MANY_VERSION).collect()
    want = defaultdict(lambda: [0, 0])
    for r in counts:
        if r.n_tokens:
            want[r.source, r.lang, r.tokenizer_version][0] += 1
            want[r.source, r.lang, r.tokenizer_version][1] += r.n_tokens
    assert got == {k: tuple(v) for k, v in want.items()}
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    with open(rollup.MANY_RANKS, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=rollup.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in counts} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_rollup_versions_compaction_and_empty_batches(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    row = lambda *x: spark.createDataFrame([x], rollup.CHANGES)
    total = lambda: {(x.tokenizer_version, x.n_docs, x.n_tokens) for x in r.totals().collect()}
    assert r.commit("a", row("insert", "s", "en", "v1", 7, None, None, None, None))
    assert r.commit("b", row("revise", "s", "en", "v2", 9, "s", "en", "v1", 7)) and total() == {("v2", 1, 9)}
    assert r.commit("empty", row("insert", "s", "en", "v1", 7, None, None, None, None).limit(0)) and total() == {("v2", 1, 9)}
    assert r.compact() == 0 and total() == {("v2", 1, 9)} and not r.commit("a", row("insert", "s", "en", "v1", 7, None, None, None, None))
    assert r.commit("c", row("delete", "s", "en", "v2", None, None, None, None, None)) and r.commit("d", row("insert", None, None, None, None, None, None, None, None))
    assert r.compact() == 1 and r.compact() == 2 and total() == {("v2", 0, 9), (None, 1, 0)} and not r.commit("c", row("insert", "s", "en", "v", 1, None, None, None, None))
    assert r._names("batches") == [] and r._names("base") == ["1", "2"]
    with pytest.raises(Exception, match="unknown op"):
        r.commit("x", row("upsert", "s", "en", "v", 1, None, None, None, None))
    with pytest.raises(ValueError, match="batch id"):
        r.commit("../x", row("insert", "s", "en", "v", 1, None, None, None, None))


# -- pieces


@pytest.mark.parametrize("kind", ["letters", "same", "pair", "cjk", "base64", "dashes"])
def test_long_parts_equal_the_library_and_take_seconds(kind):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rng, n = random.Random(1), 300_000
    text = {"letters": lambda: "".join(rng.choices("etaoinshrdlu", k=n)), "same": lambda: "a" * n, "pair": lambda: "xa" * (n // 2), "cjk": lambda: "".join(rng.choices("日本語テキスト漢字", k=n)), "base64": lambda: "".join(rng.choices("ABCXYZabcxyz019+/", k=n)), "dashes": lambda: "-" * n + "="}[kind]()
    began = time.time()
    got = pieces.Encoder().encode([text])[0]
    assert time.time() - began < 10 and got.tolist() == sp.encode(text)


def test_random_short_texts_equal_the_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rng, e = random.Random(2), pieces.Encoder()
    texts = ["".join(rng.choices(rng.choice(["ab", "aab ", "the ", "-=", "in gtio", "é日 x", "\n\t a"]), k=rng.randrange(1, 300))) for _ in range(400)]
    assert [x.tolist() for x in e.encode(texts)] == [sp.encode(t) for t in texts]


# -- pages of other hands than the training ones

PAGES = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Growing tomatoes | Garden Notes</title><link rel=stylesheet href=a.css><style>.x{}</style></head>
<body class="single single-post overflow-hidden"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Garden Notes</a></p><p class="site-description">Notes from a small garden</p>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li><a href="/">Home</a></li><li><a href="/about">About</a></li><li><a href="/shop">Shop</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="main"><article id="post-12" class="post type-post"><header class="entry-header"><h1 class="entry-title">Growing tomatoes</h1></header>
<div class="entry-content"><p>Tomatoes like <a href="/sun">full sun</a> &amp; steady water.</p><h2>Soil</h2><p>Use a loose soil with
   plenty of compost.</p><ul><li>Two parts loam</li><li>One part compost</li></ul><blockquote><p>Feed the soil, not the plant.</p></blockquote>
<div class="sharedaddy"><h3>Share this:</h3><ul><li><a href=t>Twitter</a><li><a href=f>Facebook</a></ul></div></div></article>
<div id="comments" class="comments-area"><h2>2 thoughts on Growing tomatoes</h2><ol class="comment-list"><li class="comment"><p>Great tips, thank you so much!</p></li><li class="comment"><p>Mine never ripen.</p></li></ol>
<form class="comment-form"><label>Name</label><input><textarea></textarea><p>Your email will not be published.</p></form></div></main>
<aside id="secondary" class="widget-area sidebar"><h2 class="widget-title">Recent Posts</h2><ul><li><a href=1>Pruning roses</a><li><a href=2>Winter jobs</a></ul></aside></div>
<footer id="colophon" class="site-footer"><p>&copy; 2024 Garden Notes. Proudly powered by beans.</p></footer></div><script>var a="<p>no</p>";</script></body></html>""",
        ["Growing tomatoes", "Tomatoes like full sun & steady water.", "Soil", "Use a loose soil with plenty of compost.", "Two parts loam", "One part compost", "Feed the soil, not the plant."],
    ),
    (
        """<html><head><title>Bridge reopens</title><body><div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience.</p><button>Accept</button></div>
<div class="topbar"><a href=/login>Log in</a> <a href=/sub>Subscribe</a></div><nav><a href=/w>World</a><a href=/b>Business</a><a href=/s>Sport</a></nav><div class="advert">Buy two, get one free at the corner store!</div>
<main><article itemprop="articleBody" title=it's><h1>Old bridge reopens after nine years</h1><div class="byline meta">By A. Writer</div><figure><img src=a.jpg><figcaption>The bridge on Monday morning.</figcaption></figure>
<p>The old bridge reopened on Monday, nine years after a flood closed it.<p>Engineers said the new piers should last a century.
<aside class="related"><h4>Related stories</h4><ul><li><a href=1>Flood of 2015</a><li><a href=2>Toll plan dropped</a></ul></aside>
<p>"We are relieved," the mayor said. It's open.<div class="ad-slot">Sponsored: fly for less</div><h2>What comes next</h2><p>A second lane opens in spring.</article></main>
<section class="newsletter-signup"><p>Get the morning briefing in your inbox.</p></section><footer><ul><li><a href=/p>Privacy</a><li><a href=/t>Terms</a></ul><p>Copyright 2024 The Daily. All rights reserved.</p></footer></body></html>""",
        ["Old bridge reopens after nine years", "The bridge on Monday morning.", "The old bridge reopened on Monday, nine years after a flood closed it.", "Engineers said the new piers should last a century.", '"We are relieved," the mayor said. It\'s open.', "What comes next", "A second lane opens in spring."],
    ),
    (
        """<!DOCTYPE html><html><head><title>join</title></head><body><div class="navbar"><ul><li><a href=/>Docs</a></li><li><a href=/api>API</a></li></ul></div>
<div class="sidebar"><ul class="toc"><li><a href=#a>Usage</a></li><li><a href=#b>Notes</a></li></ul></div><div class="document"><div class="body" role="main"><h1>join</h1><p>Joins two tables on a <code>key</code>.</p><pre>join(a, b, on="key")</pre>
<h2>Notes</h2><dl><dt>on</dt><dd>Name of the column.</dd></dl><table><tr><th>Kind</th><th>Rows</th></tr><tr><td>inner</td><td>both</td></tr></table><p>See also <a href=/cross>cross joins</a>.</p></div></div><div class="footer">Built with sticks. &copy; 2020</div></body></html>""",
        ["join", "Joins two tables on a key.", 'join(a, b, on="key")', "Notes", "on", "Name of the column.", "Kind", "Rows", "inner", "both", "See also cross joins."],
    ),
    ("<html><head><title>My page</title></head><body><h1>How I built a kayak</h1><p>It began with a sheet of plywood.</p><p>Three weeks later it floated.</p><hr><p>Thanks for reading this long tale about boats.</p></body></html>", ["How I built a kayak", "It began with a sheet of plywood.", "Three weeks later it floated.", "Thanks for reading this long tale about boats."]),
    ("<title>t</title><p>First paragraph here.<p>Second one follows.<ul><li>Point one<li>Point two</ul>", ["First paragraph here.", "Second one follows.", "Point one", "Point two"]),
    (
        """<html><body><div id="header"><img src=l.png><a href=/>Board</a></div><div class="breadcrumbs"><a href=/>Home</a> &raquo; <a href=/f>Forum</a></div><div class="post"><h2>Which oil for an old saw?</h2><div class="text"><p>I found a saw from 1950 and need oil for it.</p><p>What would you use?</p></div></div>
<div class="replies"><div class="reply"><p>Any light machine oil will do.</p></div><div class="reply"><p>Camellia oil is best.</p></div></div><div id="footer"><p>Powered by boards</p></div></body></html>""",
        ["Which oil for an old saw?", "I found a saw from 1950 and need oil for it.", "What would you use?"],
    ),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages_of_other_hands(k):
    page, want = PAGES[k]
    assert html_text.trained().text(page).split("\n") == want


@pytest.mark.parametrize("part", ["<a", '<a b="', "<a b='>'", '<a "', "<div>x", "<span class=ad>", "<b hidden><div>", "</div>", "<p>x", "<!--", "<!", "<li>x<p>", "<a b=\"x' ", "<table><tr><td>x", "<title>", "&amp", "<a href=x>y"])
def test_markup_is_read_in_linear_time(part):
    began = time.time()
    html_text.trained().text(part * (1_000_000 // len(part)))
    assert time.time() - began < 30
    began = time.time()
    html_text.blocks(part * (100_000 // len(part)))
    assert time.time() - began < 3


def test_broken_markup():
    text = lambda page: [x for x, _ in html_text.blocks(page)]
    assert text("<html><head><title>x</title><meta charset=utf-8><article><p>In.</p></article>") == ["In."]
    assert text("<head><p>In.") == ["In."] == text("<head>In.") and text("<title>never closed <p>text") == ["never closed", "text"]
    assert text("<article title=it's><p>One.</p><p>It's two.</p></article>") == ["One.", "It's two."]
    assert text("<p>a < b and c > d</p>x <a href=\"y") == ["a < b and c > d", 'x <a href="y']
    assert text("<p>one <b>two<p>three</b> four") == ["one two", "three four"] and text("<ul><li><p>a<li>b</ul>c") == ["a", "b", "c"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"] and text("<p>x<!-- y --><!-- <p>z") == ["x"]
    assert text("a</body></html><p>b") == ["a", "b"] and text('<p hidden="">x</p>y<p style="display:none">z</p>') == ["y"]
    assert text("<script>a<b</script x>c<STYLE>d</STYLE >e<script>never") == ["ce"] and text("<p>" + "x" * 300_000) == ["x" * 300_000]
