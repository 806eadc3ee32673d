"""Each operator against a plain version, and with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from knotwork.llm import ann, html_text, langid, line_dedup, media, near_dup, packing, piece_viterbi, quality, shingles, token_shards, tokens

PAGES = Path("/root/testdata/sf0.01/pages.parquet")
SPACE = " \t\n\x0b\x0c\r"
ROWS = [
    (0, "Alpha beta gamma delta, one two three.\nshort\n  A LINE THAT MANY DOCUMENTS HOLD  "),
    (1, "a line that many documents hold\nother words of this one document here"),
    (2, None),
    (3, ""),
    (4, "Über die Straße geht 12 Mal é\n\nA line that many documents hold\nA line that many documents hold\r"),
    (4, "Über die Straße geht 12 Mal é\n\nA line that many documents hold\nA line that many documents hold\r"),
    (None, "no id\na line that many documents hold"),
    (5, "$$$ 123 !!!"),
    (6, "word " * 30000 + "\nthe end of a long text"),
    (7, "日本語 テスト 🎉 mixed <|endoftext|> don't  double  spaces "),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with all sorts of cases, and extra columns whose names the operators use themselves."""
    extra = "line string, score double, media string, gone string, keeper string, `key` string, `__lines` string, `__text` string, `__key` string, `__found` string, `__score` string, n long, v string, id string, raw string, payload string"
    return spark.createDataFrame([(i, t, "x", 1.0, "k", *["c"] * 8, 7, "c", "d", "e", "f") for i, t in ROWS], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plain_lines(items):
    lower = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    holders = {}
    for i, t in items:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(lower)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, t in items:
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            who = holders.get(line.strip(SPACE).translate(lower), set())
            if len(who) < 3 or i == max((x for x in who if x is not None), default=None):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, none):
    got = line_dedup.dedup_lines(docs)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == plain_lines(ROWS)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_dropped"} and got.where("gone = 'c' and __lines = 'c' and __key = 'c' and id = 'd'").count() == len(ROWS)
    assert line_dedup.dedup_lines(none).isEmpty()
    rng = random.Random(1)
    pool = [f"Line number {k} with some more words" for k in range(12)] + ["x", "", " y "]
    items = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    got = line_dedup.dedup_lines(spark.createDataFrame(items, "doc_id long, text string"))
    assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == plain_lines(items)


def test_companding_tables():
    assert media.EXPAND[media.MULAW][[0xFF, 0x7F, 0x80, 0x00]].tolist() == [0, 0, 32124, -32124]
    assert media.EXPAND[media.ALAW][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]


def test_adpcm_against_scalar():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (5, media.BLOCK + 4)).astype(np.uint8)
    blocks[:, 2] %= 89
    got = media.decode_adpcm(blocks)
    for b, out in zip(blocks, got, strict=True):
        value, index, want = int(np.int16(int(b[0]) | int(b[1]) << 8 if b[1] < 128 else (int(b[0]) | int(b[1]) << 8) - 65536)), int(b[2]), []
        want.append(value)
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + int(media.INDEX_CHANGE[code])))
                want.append(value)
        assert out.tolist() == want


def test_media(spark, docs, none):
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.text_as_audio(docs).collect()}
    for i, t in ROWS:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i, hashlib.sha256(padded).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(padded), zlib.crc32(padded[-16:]))
        stored = media.store(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert media.text_as_audio(none).isEmpty()
    for codec in media.NAMES:
        back = media.decode_audio(media.store_bytes(docs.select("doc_id", "text", "score"), "text", codec))
        for r in back.collect():
            assert bytes(r["payload"]) == media.pad((r["text"] or "").encode()) and r["feature"].startswith(media.NAMES[codec])
            assert len(r["pcm"]) == 4 * int(re.search(r"n=(\d+)", r["feature"])[1])
    broken = spark.createDataFrame([(b"RIFF",), (None,), (b"",)], "media binary")
    assert {r["feature"] for r in media.decode_audio(broken).collect()} == {"unreadable"}
    kept = media.decode_audio(media.store_bytes(docs.select("doc_id", "text", "payload", "raw"), "text"))
    assert kept.columns == ["doc_id", "text", "raw", "media", "payload", "pcm", "feature"] and {r["raw"] for r in kept.select("raw").collect()} == {"e"}
    odd = spark.createDataFrame([("x", "a"), ("12", "b")], "doc_id string, text string")
    assert {r["doc_id"] for r in media.text_as_audio(odd).collect()} == {None, 12}


def test_pcm_is_stored(spark, docs, tmp_path):
    got = media.store_pcm(media.store_bytes(docs.select("doc_id", "text"), "text"), f"file://{tmp_path}/pcm")
    want = sorted((repr(i), media.decode_files([media.store((t or "").encode())])[0][1:]) for i, t in ROWS)
    assert sorted((repr(r["doc_id"]), (bytes(r["pcm"]), r["feature"])) for r in got.collect()) == want


def test_resampling_and_feature_against_plain():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 500):
        x = [rng.choice([-32768, 32767, rng.randint(-3000, 3000)]) for _ in range(n)]
        at = lambda i: x[i] if 0 <= i < n else 0
        want = []
        for i in range(n):
            between = (150 * (at(i) + at(i + 1)) - 25 * (at(i - 1) + at(i + 2)) + 3 * (at(i - 2) + at(i + 3)) + 128) // 256
            want += [x[i], max(-32768, min(32767, between))]
        pcm = np.array(x, np.int16)
        up = media.resample(pcm)
        assert up.tolist() == want
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        square = sum(v * v for v in x) // max(1, n)
        crc = zlib.crc32(b"".join(v.to_bytes(2, "little", signed=True) for v in want))
        assert media.feature(media.ALAW, pcm, up) == f"alaw;n={n};peak={max(map(abs, x), default=0)};ms={square};zc={turns};up={crc:08x}"
    assert media.resample(np.array([100] * 6, np.int16))[5] == 100


def test_companding_against_plain():
    for code in range(256):
        u = 255 - code
        size = (((u & 15) * 2 + 33) * 2 ** (u >> 4 & 7) - 33) * 4
        assert media.EXPAND[media.MULAW][code] == (-size if u & 128 else size)
        a = code ^ 0x55
        step = a >> 4 & 7
        size = ((a & 15) * 2 + 1 if not step else ((a & 15) * 2 + 33) * 2 ** (step - 1)) * 8
        assert media.EXPAND[media.ALAW][code] == (size if a & 128 else -size)


def test_language(spark, docs, none):
    words = {"en": "the and of to in is that".split(), "de": "der und die das nicht ist ein".split(), "fr": "le la les des est une pour".split()}
    rng = random.Random(2)
    made = [(k, " ".join(rng.choices(words[lang], k=12)), lang) for k, lang in enumerate(rng.choices(list(words), k=300))]
    table = spark.createDataFrame([*made, (900, None, "en"), (901, "the of", None)], "doc_id long, text string, lang string")
    model = langid.train(table.where(~langid.held_out(table["doc_id"])))
    got = {r["doc_id"]: r for r in langid.identify(table, model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in made)
    assert got[900]["lang_pred"] == "und" and got[900]["score"] == 0
    said = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert said[5] == said[3] == said[2] == "und" and said[6] in words
    assert langid.identify(none, model).isEmpty()
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(table.where("false"))).collect()} == {"und"}
    long = "the and of " * 200_000
    assert model.predict([long])[0] == model.predict(["the and of " * 20])[0]
    kept = langid.keep_identified(docs.withColumn("lang", docs["text"].substr(1, 0)), langid.Model(model.languages, model.log_p, model.prior, model.orders, model.scale), lang_col="gone")
    assert set(kept.columns) == {*docs.columns, "lang"}


def plain_buckets(text, orders, buckets):
    """The bucket of each n-gram, one at a time, in whole numbers."""
    mask, golden = (1 << 64) - 1, 0x9E3779B97F4A7C15
    out = []
    for n in orders:
        for i in range(len(text) - n + 1):
            code = 0
            for c in text[i : i + n]:
                code = (code * golden + ord(c) + 1) & mask
            x = (code + n) & mask
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            out.append((x ^ x >> 31) % buckets)
    return out


def test_language_against_plain(spark):
    """Training and scores from counts of dictionaries and sums of logarithms."""
    rng = random.Random(14)
    made = [(k, "".join(rng.choices("abcde " if k % 2 else "cdefg ", k=rng.randint(1, 30))), "x" if k % 2 else "y") for k in range(40)]
    model = langid.train(spark.createDataFrame(made, "doc_id long, text string, lang string"), buckets=512)
    counts = {"x": [0] * 512, "y": [0] * 512}
    for _, t, lang in made:
        for b in plain_buckets(f" {t.lower()} ", langid.ORDERS, 512):
            counts[lang][b] += 1
    assert model.languages == ["x", "y"] and model.scale == langid.DEFAULT_SCALE
    for text in ("abba", "Gcd", "É", "ace bdf"):
        own, mean = plain_buckets(f" {text.lower()} ", langid.ORDERS, 512), []
        for lang in "xy":
            total = sum(counts[lang])
            mean.append((math.log(0.5) + sum(math.log((counts[lang][b] + 0.1) / (total + 51.2)) for b in own)) / len(own))
        share = [math.exp(model.scale * m) for m in mean]
        name, score = model.predict([text])
        assert name == ["xy"[mean[1] > mean[0]]] and score == [pytest.approx(max(share) / sum(share))]


def test_long_texts_are_cut_without_loss():
    rng = random.Random(15)
    texts = ["".join(rng.choices("abcdeÄΣ \n", k=n)) for n in (0, 1, 5, 64, 65, 129, 1000)]
    for orders in ((1, 2, 3, 4), (2,), (1, 3)):
        for most in (7, 64, 1 << 18):
            got = [[] for _ in texts]
            for whose, which in langid.grams(texts, 4096, orders, most=most):
                for w, b in zip(whose.tolist(), which.tolist(), strict=True):
                    got[w].append(b)
            assert [sorted(x) for x in got] == [sorted(plain_buckets(f" {t.lower()} ", orders, 4096)) for t in texts]
    for most in (16, 1 << 18):
        rows = quality.indicators(texts, 4096 + quality.COUNTS, (1, 2, 3), most)
        for t, row in zip(texts, rows, strict=True):
            want = sorted(set(plain_buckets(f" {t} ", (1, 2, 3), 4096)))
            assert row.tolist() == [*want, 4096 + int(2 * np.log2(len(want) + 1))]


def test_scale_of_scores():
    rng = np.random.default_rng(16)
    means = rng.normal(size=(4000, 3))
    share = np.exp(7 * means)
    label = np.array([rng.choice(3, p=s / s.sum()) for s in share])
    assert 6 < langid.fitted_scale(means, label) < 8.2
    unsure = langid.Model(["a", "b"], np.log(np.array([[0.5, 0.5], [0.5001, 0.4999]])), np.log([0.5, 0.5]), (1,), 10.0)
    assert all(abs(s - 0.5) < 0.01 for s in unsure.predict(["some text of no clear language"])[1])


def test_quality(spark, docs, none):
    rng = random.Random(4)
    words = [a + b for a in "ba be bi bo bu".split() for b in "na ne ni no nu".split()]
    prose = lambda: " ".join(rng.choices(words, k=30)) + "."
    junk = lambda: " | ".join(rng.choices(words, k=30)) + "!!"
    made = [(k, prose() if k % 3 else junk(), int(k % 3 > 0)) for k in range(240)]
    table = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    marks = spark.createDataFrame([(i, q) for i, _, q in made] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(table, marks.where(~quality.held_out(marks["doc_id"])))
    got = {r["doc_id"]: r for r in quality.score(table, model).collect()}
    assert all(got[i]["predicted"] == q and 0 <= got[i]["score"] <= 1 for i, _, q in made)
    assert quality.score(docs, model).count() == len(ROWS) and quality.score(none, model).isEmpty()
    assert quality.keep_good(docs, model).columns == docs.columns
    empty = quality.train(table, marks.where("false"))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.fit([np.array([1])], np.array([True])).score(["x"])[0] > 0.9


def test_descent_finds_the_optimum():
    """The hinge loss at the weights against that at many others near them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    good = x[:, 0] + 0.3 * rng.normal(size=60) > 0
    cols = [np.arange(5)] * 60
    for cost in (0.1, 1.0):
        w, b = quality.dual_coordinate_descent(cols, list(x), good, 5, cost, rounds=3000, tolerance=1e-7)
        y = np.where(good, 1, -1)

        def loss(w, b, cost=cost, y=y):
            return (w @ w + b * b) / 2 + cost * np.maximum(0, 1 - y * (x @ w + b)).sum()

        best = loss(w, b)
        for size in (0.1, 0.01, 0.001):
            assert all(loss(w + size * d[:5], b + size * d[5]) >= best - 1e-6 for d in rng.normal(size=(50, 6)))


def test_quality_margin_against_plain():
    """Ratios, scaling and margins from sets and dictionaries."""
    rng = random.Random(18)
    texts = ["".join(rng.choices("abcd. " if k % 2 else "abcd|! ", k=rng.randint(5, 40))) for k in range(50)]
    good = np.arange(50) % 2 == 1
    dims = 1024 + quality.COUNTS
    rows = quality.indicators(texts, dims)
    ratio = quality.log_count_ratio(rows, good, dims)
    counts = {g: [1 + sum(f in set(r.tolist()) for r, own in zip(rows, good, strict=True) if own == g) for f in range(dims)] for g in (True, False)}
    want = [math.log(counts[True][f] / sum(counts[True])) - math.log(counts[False][f] / sum(counts[False])) for f in range(dims)]
    assert ratio.tolist() == pytest.approx(want)
    model = quality.fit(rows, good, dims, 1.0)
    for r, s in zip(rows, model.score(texts), strict=True):
        length = math.sqrt(sum(float(model.squares[f]) for f in r))
        margin = sum(float(model.weights[f]) for f in r) / length + model.bias
        assert s == pytest.approx(1 / (1 + math.exp(-(model.curve[0] * margin + model.curve[1]))), rel=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<header><h1>The name of the site and what it is for in the world of today</h1></header><!-- <p>not this</p> --><div class="cookie-notice"><p>We use cookies on this site to make it better for you and for all of us.</p></div>
{body}<aside><p>Other things that are on the side of the page and that are of no use to it at all.</p></aside><section id="comments"><p>I think that this is the best of all the articles that I have read on it.</p></section>
<form><p>Sign up for the news of the week and of the month that is to come.</p></form><footer>&copy; it is all ours and it is not for you to take from us in any way</footer></body></html>"""
GOOD = "<h2>Title here</h2><p>This is the first &amp; long part of the article, and it is in the middle of the page.<br>\n It&nbsp;goes on.</p><p>Short.</p><p>And this is the second part of the article, with a <a href=x>link</a> in it, and it is long."
TEXT = "Title here\nThis is the first & long part of the article, and it is in the middle of the page. It goes on.\nShort.\nAnd this is the second part of the article, with a link in it, and it is long."


def test_html_shapes():
    long = "This is the text of the page and it is long enough for all that is to be said of it in the end."
    assert html_text.main_text(f"<html><head><title>T</title><body><p>{long}</p></body></html>") == long
    assert html_text.main_text(f"<html><head><title>T</title><p>{long}</p>") == long
    assert html_text.main_text(f"<body><form><nav><a href='/'>Home</a></nav><p>{long}</p></form></body>") == long
    assert html_text.main_text(f"<body><nav>Menu</nav><form><article><p>{long}</p></article></form></body>") == long
    assert html_text.main_text(f"<article><h1><a href='/x'>A heading</a></h1><p>{long}</p></article>") == f"A heading\n{long}"


LONG = "This is the text of the page and it is long enough for all that is to be said of it in the end."


def test_html_rules_decide():
    """Without an article, each rule changes what is kept."""
    text = lambda body: html_text.main_text(f"<body>{body}</body>")
    words = "lorem dolor amet velit " * 8
    assert text(f"<p>{LONG}</p><p>{words}</p><p>{LONG}</p>") == f"{LONG}\n{LONG}"  # stop-word density
    links = "<a href=x>one of the many links of it</a> " * 3
    assert text(f"<p>{LONG}</p><p>{links}</p><p>{LONG}</p>") == f"{LONG}\n{LONG}"  # link density
    assert text(f"<p>{LONG}</p><p>short</p><p>{LONG}</p><p>{words}</p><p>tail</p><p>{words}</p>") == f"{LONG}\nshort\n{LONG}"  # length, and neighbours
    assert text(f"<p>{words}</p><p>x</p><p>y</p><p>{LONG}</p>") == f"y\n{LONG}"  # the nearer neighbour
    assert text(f"<p>{words}</p><p>x</p><p>{LONG}</p>") == f"x\n{LONG}"  # at equal distance the good one
    assert text("<p>just this</p>") == "just this"  # nothing is clear


def test_html_leaves_out():
    page = lambda part, after="": f"<body><nav><a href=/>Home</a></nav><article><p>{LONG}</p>{part}</article>{after}</body>"
    for part in ('<p class="advert">Buy</p>', "<p hidden>x</p>", '<span class="advert">Buy <b>now</b></span>', '<div style="display: none">x</div>', '<p aria-hidden="true">x</p>', '<div class="cookie-notice">x</div>', '<div id="newsletter-signup-box">x</div>', '<b class="ad">x<p class=ad>y', "<form>x</form>", "<script>x</script>", "<aside>x</aside>", "<!-- x -->"):
        assert html_text.main_text(page(part)) == LONG, part
    for after in (f'<div class="comments"><article><p>{LONG} {LONG}</p></article></div>', f'<section class="related"><article><p>Teaser. {LONG}</p></article></section>', f"<footer>{LONG}</footer>", f'<div class="ad-banner">{LONG}</div>', f"<p>{LONG} outside</p>"):
        assert html_text.main_text(page("", after)) == LONG, after
    for part, kept in (('<section id="legal-discussion"><p>On law.</p></section>', "On law."), ('<div class="banner-story">Of flags.</div>', "Of flags."), ('<div class="search-form-history">How.</div>', "How."), ('<div class="copyright-explained">Who.</div>', "Who."), ('<ul><li class="promo">no<li>yes</ul>', "yes"), ('<p title="the hidden house">yes', "yes"), ('<dl><dt class="ad">no<dd>yes</dl>', "yes"), ('<table><tr><td class="ad">no<td>yes</table>', "yes"), ('<span class="ad">no</span> yes', "yes"), ("<header><h1>Head</h1></header>", "Head")):
        assert html_text.main_text(page(part)) == f"{LONG}\n{kept}", part
    assert html_text.main_text(f'<body><div class="sidebar"><article><p>{LONG}</p></article></div></body>') == LONG
    assert html_text.main_text(f'<body class="menu"><p>{LONG}</p></body>') == LONG


class PlainBlocks(HTMLParser):
    """Blocks by the library's parser, each with the list of all elements around it: for pages whose tags are all closed."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.around, self.parts, self.linked, self.blocks, self.links, self.skip = [], [], 0, [], 0, 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, min(1, self.linked / len(text)), list(self.around)))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW:
            self.skip += 1
        elif tag == "a":
            self.links = 1
        elif tag == "br":
            self.parts.append(" ")
        elif tag in html_text.BLOCK:
            self.flush()
            self.links = 0
            if tag != "hr":
                self.around.append((tag, dict(attrs)))

    def handle_endtag(self, tag):
        if tag in html_text.RAW:
            self.skip -= 1
        elif tag == "a":
            self.links = 0
        elif tag in html_text.BLOCK:
            self.flush()
            self.links = 0
            if any(t == tag for t, _ in self.around):
                while self.around.pop()[0] != tag:
                    pass

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            self.linked += len(data.strip()) if self.links else 0


def plain_text(html):
    """The two passes as the module states them, block by block and neighbour by neighbour."""
    blocks = PlainBlocks(html).blocks

    def off(around):
        return any(t in html_text.ASIDE or (t == "header" and not any(u in ("article", "main") for u, _ in around[:k])) or "hidden" in a or {*(a.get("class") or "").split()} & {"ad", "comments", "related", "sidebar"} for k, (t, a) in enumerate(around))

    inside = [not off(x) and any(t in ("article", "main") for t, _ in x) for _, _, x in blocks]
    found = []
    for (text, links, around), own in zip(blocks, inside, strict=True):
        words = re.findall(r"[^\W\d_]+", text.lower())
        stops = sum(w in html_text.STOP_WORDS for w in words) / max(1, len(words))
        if off(around) or (any(inside) and not own):
            found.append("out")
        elif links > 0.5 and not own:
            found.append("bad")
        elif len(text) >= 70 and links <= 0.5 and stops >= 0.2:
            found.append("good")
        else:
            found.append("bad" if len(text) >= 70 and not own and links <= 0.5 and stops < 0.04 else None)
    part = [k for k, x in enumerate(found) if x != "out"]
    final = {}
    for i, k in enumerate(part):
        near = sorted((abs(i - j), found[m] == "bad") for j, m in enumerate(part) if found[m])
        final[k] = found[k] or ("good" if not near or not any(not bad for _, bad in near) else ("bad" if near[0][1] else "good"))
    return "\n".join(text for k, (text, _, _) in enumerate(blocks) if final.get(k) == "good")


def test_html_against_plain():
    rng = random.Random(19)
    lorem = "lorem dolor amet velit " * 5
    bits = [f"<p>{LONG}</p>", "<p>short</p>", f"<p>{lorem}</p>", "<h2>A heading</h2>", f"<div class=ad>{LONG}</div>", "<ul><li><a href=x>a link of it</a></li><li>item</li></ul>", f"<p hidden>{LONG}</p>", "<hr>", "text &amp; more <b>bold</b><br>line", f"<footer>{LONG}</footer>", "<script>var x = '<p>';</script>", "<p><a href=y>link</a> and then some more of the text that is not in it and is long and is of use</p>", f'<section class="related x"><p>{LONG}</p></section>']
    for k in range(400):
        body = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        if k % 3 == 0:
            body = f"<nav><p>menu</p></nav>{body}<{(tag := rng.choice(['article', 'main']))}>{''.join(rng.choices(bits, k=5))}</{tag}>" + "".join(rng.choices(bits, k=2))
        html = f"<html><head><title>t</title></head><body><header>site</header>{body}</body></html>"
        assert html_text.main_text(html) == plain_text(html), html


@pytest.mark.skipif(not PAGES.exists(), reason="needs the test tables")
def test_html_pages_against_plain():
    """All pages of the small table, as they are and without the article tags, with what may be left out of their markup put in."""
    import pyarrow.parquet as pq

    same = pages = inherited = decided = 0
    for html in pq.read_table(PAGES, columns=["html"]).column(0).to_pylist():
        closed = re.sub(r"<p><b>(.*?)<br><p>", r"<p><b>\1<br></b></p><p>", html or "", flags=re.DOTALL)
        bare = re.sub(r"<(/?)(article|main)\b", r"<\1div", closed)
        assert html_text.main_text(closed) == plain_text(closed) and html_text.main_text(bare) == plain_text(bare)
        same, pages = same + (html_text.main_text(bare) == html_text.main_text(html)), pages + 1
        by = [b.by for b in html_text.read(bare)]
        decided, inherited = decided + by.count(1), inherited + by.count(2)
    assert same >= 0.9 * pages and inherited > 1000 and decided > 1000


def test_html_takes_linear_time():
    for pattern in ("<div>x", "<ul><li>x", "<p>x</section>", '<a "', '<b class="ad">x', "<li>x", "<div class=a>", "</div>", "<x"):
        began = time.process_time()
        html_text.main_text(pattern * 100_000)
        assert time.process_time() - began < 25, pattern


def test_html(spark):
    for body in (f"<article>{GOOD}</article>", f"<main><div>{GOOD}</div></main>", f'<div id="content">{GOOD}</div>'):
        assert html_text.main_text(PAGE.replace("{body}", body)) == TEXT
    cases = [(1, "u", None), (2, None, ""), (3, "u", "just text"), (4, "u", "<p>a &lt;b&gt; &amp;amp; c<p>x < y<br><br>z"), (5, "u", "<script>x"), (5, "u", "<script>x"), (6, "u", '<div title="open>hello</div><p>more'), (7, "u", "<p>" + "the long text of it " * 50000)]
    pages = spark.createDataFrame([(*c, "t", 3) for c in cases], "page_id long, url string, html string, text string, n_chars int")
    got = rows(html_text.extract(pages), "page_id", "url", "text", "n_chars")
    assert got == sorted(((i, u, t, len(t)) for (i, u, _), t in zip(cases, ["", "", "just text", "a <b> &amp; c\nx < y\nz", "", "", "hello\nmore", ("the long text of it " * 50000).strip()], strict=True)), key=repr)
    assert html_text.extract(pages.where("false")).isEmpty()


def test_pieces_like_the_library(spark, docs, none):
    own = piece_viterbi.pieces(piece_viterbi.model_path())
    rng = random.Random(8)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    texts = [t or "" for _, t in ROWS] + [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 6))) for _ in range(20)) for _ in range(300)]
    texts += ["aaaaaaaaaaaaaaa bbbb", "  two  spaces   and more ", "x▁y", "tab\tnew\nline", "eeeeee"]
    coded = own.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == own.processor.encode(texts)
    assert all(own.decode(c) == t.replace("▁", " ") for c, t in zip(coded, texts, strict=True))
    got = piece_viterbi.round_trips(docs)
    assert all(r["round_trip"] for r in got.collect()) and piece_viterbi.round_trips(none).isEmpty()
    back = piece_viterbi.decode(piece_viterbi.encode(docs))
    assert rows(back, "doc_id", "text") == sorted(((i, t or "") for i, t in ROWS), key=repr)


def test_unigram_is_optimal():
    own = piece_viterbi.Pieces(piece_viterbi.model_path(), "unigram")
    sp = own.processor
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}

    def best(word):
        top = [0.0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            top[end] = max(top[s] + scores[word[s:end]] for s in range(end) if word[s:end] in scores and top[s] is not None)
        return top[-1]

    for word in ("▁the", "▁thenoning", "▁hello", "▁straße", "▁tiontion"):
        ids = own.search([word])[0]
        assert "".join(sp.id_to_piece(i) for i in ids) == word and sum(sp.get_score(i) for i in ids) == best(word)


def test_token_ids_like_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.word_bpe_path())
    own = tokens.ChunkIds(tokens.word_bpe_path(), most=5)
    texts = [t or "" for _, t in ROWS] + ["It's CAFÉ naïve!!  été x_y __ a--b ÀÉ... ×÷ ªº straße ΣΑΣ \x1c\x85 12,5 WORD'S", "ß Œuvre $$$", "word<|startoftext|>word"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.word_bpe_path())
    many = spark.createDataFrame([(100 + i, "some words here " * (i * 7 % 900)) for i in range(150)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(many)
    got = packing.pack(table, group_rows=40).collect()
    want = {}
    for r in table.collect():
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        want.setdefault((r["doc_id"], len(ids)), []).append(np.array(ids, "<u4"))
    for (doc, n), copies in want.items():
        own = sorted((r for r in got if r["doc_id"] == doc and r["doc_tokens"] == n), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == n * len(copies)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(copies[0][r["start"] : r["start"] + r["length"]].tobytes())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048
    total = sum(r["length"] for r in got)
    assert total / (2048 * len(by_sequence)) > 0.9
    assert packing.pack(none).isEmpty()


def test_tournament_is_first_fit():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], np.zeros(len(sizes), int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        want[i] = b
        assert offsets[i] == 100 - room[b]
        room[b] -= sizes[i]
    assert bins.tolist() == want.tolist()


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        got = token_shards.feistel(np.arange(n), n)
        assert sorted(got.tolist()) == list(range(n))
        assert n < 64 or (token_shards.feistel(np.arange(n), n, 1) != got).any() and (got != np.arange(n)).mean() > 0.9


def test_token_shards(spark, docs, none):
    plain = tokens.ChunkIds(tokens.word_bpe_path())
    end = plain.tokenizer.get_vocab_size()
    layout = token_shards.write_shards(docs.coalesce(2), seq_len=64, shard_rows=100)
    got = token_shards.read_slots(spark, layout, with_ids=True).collect()
    assert sorted(r["slot"] for r in got) == list(range(layout.sequences)) and all(r["sound"] for r in got) and layout.end_id == end
    assert sum(r["n_tokens"] for r in got) == sum(len(x) // 4 + 1 for x in plain.encode([t or "" for _, t in ROWS]))
    assert sum(r["n_tokens"] < 64 for r in got) <= 1
    part = token_shards.read_slots(spark, layout, 95, 20, with_ids=True).collect()
    assert sorted(r["slot"] for r in part) == list(range(95, 115)) and {r["shard"] for r in part} == {0, 1}
    whole = {r["slot"]: tuple(r) for r in got}
    assert all(whole[r["slot"]] == tuple(r) for r in part)
    again = token_shards.write_shards(docs.coalesce(2), seq_len=64, shard_rows=100)
    assert [tuple(r) for r in sorted(token_shards.read_slots(spark, again, with_ids=True).collect())] == [whole[k] for k in sorted(whole)]
    assert token_shards.read_slots(spark, token_shards.write_shards(none)).isEmpty()
    # the stream in the order of the rows, cut by hand
    one = docs.coalesce(1)
    order = [(r["doc_id"], r["text"]) for r in one.collect()]
    stream = [(doc, at, x, at == 0) for doc, t in order for at, x in enumerate(np.frombuffer(plain.encode([t or ""])[0], "<u4").tolist() + [end])]
    layout = token_shards.write_shards(one, seq_len=50, shard_rows=64)
    cuts = [stream[i : i + 50] for i in range(0, len(stream), 50)]
    slots = token_shards.feistel(np.arange(len(cuts)), len(cuts)).tolist()
    want = {(s, c[0][0], c[0][1], sum(x[3] for x in c) + (not c[0][3]), np.array([x[2] for x in c], "<u2").tobytes()) for s, c in zip(slots, cuts, strict=True)}
    back = token_shards.read_slots(spark, layout, with_ids=True).collect()
    assert {(r["slot"], r["doc_id"], r["start"], r["n_docs"], bytes(r["ids"])) for r in back} == want
    # documents can be told apart again: back in stream order, the end id splits them
    in_order = sorted(back, key=lambda r: slots.index(r["slot"]))
    ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u2") for r in in_order])
    ends = np.flatnonzero(ids == end)
    texts = np.split(ids, ends + 1)[:-1]
    assert [x[:-1].tolist() for x in texts] == [np.frombuffer(x, "<u4").tolist() for x in plain.encode([t or "" for _, t in order])]


def test_token_shards_by_id(spark, docs):
    """Sorted by id and text, the same rows give the same shards, however they are split."""
    found = []
    for n in (1, 5):
        layout = token_shards.write_shards(docs.repartition(n), seq_len=64, by_id=True)
        found.append(sorted(tuple(r) for r in token_shards.read_slots(spark, layout, with_ids=True).collect()))
    assert found[0] == found[1]
    assert token_shards.rows_of_shard(10) == 4096 and token_shards.rows_of_shard(12 * 10**9) == 1 << 18


def test_nearest(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(1500, 24))
    vectors[700:760] = vectors[3] * 2.0
    vectors[800:1000] = vectors[50]
    items = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(2000, None), (2050, []), (2100, [0.0] * 24), (2150, [float("nan")] * 24), (2200, [None] + [1.0] * 23), (2250, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (2300, [1.0] * 3), (100, vectors[100].tolist())]
    table = spark.createDataFrame([(i, v, 0.5) for i, v in items + odd], "vec_id long, embedding array<double>, score double")
    for block_rows in (None, 400):
        got = {}
        for r in ann.nearest(table, block_rows=block_rows).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 1500, 50))
        hit = 0
        for q, near in got.items():
            s = (vectors * vectors[q]).sum(axis=1) / np.sqrt((vectors**2).sum(axis=1)) / np.sqrt((vectors[q] ** 2).sum())
            want = [i for i in np.lexsort((np.arange(len(s)), -np.round(s, 12))) if i != q][:5]
            near.sort()
            assert [k for k, _, _ in near] == [1, 2, 3, 4, 5] and all(abs(x - s[v]) < 1e-12 for _, v, x in near)
            hit += len({v for _, v, _ in near} & set(want))
        assert hit / (5 * len(got)) >= 0.95
        assert [v for _, v, _ in got[50]] == [800, 801, 802, 803, 804]
    assert ann.nearest(table.where("false")).isEmpty()
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert rows(ann.nearest(three), "query_id", "rank", "vec_id") == [(0, 1, 1), (0, 2, 2)]


@pytest.mark.parametrize("kind", ["uniform", "clustered", "copies"])
def test_collisions_find_the_nearest(kind):
    """Blocks of many more vectors than any constant of the index: recall against brute force, and how little is verified."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(12_000, 48))
    if kind == "clustered":
        x = x[rng.integers(0, 300, len(x))] + 0.4 * rng.normal(size=x.shape)
    if kind == "copies":
        x[5000:] = x[rng.integers(0, 5000, 7000)] + 0.05 * rng.normal(size=(7000, 48))
    block = ann.Block(np.arange(len(x)), x, 5)
    hit = 0
    asked = range(0, len(x), 120)
    for q in asked:
        s = ann.cosines(x, x[q])
        s[q] = -2
        hit += len({*block.best(q, x[q])[0].tolist()} & {*np.argsort(-s)[:5].tolist()})
    assert hit / (5 * len(asked)) >= 0.95 and block.index.verified / (len(asked) * len(x)) < 0.1


def test_thresholds_do_the_work():
    """Nothing is verified but what collides: with thresholds that nothing reaches, only the last round finds anything."""
    x = np.random.default_rng(20).normal(size=(3000, 16))
    block = ann.Block(np.arange(3000), x, 5)
    block.best(7, x[7])
    few = block.index.verified
    block.index.reached = np.full(len(ann.RADII), ann.M + 1)
    block.best(7, x[7])
    assert few < 1500 and block.index.verified - few == 2999


def plain_groups(items, width):
    lower = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    sets = []
    for _, t in items:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    parent = list(range(len(items)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(items)):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if items[x][0] is not None and items[y][0] is not None and sets[x] and sets[y] and 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n):
                parent[max(top(x), top(y))] = min(top(x), top(y))
    least = {}
    for x, (i, _) in enumerate(items):
        least.setdefault(top(x), []).append(i)
    return sorted(((i, len(sets[x]), i if i is None else min(least[top(x)]), i is None or i == min(least[top(x)])) for x, (i, _) in enumerate(items)), key=repr)


def test_near_duplicates(spark, docs, none):
    got = near_dup.near_duplicate_groups(docs, width=4)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == plain_groups(ROWS, 4)
    assert near_dup.near_duplicate_groups(none).isEmpty()
    rng = random.Random(12)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    items = []
    for i in range(160):
        words = list(base) if i % 2 else [f"v{rng.randrange(400)}" for _ in range(60)]
        if i % 5 == 0:
            words = base[:60] + words[60:]
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        items.append((1000 - i, " ".join(words)))
    items += [(2000 + k, items[3][1]) for k in range(5)]
    table = spark.createDataFrame(items, "doc_id long, text string")
    got = near_dup.near_duplicate_groups(table, width=4)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == plain_groups(items, 4)
    kept = {i for i, _, _, k in plain_groups(items, 5) if k}
    assert {r["doc_id"] for r in near_dup.drop_near_duplicates(table).collect()} == kept


def test_near_duplicates_of_one_id(spark):
    """Different texts that share an id are told apart, and one row of fully repeated ones stays."""
    rng = random.Random(3)
    a, b, c = ([f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "abc")
    near = " ".join([*a[:59], "other"])
    items = [(3, " ".join(a)), (5, near), (5, " ".join(b)), (7, " ".join(c)), (7, " ".join(c)), (8, " ".join(c)), (9, ""), (None, " ".join(a))]
    table = spark.createDataFrame(items, "doc_id long, text string")
    got = near_dup.near_duplicate_groups(table, width=4)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == plain_groups(items, 4)
    left = [(3, " ".join(a)), (5, " ".join(b)), (7, " ".join(c)), (9, ""), (None, " ".join(a))]
    assert sorted(map(tuple, near_dup.drop_near_duplicates(table).collect()), key=repr) == sorted(left, key=repr)


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """Documents that vary one template: pairs that are compared grow with their number, whether they are linked or not."""
    compared = []
    likely = near_dup.likely
    monkeypatch.setattr(near_dup, "likely", lambda pairs, *a: (compared.append(pairs.count()), likely(pairs, *a))[1])
    for n in (300, 1200):
        rng = random.Random(n)
        items = []
        for i in range(n):
            words = [f"t{k}" for k in range(200)]
            for _ in range(22):
                words[rng.randrange(200)] = f"u{rng.randrange(10**9)}"
            items.append((i, " ".join(words)))
        table = spark.createDataFrame(items, "doc_id long, text string")
        got = rows(near_dup.near_duplicate_groups(table, width=4), "doc_id", "n_shingles", "component_id", "kept")
        if n == 300:
            assert got == plain_groups(items, 4)
    assert compared[1] <= 10 * 1200


def test_near_duplicates_of_parts_and_mixtures(spark):
    """Truncated copies, few changes from a small vocabulary and shared inserts, under one template."""
    rng, template, items = random.Random(23), [f"t{k}" for k in range(200)], []
    for i in range(200):
        words = list(template)
        if i % 4 == 0:
            words = template[: 90 + i // 2]
        elif i % 4 == 1:
            at = rng.randrange(150)
            words[at : at + 30] = [f"g{i % 7}_{j}" for j in range(30)]
        else:
            for _ in range(rng.randrange(3, 16)):
                words[rng.randrange(200)] = f"s{rng.randrange(12)}" if i % 4 == 2 else f"u{rng.randrange(10**7)}"
        items.append((i, " ".join(words)))
    got = near_dup.near_duplicate_groups(spark.createDataFrame(items, "doc_id long, text string"), width=4)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == plain_groups(items, 4)


def test_sketches(spark):
    a, b = np.random.default_rng(2).integers(0, 2**63, (2, 252)).astype(np.uint64)
    b[:200] = a[:200]
    x, y = near_dup.sketches(np.stack([a, b]))
    want = int(((a & np.uint64(15)) != (b & np.uint64(15))).sum())
    frame = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<long>, y array<long>")
    assert frame.select(near_dup.differing("x", "y")).first()[0] == want > 30


def test_superminhash():
    sign = shingles.SuperMinHash(128)
    rng = np.random.default_rng(13)
    for n, share in ((400, 0.8), (40, 0.5), (3, 0.2)):
        got = []
        for _ in range(60):
            common = round(2 * n * share / (1 + share))
            x = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            a, b = sign([np.sort(x[:n]), np.sort(x[n - common :])])
            got.append((a == b).mean())
            assert (a >> np.uint64(56)).max() < 128
        true = common / (2 * n - common)
        assert abs(np.mean(got) - true) < 4 * np.sqrt(true * (1 - true) / 128 / 60)
        assert np.std(got) < 1.1 * np.sqrt(true * (1 - true) / 128)
    one = sign([np.array([5], np.uint64)])[0]
    assert sorted((one >> np.uint64(56)).tolist()) == list(range(128))
    assert (sign([np.empty(0, np.uint64)]) == np.iinfo(np.uint64).max).all()


def test_words_across_chunks(monkeypatch):
    text = " ".join(f"Word{k}" for k in range(5000)) + "\n tail"
    want = shingles.shingle_sets([text, None, "a"], 4)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(want, shingles.shingle_sets([text, None, "a"], 4), strict=True))


def test_new_chunks_are_matched_at_once(monkeypatch):
    """One pass over a batch's new chunks, whatever line ends of other scripts they hold, and the tokenizer's own ids."""
    calls = []
    monkeypatch.setattr(tokens, "_PLAIN", SimpleNamespace(findall=lambda x, own=tokens._PLAIN: calls.append(x) or own.findall(x)))
    ids_of = tokens.ChunkIds(tokens.word_bpe_path())
    texts = ["Plain words, (again). don't Éclair!! x9 __ a\x85b c d   e\x1cf\x1d \x00 İstanbul", "", " ", "plain WORDS,\r\nnew\x0bline\x0cfeed"]
    got = ids_of.encode(texts)
    want = [ids_of.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want and len(calls) == 1
