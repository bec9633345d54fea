"""Mixing, the learnt operators, web pages, URLs and media."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cyclora.llm import html_text, language, media, mixing, quality, url_rules
from cyclora.llm.common import read

# --- mixing ----------------------------------------------------------------------------------------------------------


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets, reshared until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in order if s not in full)
        share = {s: most * sizes[s] if s in full else left * w[s] / free for s in order} if free else {s: most * sizes[s] for s in order}
        above = {s for s in order if s not in full and share[s] > most * sizes[s]}
        if not above:
            return share
        full |= above


def mixed_case(spark, n=1500, seed=3):
    rng = random.Random(seed)
    names = ["s0"] * 30 + ["s1", "ä", "Z", "s10", None, "tiny"]
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(names[:-1]) if i else "tiny") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_meets_its_targets(spark):
    docs = mixed_case(spark)
    rows = mixing.mix_report(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
    want = filled(sizes)
    largest, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.taken == r.copies * r["size"] <= 3 * r["size"]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= int(rate) + 1
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, total in taken.items():
        assert abs(total - want[s]) <= largest[s]
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_expected_copies_are_kept(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, source string")
    share = defaultdict(list)
    for seed in range(10):
        for r in mixing.decisions(docs, weights=(1, 2), seed=seed).collect():
            share[r.doc_id].append(r.copies - r.target / r.source_size)
    means = [np.mean(v) for v in share.values()]
    assert abs(np.mean(means)) < 0.05 and max(map(abs, means)) < 0.7  # 10 draws have a deviation of 0.16 each


def test_meeting_passes_words_on():
    import pandas as pd

    rng = random.Random(1)
    x = pd.DataFrame({"leaf": [i // 40 for i in range(200)], "source": ["a" if i % 40 < 25 else "b" for i in range(200)], "mass": [float(rng.randrange(0, 30)) for _ in range(200)], "draw": [rng.random() for _ in range(200)], "frac": [rng.random() for _ in range(200)], "i": range(200)})
    batches = [x[:33], x[33:34], x[34:120], x[120:]]
    out = pd.concat(mixing._meet(iter([b.reset_index(drop=True) for b in batches]), ["leaf", "source"], False)).sort_values("i")
    assert out.i.tolist() == list(range(200))
    before, after = ((d.assign(w=d.mass * d.frac).groupby(["leaf", "source"]).w.sum()) for d in (x, out))
    assert np.allclose(before, after)
    assert (((out.frac > 0) & (out.frac < 1)).groupby([out.leaf, out.source]).sum() <= 1).all()


def test_mix_repeats_rows(spark, sf):
    docs = read(spark, sf, "documents")
    n = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
    got = {r.doc_id: r.n for r in mixing.mix(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: c for k, c in n.items() if c}


def test_repeated_rows_are_taken_alike(spark):
    rows = [(i // 2, f"w{i // 2} x", "a") for i in range(60)] + [(100 + i, "y " * 5, "b") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = defaultdict(set)
    for r in mixing.mix_report(d).collect():
        by[r.doc_id].add(r.copies)
    assert all(len(v) == 1 for v in by.values())


# --- quality and language --------------------------------------------------------------------------------------------


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(0)
    x, size = rng.normal(size=(9, 4)), np.array([4, 1, 3, 1])
    f = quality.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    got = f.marginals(x, size)
    first = 0
    for n in size:
        odds, total, good = x[first : first + n] @ f.weight, 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = np.array([bits >> i & 1 for i in range(n)])
            p = np.exp((odds * y).sum() + sum(f.step[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            good += p * y
        assert np.allclose(got[first : first + n], good / total)
        first += n


def test_quality_held_out(spark):
    d, labels = (read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    rows = quality.score(d, quality.train(d, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_automaton_has_substrings_and_no_others():
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(60))
    step = language.suffix_automaton(data)

    def has(x):
        state = 0
        for c in x:
            if c not in step[state]:
                return False
            state = step[state][c]
        return True

    for _ in range(2000):
        x = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 9)))
        assert has(x) == (x in data)


def test_phrases_by_brute_force():
    samples = {"a": b"abracadabra alakazam", "b": b"hocus pocus fidibus"}
    p = language.Parser(samples)
    for text in ("hocus abra", "zzz", "abracadabra hocus pocus", "q", "pocus q fidi"):
        coded = language.letters(text)
        for k, name in enumerate(p.names):
            count, i = 0, 0
            while i < len(coded):
                j = i + 1
                while j <= len(coded) and coded[i:j] in samples[name]:
                    j += 1
                i, count = max(j - 1, i + 1), count + 1
            block = np.full((1, language.BLOCK), p.width - 1, np.uint8)
            block[0, : len(coded)] = p.symbol[np.frombuffer(coded, np.uint8)]
            assert p.phrases(block, np.array([0]))[k, 0] == count, (text, name)


def parsed(text, sample):
    """Greedy phrases of a text, one after another."""
    coded, i, count = language.letters(text), 0, 0
    while i < len(coded):
        n = 1
        while i + n < len(coded) and coded[i : i + n + 1] in sample:
            n += 1
        i, count = i + n, count + 1
    return count


def test_predictions_by_brute_force():
    """Texts of many blocks too, some of which never fall into step with a parse that starts elsewhere."""
    rng = random.Random(8)
    words = {"a": "abra cada bra alaka zam simsala".split(), "b": "hocus pocus fidibus lirum larum".split()}
    samples = {k: language.letters(" ".join(rng.choices(w, k=300))) + bytes(x) * 40 for (k, w), x in zip(words.items(), (b"xyx", b"xyxyy"))}
    p = language.Parser(samples)
    texts = [" ".join(rng.choices(words["a"] + words["b"], k=k)) for k in (1, 3, 90, 700, 4000)]
    texts += ["xyx" * 2000, "xyxyy" * 900 + " abra", "q" * 3000, "abra " * 1500, "x" * 511, "x" * 510, "½", "12", "", None, "é"]
    got = p.predict(texts)
    for text, (name, score) in zip(texts, got):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == ("und", 0.0)
            continue
        costs = {k: parsed(text, samples[k]) * math.log2(len(samples[k])) for k in samples}
        least, other = sorted(costs.values())
        assert costs[name] == least and score == pytest.approx(1 - least / other), text[:20]


def test_language_held_out(spark):
    d = read(spark, "/root/testdata/sf0.01", "documents")
    rows = language.identify(d, language.learn(d)).join(d, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.98


def test_language_of_texts_without_letters(spark):
    d = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("hello world again", "en"), ("bonjour le monde", "fr"), (None, "en"), ("123 !? ½ ²", "en"), ("②③", None)] * 4)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(d, language.learn(d)).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(20) if i % 5 > 1)


# --- pages and urls --------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<div id="cookie-notice">We use cookies, a lot of them, on this and on every other page.</div>
<header><h1>Site name</h1><p>A header text</p></header><nav><a href="/">Home</a> <a href="/b">B</a></nav>
%s
<section class="comments"><p>Reader comment that goes on for long, long, long, long, long, long, long.</p></section>
<form><p>Subscribe to our letter</p></form><aside><p>Side text</p></aside><script>var x = "<p>no</p>";</script><footer><p>Foot &copy;</p></footer></body></html>"""
BODY = '<h2>Head &amp; line</h2><p>First   para\nwith <a href="x">a link</a> &eacute;.</p><p>Second<br>para<ul><li>one<li>two</ul><div class="ad">Buy now</div><p>Last &#x41;'
TEXT = "Head & line\nFirst para with a link é.\nSecond para\none\ntwo\nLast A"


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main><div>%s</div></main>", '<div class="wrap"><div class="content">%s</div></div>'])
def test_main_text(shell):
    assert html_text.extract(PAGE % (shell % BODY)) == TEXT


def test_names_of_parts():
    inner = '<article class="post"><div class="entry-header"><h1>Title</h1></div><p>Body text of it.</p><div class="share-buttons">Share</div></article>'
    for outer in ('<div class="has-sidebar layout-with-ads">%s</div>', '<div class="sidebar-right wrapper">%s</div>', '<div id="page">%s<div class="comments"><article class="comment">Nice text, says a reader.</article></div></div>'):
        assert html_text.extract(PAGE % (outer % inner)) == "Title\nBody text of it."


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>cut <b", "cut"), ("<nav>n</nav>", ""), ("<div>" * 30_000 + "deep", "deep"), ("a &lt; b < c", "a < b < c")])
def test_odd_pages(html, text):
    assert html_text.extract(html) == text


def test_pages_of_the_test_tables(spark, sf):
    rows = html_text.main_text(read(spark, sf, "pages")).collect()
    assert all(r.n_chars == len(r.text) > 0 for r in rows)


def test_form_around_a_page():
    page = "<body><form><div><h1>Title</h1><p>A long text of the page.</p><p>And some more of it.</p></div><input><label>Your name</label></form></body>"
    assert html_text.extract(page) == "Title\nA long text of the page.\nAnd some more of it."


def walk(node):
    yield node
    for x in node.body:
        if isinstance(x, html_text.Node) and x.hint:
            yield from walk(x)


def plain_text(node):
    return "".join("".join(x.split()) if isinstance(x, str) else plain_text(x) if x.hint else "" for x in node.body)


def recount(top):
    """Densities and sums from the definition: each node's subtree is walked anew."""
    whole = list(walk(top))
    in_links = lambda n: sum(len(plain_text(x)) for x in walk(n) if x.tag == "a" and not any(p.tag == "a" for p in up(x, n)))
    share = in_links(top) / max(1, len(plain_text(top)))
    out = {}
    for n in whole:
        inside = list(walk(n))
        c, t = len(plain_text(n)), max(1, len(inside) - 1)
        lc, lt = in_links(n), sum(x.tag == "a" for x in inside)
        d = 0.0
        if c:
            base = math.log(c / max(1, c - lc) * max(1, lc) + share * c + math.e)
            d = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / math.log(base)
        out[id(n)] = d
    sums = {id(n): sum(out[id(x)] for x in n.body if isinstance(x, html_text.Node) and x.hint) for n in whole}
    return out, sums


def up(node, top):
    while node is not top:
        node = node.parent
        yield node


def test_densities_by_recount(spark, sf):
    pages = [r.html for r in read(spark, sf, "pages").collect()][:60] + [PAGE % BODY]
    for page in pages:
        top = html_text.parse(page)
        nodes = html_text.measure(top)
        density, sums = recount(top)
        for n in nodes:
            assert n.density == pytest.approx(density[id(n)], rel=1e-6, abs=1e-9) and n.sum == pytest.approx(sums[id(n)], rel=1e-6, abs=1e-9)
        shown = [n for n in nodes if n.chars]
        built = [n for n in shown if any(isinstance(x, html_text.Node) and x.hint and x.chars and x.tag in html_text.BLOCKS for x in n.body)]
        chosen = html_text.densest(shown)
        if chosen.tag not in ("body", "html"):
            assert sums[id(chosen)] * chosen.weight == max(sums[id(n)] * n.weight for n in built if n.tag not in ("body", "html"))


def without_names(monkeypatch):
    hint = html_text.hint
    monkeypatch.setattr(html_text, "hint", lambda *a: 1.0 if hint(*a) else 0.0)


def test_density_finds_the_text_without_names(spark, monkeypatch):
    """With names left out of account, and on pages without classes, ids, `article` and `main`, the same text comes out."""
    pages = [r.html for r in read(spark, "/root/testdata/sf0.01", "pages").collect()]
    right = [html_text.extract(p) for p in pages]
    bare = [re.sub(r"<(/?)(article|main)\b", r"<\1div", re.sub(r'\s(class|id)="[^"]*"', "", p)) for p in pages]
    assert np.mean([html_text.extract(b) == t for b, t in zip(bare, right)]) >= 0.99
    without_names(monkeypatch)
    assert np.mean([html_text.extract(p) == t for p, t in zip(pages, right)]) >= 0.99


@pytest.mark.parametrize(("names", "least"), [(False, 0.5), (True, 0.15)])
def test_densities_decide(spark, monkeypatch, names, least):
    """Random densities, whose sums are formed as they should be, change what comes out."""
    pages = [r.html for r in read(spark, "/root/testdata/sf0.01", "pages").collect()]
    right, measure, rng = [html_text.extract(p) for p in pages], html_text.measure, random.Random(4)
    if not names:
        without_names(monkeypatch)

    def at_random(top):
        nodes = measure(top)
        for n in nodes:
            n.density = rng.random()
        for n in nodes:
            n.sum = sum(x.density for x in n.body if isinstance(x, html_text.Node) and x.hint)
        return nodes

    monkeypatch.setattr(html_text, "measure", at_random)
    assert np.mean([html_text.extract(p) != t for p, t in zip(pages, right)]) > least


WORDY = "<p>%s</p>" % ("A paragraph of a hundred letters or so that says what it has to say and ends in a full stop here. " * 2)


@pytest.mark.parametrize("part", ["<footer>%s</footer>", "<aside>%s</aside>", '<div class="comments">%s</div>', '<div class="sidebar">%s</div>', '<section role="complementary">%s</section>', '<div class="newsletter">%s</div>'])
def test_wordy_parts_beside_the_text(part):
    """Parts of short paragraphs and of some that are as long as the text's own."""
    for inside in ("<p>Short line here.</p><p>Another one.</p>", WORDY):
        page = f"<body><nav><ul><li><a href=x>A</a><li><a href=y>B</a></ul></nav><div><h1>Head</h1>{WORDY * 6}</div>{part % inside}</body>"
        assert html_text.extract(page).count("\n") == 6


def slow_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in url_rules.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and best.verdict


def test_url_rules(spark, sf):
    odd = [None, "", "example.com/en/1", "http://EXAMPLE.com/en/7", "http://xexample.net/de/8", "http://net/de/", "http://a.b?x://c/en/", "ftp://com/en/a#b", "http://x.com/en", "x://", "a\n://Y.org/es/\n?q", "http://com/en/://x"]
    urls = [r.url for r in read(spark, sf, "pages").collect()] + odd
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.judge(d).collect():
        host, path, rule, verdict = slow_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_mined_rules_by_counting(spark):
    rng = random.Random(5)
    sets = [(sorted(rng.sample("abcdef", rng.randrange(1, 5))),) for _ in range(200)]
    rows = [(s, "block" if "a" in s and "b" in s else "allow" if rng.random() < 0.8 else None) for (s,) in sets]
    d = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    known = [(set(s), v) for s, v in rows if v]
    rules = url_rules.mine(d, 0.05, 0.6)
    assert any(r.tokens == {"a", "b"} and r.verdict == "block" and r.confidence == 1.0 for r in rules)
    for r in rules:
        own = [v for s, v in known if r.tokens <= s]
        assert own.count(r.verdict) / len(own) == pytest.approx(r.confidence) and own.count(r.verdict) / len(known) >= 0.05
    index = url_rules.Index(rules)
    for s, _ in rows:
        fits = [r for r in rules if r.tokens <= set(s)]
        assert index.best(s) == (min(fits, key=url_rules.Mined.rank) if fits else None)


def test_mined_rules_never_do_worse_than_the_default(spark):
    """Each given rule's urls, judged by what the others' urls teach: not below what the default alone gets right."""
    for r in url_rules.leave_one_out(read(spark, "/root/testdata/sf0.01", "pages")).collect():
        assert r.right >= r.plain and r.n > 0, r


THREE = (url_rules.Rule("block", "a.com", "/ads/"), url_rules.Rule("block", "b.net", "/ads/"), url_rules.Rule("block", "c.org", "/ads/"), url_rules.Rule("allow", "d.io", "/news/"), url_rules.Rule("allow", "e.io", "/news/"))


def test_what_several_given_rules_say_is_carried_over(spark):
    urls = [f"http://h{i}.{r.host}{r.path}{'x' if i % 2 else 'y'}/{i}" for r in THREE for i in range(120)]
    urls += [f"http://s{i}.other.dev{path}{i}" for i in range(20) for path in ("/ads/", "/news/", "/shop/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = url_rules.judge(pages, rules=THREE, otherwise="allow").collect()
    for r in rows:
        assert r.verdict == ("block" if "/ads/" in r.path else "allow") and (r.rule is not None or (r.mined_rule is None) == ("/shop/" in r.path))
    for r in url_rules.leave_one_out(pages, rules=THREE).collect():
        assert r.right == (r.n if r.rule != "d.io/news/" and r.rule != "e.io/news/" else r.plain) and r.n == 120
    # of one given rule alone nothing is carried over
    rows = url_rules.judge(pages, rules=THREE[:1]).collect()
    assert all(r.verdict == ("block" if r.rule else "allow") and r.mined_rule is None for r in rows)


def test_rules_must_hold_on_other_hosts_and_without_any_given_rule(spark):
    rule = lambda t: url_rules.Mined(frozenset([t]), "block", 0.9, 0.1)
    two = lambda k: ("p", "q")[k % 2]
    rows = [(["good"], "block", two(g // 2), g, g % 2 == 0) for g in range(40)]
    rows += [(["one host"], "block", two(g), 3, True) for g in range(20)]
    rows += [(["not held"], "block", two(g), g, False) for g in range(10)]
    rows += [(["wrong there"], "allow" if g % 2 == 0 else "block", two(g // 2), g, g % 2 == 0) for g in range(20)]
    rows += [(["one rule"], "block", "p", g, g % 2 == 0) for g in range(20)]
    rows += [(["hangs on one"], "block" if g < 36 else "allow", "p" if g < 36 else "q", g, g % 2 == 0) for g in range(40)]
    d = spark.createDataFrame(rows, "tokens array<string>, verdict string, given string, hosts int, held boolean")
    got = url_rules.proven([rule(t) for t in ("good", "one host", "not held", "wrong there", "one rule", "hangs on one", "unseen")], d)
    assert [r.tokens for r in got] == [{"good"}]


# --- media -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", [None, "", "a", "ÿ" * 500, "".join(chr(random.Random(1).randrange(32, 5000)) for _ in range(3000)), "x" * 100_000])
def test_films_round_trip(text):
    n, payload = media.padded(text)
    assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ") and n == len((text or "").encode())
    film = media.write_avi(media.encode_frames(payload))
    rate, frames = media.read_avi(film)
    samples = media.decode_frames(frames)
    assert rate == 25 and samples.tobytes() == payload
    plain = media._lossless(media.Jpeg(frames[0]), frames[0])  # the serial decoder agrees
    assert (plain == samples[0]).all()
    d = media.film_digest(film)
    assert d["payload_sha256"] == hashlib.sha256(payload).hexdigest() and d["tail_crc32"] == zlib.crc32(payload[-16:]) and d["media_sha256"] == hashlib.sha256(film).hexdigest()


def baseline_jpeg(blocks):
    """A gray baseline image of flat 8 x 8 blocks, coded with one-byte DC categories."""
    high, wide = len(blocks) * 8, len(blocks[0]) * 8
    dc = bytes([0x00] + [0, 0, 0, 12] + [0] * 12 + list(range(12)))  # twelve categories, four bits each
    ac = bytes([0x10] + [1] + [0] * 15 + [0])  # end of block
    bits, last = "", 0
    for row in blocks:
        for v in row:
            value = (v - 128) * 8
            d, last = value - last, value
            k = abs(d).bit_length()
            bits += f"{k:04b}" + (f"{d if d > 0 else d + (1 << k) - 1:0{k}b}" if k else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg = media._segment
    return b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, bytes([8, high >> 8, high & 255, wide >> 8, wide & 255, 1, 1, 0x11, 0])) + seg(0xC4, dc + ac) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_baseline_frames():
    blocks = [[10, 200, 128], [0, 255, 77]]
    got = media.decode_frames([baseline_jpeg(blocks)])[0]
    assert got.shape == (16, 24)
    assert all(abs(int(got[8 * r, 8 * c]) - v) <= 1 for r, row in enumerate(blocks) for c, v in enumerate(row))


def test_clips_of_a_film(spark):
    scenes = [[[20, 30]], [[200, 220]], [[90, 100]]]
    frames = [baseline_jpeg(s) for s in scenes for _ in range(12)]
    film = media.write_avi(frames, 16, 8, 10)
    rows = media.clips(spark.createDataFrame([(1, bytearray(film))], "media_id long, content binary")).orderBy("clip").collect()
    assert [(r.first_frame, r.n_frames, r.start_s, r.end_s) for r in rows] == [(0, 12, 0.0, 1.2), (12, 12, 1.2, 2.4), (24, 12, 2.4, 3.6)]
    no_index = film[: film.rindex(b"idx1")]
    assert media.read_avi(no_index)[1] == frames
