"""Operators on texts against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F
from test_near_copies import kept_by_all_pairs

import corpus_pipeline
from cyclora.llm import decontamination, licenses, lines, simhash
from cyclora.llm.common import read

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return _WORDS.findall((text or "").translate(_LOWER))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return read(spark, sf, "documents")


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


# --- decontamination -------------------------------------------------------------------------------------------------


def contamination(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, other in items:
        x = words(other)
        n = min(13, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if x else set()
        for i in range(len(w) - n + 1 if x else 0):
            if tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination(spark, sf, docs, rows):
    bench = read(spark, sf, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {r.doc_id: contamination(r.text, items) for r in rows}
    for most in (60_000, 150):  # one automaton, and several
        got = {r.doc_id: tuple(r)[1:] for r in decontamination.decontaminate(docs, bench, max_windows=most).collect()}
        assert got == want
        kept = {r.doc_id for r in decontamination.keep_clean(docs, bench, max_windows=most).collect()}
        assert kept == {k for k, v in want.items() if not v[-1]}
    assert any(v[-1] for v in want.values())


def test_overlapping_and_short_items(spark):
    bench = spark.createDataFrame([(7, "Alpha BETA"), (8, "beta gamma"), (9, " ".join(f"w{i}" for i in range(15)))], "item_id long, text string")
    text = "alpha-beta, gamma! " + " ".join(f"W{i}" for i in range(14)) + " w99"
    d = spark.createDataFrame([(1, text), (2, "alphabeta gamma")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(d, bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (18, 17, 3)
    assert (got[2].n_hit, got[2].contaminated) == (0, False)
    spans = decontamination.contaminated_spans(d, bench).collect()
    assert {(r.item_id, r.passage) for r in spans} == {("7", "alpha-beta"), ("8", "beta, gamma"), ("9", " ".join(f"W{i}" for i in range(14)))}
    assert all(text[r.first_char : r.end_char] == r.passage for r in spans)


# --- licenses --------------------------------------------------------------------------------------------------------


def license_row(text):
    w = words(text)
    places, labels, score = [], set(), 0.0
    base = set()
    for t in licenses.TEMPLATES:
        own = set(t.words)
        if t.phrase:
            at = [i for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
            places += at
            if at:
                base.add(t.label)
                labels.add(t.label)
                score = 1.0
        else:
            c = t.span
            for k in range(0, max(1, len(w)), c):
                part = len(own & set(w[k : k + 2 * c])) / len(own)
                if len(own & set(w[k : k + 2 * c])) >= t.need:
                    labels.add(t.label)
                    score = max(score, part)
    ends = (min(places), max(places)) if places else (None, None)
    return len(w), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)


def license_cases():
    mit = next(t.text for t in licenses.TEMPLATES if t.label == "mit-text")
    damaged = " ".join(x for i, x in enumerate(mit.split()) if i % 9)
    filler = "the of and software license copy notice " * 30
    return ["MIT license", "mit\n\nLICENSE mit-license Mit License2", "general public. license", "public license", filler + mit.upper() + filler, filler + damaged, mit[: len(mit) // 2], "Apache License " * 50, "xmit license", "mité license", "all Rights; reserved"]


def test_license_cases(spark):
    cases = license_cases()
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: (*tuple(r)[1:-1], round(r.score, 9)) for r in licenses.scan(d).collect()}
    assert got == {i: license_row(t) for i, t in enumerate(cases)}
    assert "mit-text" in got[4][5] and "mit-text" in got[5][5]


def test_license_scan(docs, rows):
    got = {r.doc_id: (*tuple(r)[1:-1], round(r.score, 9)) for r in licenses.scan(docs).collect()}
    assert got == {r.doc_id: license_row(r.text) for r in rows}


def test_license_scan_is_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- lines -----------------------------------------------------------------------------------------------------------


def deduped(rows):
    """Texts after dedup, by brute force; rows are (id, text)."""
    first, gone, split = {}, {}, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        split[key] = (text or "").split("\n")
        at = [i for i, x in enumerate(split[key]) if x.strip(" ")]
        for i in range(len(at) - 2):
            win = tuple(split[key][j].strip(" ") for j in at[i : i + 3])
            a, b = at[i], at[i + 2]
            if win not in first:
                first[win] = (key, b)
            else:
                a = max(a, first[win][1] + 1) if first[win][0] == key else a
                gone.setdefault(key, set()).update(range(a, b + 1))
    return {k: None if t is None else "\n".join(x for i, x in enumerate(split[k]) if i not in gone.get(k, ())) for k, t in rows}


def test_line_dedup(docs, rows):
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == deduped([(r.doc_id, r.text) for r in rows])
    assert any(got[r.doc_id] != r.text for r in rows)


def test_line_dedup_cases(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a", "", "c"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\na\na\na\na\na\na"), (103, "p\n\nq\n\nr"), (104, "s\np\nq\nr\nt")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == deduped(rows)
    assert got[104] == "s\nt"


# --- simhash ---------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, budget=2):
    """Component of each key, by all pairs."""
    parent = {k: k for k in prints}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_near_duplicates(docs, rows):
    prints = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    want = linked(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {k: (f"{p:016x}", want[k]) for k, p in prints.items()}
    kept = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert kept == {k for k, c in want.items() if k == c}


@pytest.mark.parametrize("most", [20_000, 12])
def test_links_of_close_fingerprints(spark, most):
    rng = random.Random(most)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(18):
            values.add(base)
            base ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4)))
    values |= {rng.getrandbits(6) for _ in range(40)} | {0, (1 << 64) - 1}
    prints = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(k,) for k in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps, most=most)).collect()}
    want = linked(prints)
    assert {k: roots.get(k, k) for k in prints} == want


# --- the pipeline's stages -------------------------------------------------------------------------------------------


def test_stages_in_order(spark, sf, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, sf)
        before = {r.doc_id: r.text for r in now.collect()}
        rows = after.collect()
        left = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(left) and left.keys() <= before.keys()
        if name == "line dedup":
            assert left == deduped(list(before.items()))
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "simhash near-dedup":
            kept = kept_by_all_pairs(before)
            assert left == {k: t for k, t in before.items() if k in kept}
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
            assert left == {k: t for k, t in before.items() if not contamination(t, items)[-1]}
        now = after.cache()
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    copies = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert all(r.n == r.m <= 3 for r in copies)
