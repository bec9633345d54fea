"""The pipeline's near-duplicate stage against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from cyclora.llm import common, near_copies, simhash


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(texts):
    """Ids that stay; texts by id."""
    top = {k: k for k in texts}
    sets = {k: shingle_set(t) for k, t in texts.items()}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                u, v = find(a), find(b)
                top[max(u, v)] = min(u, v)
    return {k for k in texts if find(k) == k}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [None, "", " ", "one", "one", "one two three four", "One two three four"]
    common = " ".join(rng.choices(vocabulary, k=12))
    for size in (6, 30, 120, 120, 400):
        base = rng.choices(vocabulary, k=size)
        out.append(" ".join(base))
        for _ in range(10):  # also chains, whose ends are not similar
            base = base[:]
            for _ in range(rng.randrange(1, 1 + max(1, size // 40))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            out.append(" ".join(base) + rng.choice(["", f" {common}"]))
    rng.shuffle(out)
    return dict(enumerate(out))


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 65, 400, 3000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (0.0, 0.5, 0.8, 0.95, 1.0):
            kept = a[rng.random(len(a)) < share]
            b = np.unique(np.concatenate((kept, rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 1 + len(a) // 3)))))
            least = near_copies.apart(near_copies.sketch(a), near_copies.sketch(b))
            assert least <= len(np.setxor1d(a, b))
        assert near_copies.apart(near_copies.sketch(a), near_copies.sketch(a)) == 0
    few, none = near_copies.sketch(np.arange(200) * 64), near_copies.sketch(np.arange(300) << 40)
    assert none == b"" and near_copies.apart(few, none) == 0


@pytest.mark.parametrize("few_rows", [0, 10_000])
def test_repeated_rows(spark, texts, few_rows, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", few_rows)
    rows = [r for k, t in texts.items() for r in [(k, t)] * (1 + k % 3)] + [(k + 1000, t) for k, t in texts.items() if k % 4 == 0] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_copies.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(kept_by_all_pairs(dict(rows)))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_same_as_all_pairs(spark, texts, rounds, monkeypatch):
    monkeypatch.setattr(near_copies.linked, "__defaults__", (rounds,))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.one_of_each(docs).collect()}
    assert kept == kept_by_all_pairs(texts) and 8 < len(kept) < len(texts) - 8


def test_stage_drops_copies_beyond_two_bits(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id in (1, 6, 145, 177)")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, sf).collect()}
    assert kept == kept_by_all_pairs({r.doc_id: r.text for r in docs.collect()}) == {1, 6}


def test_stage_keeps_documents_of_null_and_shared_ids(spark, sf):
    words = "amber birch cedar daisy elder".split()
    texts = [f"{w} alone tells of {w} things in {w} places and no other" for w in words]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (8, texts[4]), (None, texts[4])]
    got = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(set(rows[:6]), key=str)
