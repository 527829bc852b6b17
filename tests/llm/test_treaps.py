"""Treaps hold their orders, prune, and rank like brute force, whatever the shards and however items are sent."""

import collections
import math
import random
import re

import numpy as np
import pytest

from corpusloom.llm import treaps

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, row long, item_id string, term string, rank int, score long, shard string"
ITEMS = "item_id string, text string, row long, terms string, doc_id long"


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=50):
    bags = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, n_words = len(bags), sum(len(w) for _, w in bags)
    df = collections.Counter(t for _, w in bags for t in set(w))
    out = []
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        found = []
        for i, words in bags:
            count = collections.Counter(words)
            m = 100 - 50 + 50 * len(words) * n_docs // n_words
            score = sum(w * (10**9 * count[t] // (1000 * count[t] + 20 * m)) for t, w in weights.items() if count[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if lost else i, -s) for k, (s, lost, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=50):
    d = spark.createDataFrame([(i, t, 1, "x", "t", 2, 3, "s") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 5, "t", 6) for i, t in items], ITEMS)
    df = treaps.ranked(d, b, k)
    assert dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["score"] == "bigint"
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def corpus(seed=3, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = [(r.randrange(10**6), " ".join(r.choices(vocabulary, weights, k=r.randint(1, 60)))) for _ in range(n)]
    docs += [(7, "same words w40 w41"), (8, "same words w40 w41"), (6, "same words w40 w41"), (6, "same words w40 w41"), (None, "same words w40 w41")]
    docs += [(9, None), (10, ""), (11, " \x00 [] "), (12, "É é ÉTÉ 漢字 W40"), (13, "w50 " * 30_000), (14, "q" * 70_000 + " w3"), (-5, "w59 W59"), (None, None)]
    items = [(f"i{k}", " ".join(r.choices(vocabulary, k=r.randint(1, 25)))) for k in range(25)]
    items += [("same", "same words W40"), (None, "été 漢字 w40"), ("none", None), ("empty", ""), ("twice", "w59 w59 w58"), ("twice", "w57"), ("absent", "zzz"), ("long", "w3 " + "q" * 70_000)]
    return docs, items


@pytest.mark.parametrize("way", ["whole", "shards", "dealt"])
def test_against_brute_force(spark, monkeypatch, way):
    if way != "whole":
        for name, value in (("SHARD_DOCS", 40), ("SHARD_POSTINGS", 500), ("TOGETHER", 20)):
            monkeypatch.setattr(treaps, name, value)
        monkeypatch.setattr("corpusloom.llm.shared.CHUNK", 2000)
        monkeypatch.setattr(treaps.chunks, "__defaults__", (2000,))
    if way == "dealt":
        for name, value in (("SENT_TERMS", 0), ("SENT_PAIRS", 0), ("BLOCK_PAIRS", 40)):
            monkeypatch.setattr(treaps, name, value)
    docs, items = corpus()
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_empty(spark):
    docs, items = corpus(n=5)
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [], []) == []
    assert found(spark, [(1, None)], items) == []


def made(seed, n_docs=400, n_terms=12, steep=1.0):
    """A shard of random postings."""
    r = np.random.default_rng(seed)
    shard = treaps.Shard()
    sizes = r.integers(30, 3000, n_docs)
    for k in range(n_docs):
        own = np.flatnonzero(r.random(n_terms) < 0.3)
        tf = np.maximum(1, (sizes[k] * r.random(len(own)) ** 6 * steep)).astype(np.int64) if len(own) else own
        shard.add([int(r.integers(10**6))], sizes[k : k + 1], np.zeros(len(own), np.int64), own.astype(np.uint64), tf)
    row = shard.row("s")
    return treaps.Treaps(next(treaps._shards(row)), n_docs, int(sizes.sum()))


@pytest.mark.parametrize("seed", range(4))
def test_orders(seed):
    t = made(seed, steep=1.0 if seed else 0.0)  # the first has many equal impacts
    seen = 0
    for root in t.root:
        stack = [(int(root), -1, t.width)]
        while stack:
            node, low, high = stack.pop()
            if node < 0:
                continue
            seen += 1
            assert low < t.doc[node] < high
            for child, bounds in ((int(t.left[node]), (low, t.doc[node])), (int(t.right[node]), (t.doc[node], high))):
                assert child < 0 or t.impact[child] <= t.impact[node]
                stack.append((child, *bounds))
    assert seen == len(t.doc)


def test_pruning():
    t = made(9, n_docs=8000)
    best = treaps.Best(1, 10)
    item, term, weight = np.zeros(6, np.int64), np.arange(6), np.array([900, 500, 300, 2000, 100, 50])
    scored = treaps.descend(t, item, term, weight, best)
    scores = np.zeros(t.width, np.int64)
    for k, w in zip(term, weight, strict=True):
        own = t.term == k
        scores[t.doc[own]] += w * t.impact[own]
    order = np.lexsort((t.ids, -scores))[:10]
    assert best.score.tolist() == scores[order].tolist() and best.doc.tolist() == t.ids[order].tolist()
    assert scored < (scores > 0).sum() / 3


def test_weights_beyond_the_native_range():
    shard = treaps.Shard()
    shard.add([1, 2], np.array([2**40, 1]), np.array([0, 1]), np.array([5, 5], np.uint64), np.array([2**20, 1]))
    t = treaps.Treaps(next(treaps._shards(shard.row("s"))), 2**30, 2**45)
    want = [10**9 * tf // (1000 * tf + 20 * (50 + 50 * n * 2**30 // 2**45)) for n, tf in ((2**40, 2**20), (1, 1))]
    assert t.impact.tolist() == want
