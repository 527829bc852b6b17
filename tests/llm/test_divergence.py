"""Divergence of sources against brute force, on odd rows, with small chunks and blocks, and exact shares of large counts."""

import collections
import random
import re

import numpy as np
import pytest

from corpusloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, chunk int, a string, total string, item string"


def brute(rows):
    docs = collections.defaultdict(lambda: collections.defaultdict(int))
    total, own, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(LOW))
        for w in set(words):
            docs[lang][w] += 1
        total[lang].update(words)
        own[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = [w for w, n in docs[lang].items() if n >= 3]

        def shares(counts, kept=kept):
            n = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // (n + len(kept)) for w in kept}

        p = shares(own[lang, source])
        f = lambda x, y: (x - y) ** 2 // y
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                q = shares(own[lang, other])
                pairs.append((other, sum(f(p[w], q[w]) for w in kept)))
        q = shares(total[lang])
        terms = [(w, f(p[w], q[w])) for w in kept if own[lang, source][w] > 0 and p[w] > q[w]]
        for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:most])]
    return sorted(out)


def found(spark, rows):
    df = divergence.divergences(spark.createDataFrame([(*r, "t", 1, 2, "a", "b", "c") for r in rows], SCHEMA))
    assert dict(df.dtypes)["value"] == "bigint" and dict(df.dtypes)["rank"] == "int"
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def corpus(seed, n, words, langs=("en", "de"), sources=7):
    r = random.Random(seed)
    out = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 40))), r.choice(langs), f"s{r.randint(0, sources)}") for k in range(n)]
    return out + [
        (None, "Alpha ALPHA alpha é1É x2y", None, None), (1, None, "en", "s0"), (1, None, "en", "s0"), (2, "", "fr", "alone"), (3, "alpha " * 5000, "en", "s1"), (4, "words no one else has", "es", "u"), (5, None, "es", "v"),
        (6, "ß 漢字 😀", None, "z"), (7, "ß 漢字 😀 " + "w" * 5000, "", "z"), (8, "ß 漢字 [😀] " + "w" * 5000, "", ""), (9, "w" * 5000, "", "y"),
    ]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("CHUNK_TERMS", 3), ("BLOCK_GROUPS", 2), ("HELD", 50)):
            monkeypatch.setattr(divergence, name, value)
    words = [a + b for a in "abcdefg" for b in ("lpha", "eta", "É", "X")]
    rows = corpus(4, 150, words)
    assert found(spark, rows) == brute(rows)


def test_more_terms_than_ranks(spark):
    words = ["".join(x) for x in __import__("itertools").product("abcdefgh", repeat=3)]
    rows = corpus(5, 200, words, ("en",), 1)
    want = brute(rows)
    assert max(r[5] for r in want if r[2] == "term") == 200
    assert found(spark, rows) == want


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None, None)]) == []


def test_shares_of_large_counts(spark):
    r = random.Random(1)
    for total in (7, 10**9 + 7, 10**12 + 39, 9 * 10**14 + 1):
        n = [0, total - 1, min(total - 1, divergence.FITS), *(r.randrange(total) for _ in range(30))]
        want = [1 + 10**9 * (x + 1) // total for x in n]
        assert divergence.shares(np.array(n, np.int64), total).tolist() == want
        assert [r[0] for r in spark.createDataFrame([(x, total) for x in n], "n long, total long").select(divergence.share("n", "total")).collect()] == want
