"""Top inner products against brute force: odd vectors, copies, ties, small cells, large integers."""

import collections
import math
import random

import numpy as np
import pytest

from corpusloom.llm import thresholds

SCHEMA = "vec_id long, embedding array<double>, num long, key string, query long, score long, block int"
SMALL = {"SHARD_ROWS": 20, "BLOCK_ROWS": 3, "LEAST_ROWS": 5, "LEAST_QUERIES": 2, "SHARDS": 8, "BLOCKS": 4, "STRIPE": 2, "PAIRS": 40}


def brute(rows, k=20):
    good = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, tuple(max(-(2**62), min(2**62, math.floor(64 * x))) for x in v)))
    good = set(good)
    out = collections.Counter()
    for i, v in good:
        if i is None or i % 20:
            continue
        found = []
        for j, w in good:
            if len(w) == len(v) and (i, v) != (j, w):
                s = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))
                found.append((-s, j is None, j or 0))
        out.update((i, n + 1, None if lost else j, -s) for n, (s, lost, j) in enumerate(sorted(found)[:k]))
    return out


def found(spark, rows, k=20):
    df = thresholds.top_products(spark.createDataFrame([(i, v, 1, "k", 2, 3, 4) for i, v in rows], SCHEMA), k)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def corpus(seed=1, n=400, size=9):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, 1) for _ in range(size)]) for k in range(n)]
    hot, near = rows[7][1], rows[11][1]
    rows += [(1000 + k, list(hot)) for k in range(150)] + [(3000 + k, [x + r.gauss(0, 0.02) for x in near]) for k in range(100)]
    rows += [(40, list(hot)), (40, list(hot)), (40, rows[3][1]), (None, list(hot)), (None, rows[5][1]), (-20, list(near)), (5000, list(hot))]
    rows += [(6000, None), (6020, []), (6040, []), (6041, []), (6060, [1.0, None]), (6080, [math.nan] * size), (6100, [math.inf] * size), (6120, [0.0] * size), (6140, [0.5, 1.0]), (6141, [-0.5, 1.0]), (6160, [2.0])]
    return rows


@pytest.mark.parametrize("way", ["whole", "cells"])
def test_against_brute_force(spark, monkeypatch, way):
    if way == "cells":
        for name, value in SMALL.items():
            monkeypatch.setattr(thresholds, name, value)
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_lists_name_few(spark, monkeypatch):
    """Most rows are in no list, and where a list says all, nothing is lost."""
    rows = corpus(5)
    want = brute(rows, 4)
    for many in (1, 10**6):
        monkeypatch.setattr(thresholds, "MANY", many)
        monkeypatch.setattr(thresholds, "LISTS", 3 if many == 1 else 2)
        assert found(spark, rows, 4) == want


def test_phases(spark):
    """The cutoff is safe and the lists of phase 2 name every row that reaches it."""
    rows = [(k, v) for k, v in corpus(6) if k is not None and v is not None and len(v) == 9 and all(map(math.isfinite, v))]
    vectors, _ = thresholds.vectors_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5)
    layout = thresholds.Layout(6, 3, 2, 2, 32, 100)
    lists = thresholds._cut(vectors, "shard", thresholds._place(3, 0), 2, thresholds.LIST)
    asks = thresholds._cut(vectors.where("asked"), "block", thresholds._place(2, 0), 2, thresholds.ASK)
    first = thresholds.resolved(thresholds.gathered(thresholds._cells(lists, asks, layout), layout), lists, asks, layout, "first")
    ints = {r["num"]: np.array(r["ints"]) for r in vectors.collect()}
    by = collections.defaultdict(list)
    for r in first.collect():
        assert r["score"] == ints[r["query"]] @ ints[r["num"]]
        by[r["query"]].append(r["score"])
    asked = [r["num"] for r in vectors.where("asked").collect()]
    assert set(by) == set(asked)
    for q in asked:
        scores = sorted((int(ints[q] @ v) for v in ints.values()), reverse=True)
        assert sorted(by[q], reverse=True)[5] <= scores[5]


def test_empty(spark):
    assert not found(spark, []) and not found(spark, [(20, None), (40, [math.nan])]) and not found(spark, [(20, [1.0])])


def test_large_components(spark):
    rows = [(k, [k / 7, -k / 3]) for k in range(60)] + [(20 * k, [float(2**k) * s, 3.0**k]) for k in range(0, 40, 3) for s in (1, -1)] + [(1, [1e300, 1.0]), (2, [-1e300, 1e300]), (3, [2.0**50 + 1, -(2.0**50)])]
    assert found(spark, rows, 7) == brute(rows, 7)
