"""Nearest rows by codes are the exact ones, and few vectors are looked at."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.operators import codes

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, n, width, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (n, width)) * rng.lognormal(0, 1, (n, 1))
    v[-20:] = v[:20] * 3  # equal directions
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)


def test_answers_are_exact(spark, monkeypatch):
    monkeypatch.setattr(codes, "SHARD_ROWS", 300)
    monkeypatch.setattr(codes, "QUERY_ROWS", 40)
    for n, width, k, own in ((2000, 24, 10, True), (2000, 24, 3, False), (30, 5, 50, True)):
        df = table(spark, n, width, n + k)
        asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
        cost = {}
        got = codes.search(codes.build(df), asked, k, skip_self=own, cost=cost)
        want = vectors.top_k(df, asked, k, skip_self=own)
        key = lambda rows: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["cos"], 5)) for r in rows.collect())
        assert key(got) == key(want)
        if n == 2000:
            assert cost["compared"] < 100 * 4 * (k + 1) and cost["code_bytes"] * 5 < cost["vector_bytes"]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (500, 16)) ** 3
    code, step, off = codes.encoded(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    q = unit[::50]
    assert (np.abs(q @ unit.T - q @ (code * step[:, None]).T) <= off + 1e-12).all() and off.max() < 0.05


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0, 0.0, 0.0]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, None])]
    built = codes.build(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["vec_id"] for r in built.rows.collect()) == [1, 1, 2]
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (7, None), (8, [1.0])], "query_id long, asked array<double>")
    got = lambda **more: sorted((r["query_id"], r["rank"], r["vec_id"], r["cos"]) for r in codes.search(built, asked, 3, **more).collect())
    assert got() == [(1, 1, 1, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 0.0)] and got(skip_self=True) == [(1, 1, 2, 0.0)]
    none = codes.build(spark.createDataFrame([], SCHEMA))
    assert codes.search(none, asked, 3).count() == 0
