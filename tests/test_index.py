"""The index of vectors: recall against brute force, exact answers with all lists, odd rows, lists of several shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index
from corpusloom.plans import relational, semantic

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k):
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for q, x in queries:
        cos = np.round(v @ (np.array(x) / np.linalg.norm(x)), 6)
        order = np.lexsort((ids, -cos))[:k]
        out[q] = [(int(ids[i]), float(cos[i])) for i in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["cos"], 6)))
    return out


def tables(spark, n=3000, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (40, width))
    v = centres[rng.integers(0, 40, n)] + rng.normal(0, 0.4, (n, width))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    asked = [(i, x) for i, x in rows if i % 20 == 0]
    return rows, asked, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, "query_id long, asked array<double>")


def test_all_lists_are_exact_and_a_part_has_the_recall(spark, monkeypatch):
    monkeypatch.setattr(index, "SHARD_ROWS", 40)  # lists of several shards
    monkeypatch.setattr(index, "QUERY_ROWS", 30)  # and of several blocks of queries
    rows, asked, df, queries = tables(spark)
    built = index.build(df)
    assert built.rows.count() == len(rows) and built.shards.agg(F.max("n_shards")).first()[0] > 1
    want = brute(rows, asked, 10)
    assert {q: [i for i, _ in h] for q, h in answers(index.search(built, queries, 10, len(built.centroids))).items()} == {q: [i for i, _ in h] for q, h in want.items()}
    assert built.probes < len(built.centroids)
    got = answers(index.search(built, queries, 10))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [1.0, 0.0, 0.0]), (6, [0.0, 0.0])]
    built = index.build(spark.createDataFrame(rows, SCHEMA), lists=2)
    assert sorted(r["vec_id"] for r in built.rows.collect()) == [1, 1, 2, 6]
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (7, None), (8, [1.0])], "query_id long, asked array<double>")
    assert answers(index.search(built, queries, 3, 2)) == {1: [(1, 1.0), (1, 1.0), (2, 0.0)]}
    assert answers(index.search(built, queries, 3, 2, skip_self=True)) == {1: [(2, 0.0), (6, 0.0)]}
    none = index.build(spark.createDataFrame([], SCHEMA))
    assert index.search(none, queries, 3, 2).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    got = answers(relational.QUERIES["vector_topk_approximate"](spark, f"/root/testdata/{sf}"))
    want = answers(semantic.vector_topk_batch(spark, f"/root/testdata/{sf}"))
    assert set(got) == set(want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9
