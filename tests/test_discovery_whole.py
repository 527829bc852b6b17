"""Pools of any size are clustered whole and in one way."""

import numpy as np
import pytest

from corpusloom.operators import discovery

SCHEMA = "pool string, vec_id long, embedding array<double>"
GROUPS, MEMBERS = 12, 20


@pytest.fixture(scope="module")
def rows():
    """Groups of one size, far from each other whose keys lie between each other's, and vectors that can't be used."""
    rng = np.random.default_rng(12)
    centres = np.linalg.qr(rng.normal(0, 1, (16, 16)))[0][:GROUPS]
    out = [("a", m * GROUPS + g, (centres[g] + rng.normal(0, 0.005, 16)).tolist()) for g in range(GROUPS) for m in range(MEMBERS)]
    out += [("a", 2000, [None, *[1.0] * 15]), ("a", 2001, [float("nan")] * 16), ("a", 2002, [float("inf"), *[1.0] * 15]), ("a", 2003, []), ("b", 3000, [1.0]), ("c", 3001, None)]
    return [out[i] for i in rng.permutation(len(out))]


@pytest.mark.parametrize("by", ["mass", "cut"])
@pytest.mark.parametrize("bounds", [(20_000, 1_000_000), (50, 1_000_000), (50, 100)])
def test_bounds_of_size_change_nothing(spark, monkeypatch, rows, by, bounds):
    for name, value in zip(("POOL_ROWS", "WHOLE_ROWS"), bounds, strict=True):
        monkeypatch.setattr(discovery, name, value)
    found = discovery.discover(spark.createDataFrame(rows, SCHEMA).repartition(3), "pool", by=by)
    assert found.schema["cluster"].dataType.simpleString() == "int"
    got = {r["vec_id"]: r["cluster"] for r in found.collect()}
    assert sorted(got) == sorted(k for _, k, _ in rows)
    # the groups are of one size, so those with the least keys are kept, in their order
    assert all(got[m * GROUPS + g] == (g if g < discovery.KEPT else -1) for g in range(GROUPS) for m in range(MEMBERS))
    assert all(c == -1 for k, c in got.items() if k >= 2000)


def test_the_report_counts_whole_pools(spark, monkeypatch):
    monkeypatch.setattr(discovery, "WHOLE_ROWS", 100)
    found = spark.range(6000).selectExpr("'a' AS pool", "id AS vec_id", "-1 AS cluster")
    assert discovery.report(found, "pool").first()["min_cluster_size"] == 18


def test_blocks_of_large_pools_are_sent_to_a_bounded_number_of_groups(spark, monkeypatch):
    forest = discovery.forest
    monkeypatch.setattr(forest, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(forest, "COPIES", 5)
    blocks = spark.range(100).selectExpr("0L AS pid", "int(id) AS block", "100 AS n_blocks", "64 AS width")
    met = {r["side"]: r["n"] for r in forest._met(blocks).groupBy("side").count().withColumnRenamed("count", "n").collect()}
    assert met == {0: 100, 1: 500}
    monkeypatch.setattr(forest, "HELD", 8 * forest.BLOCK_ROWS * 64 * 10)  # ten blocks
    assert forest._met(blocks).where("side = 1").count() == 1000


def test_larger_groups_give_the_same_clusters(spark, monkeypatch, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in discovery.mass_clusters(df, "pool").collect()}
    for name, value in (("BLOCK_ROWS", 16), ("GROUP_BLOCKS", 1), ("COPIES", 3)):
        monkeypatch.setattr(discovery.forest, name, value)
    assert {tuple(r) for r in discovery.mass_clusters(df, "pool").collect()} == want and len({c for _, _, c in want}) == 9


def test_edges_chosen_in_rounds_or_at_once_give_the_same_clusters(spark, monkeypatch, rows):
    df, looked, renamed = spark.createDataFrame(rows, SCHEMA), [], discovery.forest._renamed
    monkeypatch.setattr(discovery.forest, "_renamed", lambda best: looked.append(1) or renamed(best))
    monkeypatch.setattr(discovery.forest, "BLOCK_ROWS", 40)
    want = {tuple(r) for r in discovery.mass_clusters(df, "pool").collect()}
    assert not looked and len({c for _, _, c in want}) == 9
    monkeypatch.setattr(discovery.forest, "HANDED", 0)
    monkeypatch.setattr(discovery.forest, "LEFT", 0.02)
    assert {tuple(r) for r in discovery.mass_clusters(df, "pool").collect()} == want and looked
