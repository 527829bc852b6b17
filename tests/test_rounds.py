"""Rounds of discovery on a planted tree: names, keys, versions, and when they end."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import rounds, trees
from corpusloom.sources.documents import read_latest


def test_class_terms(spark):
    texts = [(1, "alpha beta the the"), (1, "alpha the gamma"), (2, "Beta beta the É été été"), (2, None), (3, "of it 12"), (3, "")]
    rows = spark.createDataFrame(texts, "c int, t string")
    count = collections.Counter((c, w) for c, t in texts for w in re.findall(r"[^\W\d_]{3,}", (t or "").lower()))
    whole, classes = collections.Counter(), {c for c, _ in count}
    for (_, w), n in count.items():
        whole[w] += n
    average = sum(count.values()) / len(classes)
    want = set()
    for c in classes:
        scored = sorted((-round(n * math.log(1 + average / whole[w]), 6), w) for (k, w), n in count.items() if k == c)
        want |= {(c, w, -s, r + 1) for r, (s, w) in enumerate(scored[:2])}
    assert {(r["c"], r["term"], r["score"], r["rank"]) for r in rounds.class_terms(rows, "c", "t", 2).collect()} == want
    names = {r["c"]: (r["name"], r["wanted"]) for r in rounds.named(rows, "c", "t").collect()}
    assert names[2] == ("Été Beta The", "t_beta_the")  # the rarer first and names[3] == ("Topic", "topic")


def test_free_keys(spark):
    taken = spark.createDataFrame([("a",), ("a_3",), ("b_2",), ("c_2",), ("c",)], "key string")
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "c_2"), (7, "new"), (8, "new_2"), (9, "new")], "i int, wanted string")
    got = {r["i"]: r["key"] for r in rounds.free_keys(wanted, taken, ["i"]).collect()}
    assert got == {1: "a_2", 2: "a_4", 3: "b", 4: "b_3", 5: "c_3", 6: "c_2_2", 7: "new", 8: "new_2", 9: "new_3"}


@pytest.fixture(scope="module")
def planted(spark):
    """Two known leaves; beside them gaps of two clusters at level 1 and at level 3, each with words of its own."""
    rng, size = np.random.default_rng(3), 24
    axis = np.eye(size)
    known = [axis[0] + axis[1] + axis[2], axis[0] + axis[1] + axis[3]]
    gaps = {"kettle lamp": axis[10], "piano violin": axis[11], "radio tunnel": axis[0] * 1.5 + axis[1] * 1.5 + axis[12] * 0.9, "garden spade": axis[0] * 1.5 + axis[1] * 1.5 + axis[13] * 0.9}
    rows = []
    for word, centre, n in (("budget", known[0], 60), ("invoice", known[1], 60), *((w, c, 40) for w, c in gaps.items())):
        for _ in range(n):
            rows.append((len(rows), (centre + rng.normal(0, 0.03, size)).tolist(), f"the {word} and {word} of the house"))
    nodes = [("m", None, 0, "Money", "d", "seed", axis[0].tolist()), ("p", "m", 0, "Paper", "d", "seed", (axis[0] + axis[1]).tolist()), ("b", "p", 0, "Budget", "d", "seed", known[0].tolist()), ("i", "p", 1, "Invoice", "d", "seed", known[1].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, text string"), spark.createDataFrame(nodes, trees.NODE + ", vec array<double>")


def test_rounds_fill_the_gaps(spark, planted, tmp_path):
    rows, nodes = planted
    path = f"file://{tmp_path}/rounds"
    made = rounds.discover(rows, nodes, (0.5, 0.7, 0.95), 4, path)
    assert len(made) >= 2 and made[-1].found.count() == 0  # the last found nothing
    found = {r["name"]: (r["level"], r["parent_key"], r["size"]) for m in made for r in m.found.collect()}
    assert {k.lower().split()[0] for k in found} >= {"kettle", "piano", "radio", "garden"}
    level = {k.lower().split()[0]: v for k, v in found.items()}
    assert level["kettle"][:2] == (1, None) and level["piano"][:2] == (1, None) and level["radio"][:2] == level["garden"][:2] == (3, "p") and level["kettle"][2] >= 30
    last = trees.flat(read_latest(spark, f"{path}/tree").drop("vec", "version"))
    leaves = last.where("n_below = 0")
    assert leaves.where("level <> 3").count() == 0 and trees.faults(last.select("key", "parent_key", "name")).count() == 0
    kettle = next(k for k in found if k.startswith("Kettle"))
    crumbs = {r["breadcrumb"] for r in last.where(F.startswith("name", F.lit(kettle))).collect()}
    assert crumbs == {kettle, f"{kettle} > {kettle} (General)", f"{kettle} > {kettle} (General) > {kettle} (General)"}
    moved = {r["measure"]: (r["old"], r["new"]) for r in rounds.changes(made[0], made[-1]).collect()}
    assert moved["status UNKNOWN"][1] == 0 and moved["status ASSIGNED"] == (120, 280) and moved["rows"] == (280, 280)
    assert moved["nodes 1 seed"] == (1, 1) and moved["nodes 1 discovered"][0] == 0 < moved["nodes 1 discovered"][1]
    assert spark.read.parquet(f"{path}/measures").select("version").distinct().count() == len(made)
    assert {(r["pool"], r["clustered"]) for r in made[0].pools.collect()} >= {("1/", True), ("3/p", True)}


def test_faulty_trees_are_refused(planted):
    rows, nodes = planted
    with pytest.raises(ValueError, match="missing parent b"):
        rounds.discover(rows, nodes.where("key <> 'p'"), (0.5, 0.5, 0.5))
