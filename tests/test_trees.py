"""Trees as tables against the walk of nested dictionaries, and their faults."""

import random

from corpusloom.operators import taxonomy, trees


def grown(seed, n, fan):
    """A random tree of n nodes as nested dictionaries, up to 12 levels deep."""
    r = random.Random(seed)
    tree, spots = {}, []
    spots.append((tree, 1))
    for k in range(n):
        children, level = spots[r.randrange(max(0, len(spots) - fan), len(spots))]
        node = {"name": f"Node {k}", "desc": f"d{k}", "source": r.choice(["seed", "discovered"]), "children": {}}
        children[f"k{r.random():.12f}{k}"] = node
        if level < 12:
            spots.append((node["children"], level + 1))
    return tree


def test_order_of_a_large_tree(spark):
    for n, fan in ((100_000, 3000), (300, 5), (1, 1), (0, 1)):
        tree = grown(n, n, fan)
        want = taxonomy.flatten(tree)
        nodes = trees.table_of(spark, tree)
        got = sorted(tuple(r) for r in trees.flat(nodes).select("ord", "key", "parent_key", "level", "name", "description", "source", "path_keys", "breadcrumb", "n_below").collect())
        assert [r[:9] for r in got] == want
        below = {k: 0 for _, k, *_ in want}
        for row in want:
            for key in row[7][:-1]:
                below[key] += 1
        assert {r[1]: r[9] for r in got} == below
        if n < 1000:
            assert trees.faults(nodes).count() == 0


def test_faults(spark):
    rows = [("a", None), ("b", "a"), ("b", "c"), ("d", "gone"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "y"), ("self", "self"), ("c", "a")]
    nodes = spark.createDataFrame([(k, p, i, k, "", "seed") for i, (k, p) in enumerate(rows)], trees.NODE)
    got = sorted(tuple(r) for r in trees.faults(nodes).collect())
    assert got == [("cycle", "self"), ("cycle", "x"), ("cycle", "y"), ("cycle", "z"), ("duplicate key", "b"), ("missing parent", "d")]


def test_rows_below(spark):
    tree = {"a": {"name": "A", "children": {"b": {"name": "B", "children": {"c": {"name": "C"}, "d": {"name": "D"}}}, "e": {"name": "E"}}}, "f": {"name": "F"}}
    flat = trees.flat(trees.table_of(spark, tree))
    rows = spark.createDataFrame([("c",), ("c",), ("e",), ("b",), ("none",)], "best_leaf string")
    assert {r["key"]: r["n"] for r in trees.matched_below(flat, rows).collect()} == {"a": 4, "b": 3, "c": 2, "d": 0, "e": 1, "f": 0}
    assert sorted(tuple(r) for r in trees.counts(flat).collect()) == [(1, "seed", 2), (2, "seed", 2), (3, "seed", 2)]
