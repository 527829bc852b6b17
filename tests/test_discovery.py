"""Clusters of pools: sizes, noise, and rows beyond what is clustered."""

import collections

import numpy as np

from corpusloom.operators import discovery

SCHEMA = "pool string, vec_id long, embedding array<double>"


def found(spark, rows):
    df = discovery.discover(spark.createDataFrame(rows, SCHEMA), "pool")
    assert df.columns == ["pool", "vec_id", "cluster"]
    return [tuple(r) for r in df.collect()]


def test_small_clusters_and_noise_of_a_pool(spark):
    rng = np.random.default_rng(3)
    sizes = [1400] * 4 + [40] * 3
    near = np.concatenate([np.eye(16)[c] + rng.normal(0, 0.01, (n, 16)) for c, n in enumerate(sizes)])
    vectors = np.concatenate([near, rng.normal(0, 1, (280, 16))])
    rows = [("a", i, v.tolist()) for i, v in enumerate(vectors)] + [("a", 7000, None), (None, 7001, vectors[0].tolist())]
    got = found(spark, rows)
    assert sorted(k for _, k, _ in got) == [*range(len(vectors)), 7000, 7001]
    label = {k: c for _, k, c in got}
    ends = np.cumsum(sizes).tolist()
    groups = [collections.Counter(label[i] for i in range(z - n, z)).most_common(1)[0] for n, z in zip(sizes, ends, strict=True)]
    assert sorted(c for c, _ in groups) == list(range(7)) and all(k > 0.7 * n for (_, k), n in zip(groups, sizes, strict=True))
    assert np.mean([label[i] == -1 for i in range(ends[-1], len(vectors))]) > 0.9 and label[7000] == label[7001] == -1


def test_rows_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(discovery, "POOL_ROWS", 300)
    rng = np.random.default_rng(4)
    vectors = np.concatenate([np.eye(8)[c] + rng.normal(0, 0.01, (300, 8)) for c in range(2)])
    rows = [("a", i, v.tolist()) for i, v in enumerate(vectors)]
    rows += rows[:5]  # rows that repeat a key stay rows
    got = found(spark, rows)
    assert collections.Counter(k for _, k, _ in got) == collections.Counter(k for _, k, _ in rows)
    label = collections.defaultdict(collections.Counter)
    for _, k, c in got:
        label[k >= 300][c] += 1
    tops = [label[side].most_common(1)[0] for side in (False, True)]
    assert {c for c, _ in tops} == {0, 1} and all(n > 270 for _, n in tops)


def plainly(vectors, least):
    """Clusters of most mass, by the definition: components of all points at each distance, as sets."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    far = np.sqrt(np.maximum(2 - 2 * unit @ unit.T, 0))
    core = np.sort(far, axis=1)[:, least - 1]
    far = np.round(np.maximum(far, np.maximum(core[:, None], core)), 9)
    levels = np.unique(far[np.triu_indices(len(far), 1)])[::-1]

    def parts(members, below):
        left, out = set(members), []
        while left:
            part = [left.pop()]
            for x in part:
                new = [y for y in left if far[x, y] < below]
                left.difference_update(new)
                part += new
            out.append(sorted(part))
        return out

    def best(members, birth, k, whole):
        mass, now = 0.0, members
        for level in range(k, len(levels)):
            pieces = parts(now, levels[level])
            if len(pieces) == 1:
                continue
            big = [p for p in pieces if len(p) >= least]
            gain = 1 / levels[level] - birth
            mass += gain * sum(len(p) for p in pieces if len(p) < least or len(big) != 1)
            if len(big) != 1:
                inner = [best(p, 1 / levels[level], level + 1, False) for p in big]
                below = sum(m for m, _ in inner)
                return (mass, [members]) if mass >= below and not whole else (below, [c for _, found in inner for c in found])
            now = big[0]
        return mass, [] if whole else [members]

    return {tuple(c) for c in best(list(range(len(far))), 0.0, 0, True)[1]}


def test_clusters_of_most_mass_follow_the_definition():
    rng = np.random.default_rng(5)
    seen = collections.Counter()
    for _ in range(30):
        spread = rng.uniform(0.02, 0.6)
        centres = rng.normal(0, 1, (rng.integers(2, 6), 4))
        vectors = np.concatenate([c + rng.normal(0, spread * rng.uniform(0.3, 1), (rng.integers(5, 25), 4)) for c in centres] + [rng.normal(0, 1, (10, 4))])
        least = int(rng.integers(3, 7))
        label = discovery.clusters_of(vectors, least, "mass")
        got = {tuple(np.flatnonzero(label == c).tolist()) for c in set(label.tolist()) - {-1}}
        assert got == plainly(vectors, least)
        seen[len(got)] += 1
    assert len(seen) > 2


def test_the_selection_must_be_known_and_equal_vectors_are_a_cluster():
    same = np.repeat(np.eye(3), 20, axis=0)
    assert discovery.clusters_of(same, 15, "mass").tolist() == np.repeat(discovery.clusters_of(same, 15, "mass")[::20], 20).tolist()
    assert set(discovery.clusters_of(same, 15, "mass").tolist()) == {0, 1, 2}
    assert discovery.clusters_of(same[:4], 15, "mass").tolist() == [-1] * 4
    try:
        discovery.clusters_of(same, 15, "most")
    except ValueError:
        return
    raise AssertionError("an unknown selection was taken")


def pools(seed, sizes):
    rng = np.random.default_rng(seed)
    out = []
    for name, (dense, n_noise, width) in sizes.items():
        vectors = np.concatenate([c + rng.normal(0, spread, (n, width)) for c, (n, spread) in zip(rng.normal(0, 1, (len(dense), width)), dense, strict=True)] + [rng.normal(0, 1, (n_noise, width))])
        vectors = np.concatenate([vectors, vectors[:30]])  # equal vectors
        rng.shuffle(vectors)
        out += [(name, len(out) + i, v.tolist()) for i, v in enumerate(vectors)]
    return out


def partition(rows):
    """The clusters as sets of keys."""
    sets = collections.defaultdict(set)
    for p, k, c in rows:
        if c >= 0:
            sets[p, c].add(k)
    return {(p, frozenset(x)) for (p, _), x in sets.items()}


def test_blocks_give_the_clusters_of_whole_pools(spark, monkeypatch):
    rows = pools(8, {"2/hr": ([(500, 0.2), (300, 0.3), (60, 0.1)], 200, 6), "3/it": ([(700, 0.15), (40, 0.4)], 900, 8), "1/": ([(30, 0.1)], 5, 4)})
    df = spark.createDataFrame([*rows, ("2/hr", -1, None), ("2/hr", -2, [1.0]), (None, -3, rows[0][2])], SCHEMA)
    got = {}
    for by in ("mass", "cut"):
        whole = [tuple(r) for r in discovery.discover(df, "pool", by=by).collect()]
        with monkeypatch.context() as m:
            m.setattr(discovery, "POOL_ROWS", 100)
            for name, value in (("BLOCK_ROWS", 150), ("GROUP_BLOCKS", 3), ("GROUPS", 4), ("LEFT", 0.02)):
                m.setattr(discovery.forest, name, value)
            cut = [tuple(r) for r in discovery.discover(df, "pool", by=by).collect()]
        assert sorted(k for _, k, _ in cut) == sorted(k for _, k, _ in whole) and len(cut) == len(rows) + 3
        assert partition(cut) == partition(whole) and len(partition(whole)) >= 4
        assert all(c == -1 for _, k, c in cut if k < 0)
        got[by] = partition(whole)
    assert {tuple(r) for r in discovery.report(discovery.mass_clusters(df, "pool"), "pool").select("pool", "pool_size", "min_cluster_size", "clustered").where("pool IS NOT NULL").collect()} == {("2/hr", 1092, 15, True), ("3/it", 1670, 15, True), ("1/", 65, 15, True)}


def test_rows_beyond_what_is_clustered(spark, monkeypatch):
    monkeypatch.setattr(discovery, "POOL_ROWS", 50)
    monkeypatch.setattr(discovery, "WHOLE_ROWS", 400)
    rows = pools(9, {"a": ([(400, 0.05), (300, 0.05)], 0, 8)})
    got = [tuple(r) for r in discovery.discover(spark.createDataFrame(rows, SCHEMA), "pool", by="mass").collect()]
    vectors = {k: np.array(v) for _, k, v in rows}
    sets = [x for _, x in partition(got)]
    assert sorted(k for _, k, _ in got) == sorted(vectors) and len(sets) == 2 and sum(map(len, sets)) > 650
    centres = [np.mean([vectors[k] / np.linalg.norm(vectors[k]) for k in x], axis=0) for x in sets]
    for i, x in enumerate(sets):
        assert all(vectors[k] @ centres[i] > vectors[k] @ centres[1 - i] for k in x)


def test_edges_between_blocks_are_those_of_the_whole_tree():
    rng = np.random.default_rng(2)
    for size in ((40, 90), (1, 30), (5, 1)):
        v = rng.normal(0, 1, (sum(size), 5))
        v[-1] = v[0]
        unit = discovery.forest._unit(v)
        far = discovery.forest.squares(unit, unit)
        core = np.sqrt(np.partition(far, 3, axis=1)[:, 3])
        whole = discovery._spanning(unit, core)[2]
        n = size[0]
        own = [discovery._spanning(unit[s], core[s]) if len(core[s]) > 1 else (np.zeros(0, int),) * 2 + (np.zeros(0),) for s in (slice(n), slice(n, None))]
        own = [(a, b, discovery.forest.units(w)) for a, b, w in own]
        reach = discovery.forest.units(np.maximum(np.sqrt(far), np.maximum(core[:, None], core))[:n, n:])
        a, b, w = discovery.forest.crossing(reach, own)
        ends = [np.concatenate([own[0][0], own[1][0] + n, a]), np.concatenate([own[0][1], own[1][1] + n, b + n])]
        length = np.concatenate([own[0][2], own[1][2], w])
        tree = discovery.forest.joined(*ends, length)
        assert len(tree) == sum(size) - 1 and abs(length[tree].sum() / 1e9 - whole.sum()) < 1e-6


def test_near_rows_by_short_products_are_the_nearest():
    rng = np.random.default_rng(6)
    forest = discovery.forest
    for width, most in ((64, 50), (3, 5), (1, 2)):
        unit = forest._unit(np.concatenate([rng.normal(0, 1, (900, width)), np.repeat(rng.normal(0, 1, (20, width)), 3, axis=0), np.zeros((2, width))]))
        rng.shuffle(unit)
        near = np.zeros((200, 0))
        for k in range(0, len(unit), 30):
            b = unit[k : k + 30]
            near = forest.nearer_rows(near, unit[:200], b, forest.short(unit[:200]), forest.short(b), most)
        assert np.abs(np.sort(near, axis=1) - np.sort(forest.squares(unit[:200], unit), axis=1)[:, :most]).max() < 1e-12


def test_few_pairs_of_blocks_hold_the_tree_of_both():
    rng = np.random.default_rng(7)
    forest, looked = discovery.forest, collections.Counter()
    for size, spread, groups, width in ((900, 0, 1, 64), (900, 0.1, 3, 64), (400, 0.2, 6, 8), (1, 0, 1, 4), (3, 0, 1, 2)):
        centres = np.zeros((1, width)) if groups == 1 else rng.normal(0, 1, (groups, width))
        v = centres[rng.integers(0, groups, 2 * size)] + rng.normal(0, spread or 1, (2 * size, width))
        v[-1] = v[0]  # equal vectors, one in each block
        unit = forest._unit(v)
        far = forest.squares(unit, unit)
        core = np.sqrt(np.partition(far, min(9, size - 1), axis=1)[:, min(9, size - 1)])
        reach = forest.units(np.maximum(np.maximum(np.sqrt(far), core[:, None]), core))
        blocks, trees = [], []
        for s in (slice(size), slice(size, None)):
            one, other, w = discovery._spanning(unit[s], core[s])
            trees.append((one, other, forest.units(w)))
            blocks.append((unit[s], forest.short(unit[s]), core[s], forest.longest(size, *trees[-1])))
        inner = [np.concatenate([trees[0][k], trees[1][k] + size]) for k in (0, 1)]
        found = forest.between(*blocks)
        looked[found is None] += 1
        if found is None:  # too many pairs may be needed
            assert groups > 1
            continue
        a, b, w = found
        assert np.abs(reach[a, b + size] - w).max() <= 1 and len(a) < 16 * 2 * size
        one, other = np.concatenate([inner[0], a]), np.concatenate([inner[1], b + size])
        length = np.concatenate([trees[0][2], trees[1][2], w])
        tree = forest.joined(one, other, length)
        want = np.sort(forest.units(discovery._spanning(unit, core)[2]))
        assert len(tree) == 2 * size - 1 and np.abs(np.sort(length[tree]) - want).max() <= 1
    assert looked[False] >= 3 and looked[True] >= 1


def test_the_longest_edge_of_a_way():
    one, other, length = np.array([0, 1, 3, 2]), np.array([1, 2, 4, 3]), np.array([1.0, 2.0, 3.0, 9.0])
    assert discovery.forest.longest(5, one, other, length).tolist() in ([0, 1, 2, 9, 9], [1, 0, 2, 9, 9], [2, 2, 0, 9, 9])
    assert discovery.forest.longest(1, one[:0], other[:0], length[:0]).tolist() == [0]
