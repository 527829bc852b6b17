"""Clusters of rows that no category took, by density, a pool at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import forest

#: Clusters of a pool that are kept.
KEPT = 8
#: Without effect: bounds above which pools were once clustered otherwise and sampled. The names stay for callers that set them.
POOL_ROWS, WHOLE_ROWS = 20_000, 1_000_000
#: Distances that are held at a time.
BLOCK = 1 << 20


def least_size(n: int) -> int:
    """Members that a cluster among n clustered rows needs."""
    return max(15, min(int(0.003 * n), 50))


def _spanning(unit: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and lengths, by length, of a least spanning tree of mutual reachability distances.

    It grows from point 0; points that it has leave the arrays, so the products get shorter.
    """
    n = len(unit)
    rest, near, source, rows, reach = np.arange(n), np.full(n, np.inf), np.zeros(n, np.int64), unit.copy(), core.copy()
    length, one, other, at = np.zeros(n - 1), np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), 0
    for k in range(n - 1):
        point, last = rest[at], n - 1 - k
        for column in (rest, near, source, rows, reach):
            column[at] = column[last]
        far = np.maximum(np.sqrt(forest.squares(rows[:last], unit[point])), np.maximum(reach[:last], core[point]))
        better = far < near[:last]
        near[:last][better], source[:last][better] = far[better], point
        at = int(near[:last].argmin())
        length[k], one[k], other[k] = near[at], source[at], rest[at]
    order = np.argsort(length, kind="stable")
    return one[order], other[order], length[order]


class _Forest:
    """Which tree each of n points is in, while edges tie them."""

    def __init__(self, n: int):
        self.above = list(range(n))

    def root(self, x: int) -> int:
        above = self.above
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x


def _by_cut(one: np.ndarray, other: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    n, most = len(one) + 1, 0
    best = np.full(n, -1)
    for q in np.linspace(0.95, 0.3, 14):
        forest = _Forest(n)
        for a, b in zip(*(x[: np.searchsorted(length, length[int(q * (n - 2))], "right")].tolist() for x in (one, other)), strict=True):
            forest.above[forest.root(a)] = forest.root(b)
        _, of, sizes = np.unique([forest.root(i) for i in range(n)], return_inverse=True, return_counts=True)
        big = sizes >= least
        if big.sum() > most:
            most, best = big.sum(), np.where(big, np.cumsum(big) - 1, -1)[of]
    return best


def _by_mass(one: np.ndarray, other: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    n = len(one) + 1
    # merge k is node n + k; edges of equal length that meet are one merge of several parts. Points are nodes 0 to n - 1
    forest, node, sizes, parts, density, a = _Forest(n), list(range(n)), [1] * n, [], [], 0
    length = np.round(length, 9)
    for b in np.flatnonzero(np.append(length[1:] != length[:-1], True)) + 1:
        met: dict[int, list[int]] = {}
        for x, y in zip(one[a:b].tolist(), other[a:b].tolist(), strict=True):
            x, y = forest.root(x), forest.root(y)
            few, many = sorted((met.pop(x, [node[x]]), met.pop(y, [node[y]])), key=len)
            many += few
            forest.above[x], met[y] = y, many
        for root, of in met.items():
            node[root] = n + len(parts)
            parts.append(of)
            sizes.append(sum(sizes[x] for x in of))
            density.append(float(1 / max(length[a], 1e-6)))
        a = b
    cluster = np.zeros(n + len(parts), np.int64)  # the last one that each node was part of
    above, birth, mass = [-1], [0.0], [0.0]
    for k in range(len(parts) - 1, -1, -1):  # the last merge is the whole
        me = int(cluster[n + k])
        n_big = sum(sizes[x] >= least for x in parts[k])
        for x in parts[k]:
            if sizes[n + k] >= least and (n_big > 1 or sizes[x] < least):  # these points leave
                mass[me] += sizes[x] * (density[k] - birth[me])
            cluster[x] = me
            if n_big > 1 and sizes[x] >= least:
                cluster[x] = len(above)
                above.append(me)
                birth.append(density[k])
                mass.append(0.0)
    chosen, inner = np.zeros(len(above), bool), np.zeros(len(above))
    for c in range(len(above) - 1, 0, -1):
        chosen[c] = mass[c] >= inner[c]
        inner[above[c]] += max(mass[c], inner[c])
    label, found = np.full(len(above), -1), 0
    for c in range(1, len(above)):
        label[c] = label[above[c]]
        if label[c] < 0 and chosen[c]:
            label[c], found = found, found + 1
    return label[cluster[:n]]


def clusters_of(vectors: np.ndarray, least: int, by: str = "cut") -> np.ndarray:
    """Labels from 0, -1 for noise, of clusters of at least ``least`` (two or more) members by density.

    Distances are Euclidean between vectors of unit length, but at least the core distances of both points, which are
    those of their ``least``-th neighbours, themselves among them. Clusters come from the tree of single linkage:

    - cut: it is cut where that gives most clusters of the least size.
    - mass: where it splits into two parts of the least size, these are clusters of their own; smaller parts leave
      theirs. A cluster stays whole if its members' stay in it, in inverse distance, isn't below that of the clusters
      within; the whole set is none. Members that left it early are members too. Distances below 1e-6 count as that.
    """
    if by not in ("cut", "mass"):
        raise ValueError("clusters are found by cut or by mass")
    n = len(vectors)
    if n < max(5, least):
        return np.full(n, -1)
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    at, step = min(least - 1, n - 1), max(1, BLOCK // n)
    core = np.zeros(n)
    for k in range(0, n, step):  # filled in place: a column kept as it is would keep its block
        core[k : k + step] = np.partition(forest.squares(unit[k : k + step], unit), at, axis=1)[:, at]
    return (_by_cut if by == "cut" else _by_mass)(*_spanning(unit, np.sqrt(core)), least)


def discover(rows: DataFrame, pool: str, key: str = "vec_id", vector: str = "embedding", by: str = "cut") -> DataFrame:
    """pool, key, cluster (-1: none): the KEPT largest clusters of each pool, from 0 by size, ties by their least key. ``by``: see clusters_of.

    Every pool is clustered whole and in one way, whatever its size: by blocks (see forest), which give the clusters of
    clusters_of. Noise, members of clusters not kept, and rows without a pool or vector, with a component that is null
    or not finite, or with a vector of another size than most of their pool, have none.
    """
    if by not in ("cut", "mass"):
        raise ValueError("clusters are found by cut or by mass")
    rows = written(rows.select(pool, key, F.col(vector).cast("array<double>").alias("_vector"), F.monotonically_increasing_id().alias("_num")), "pools")
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col(pool).isNotNull() & (F.size("_vector") > 0) & finite).withColumn("_size", F.size("_vector"))
    sizes = usable.groupBy(pool, "_size").agg(F.count("*").alias("_n"))
    sizes = sizes.groupBy(pool).agg(F.max(F.struct("_n", (-F.col("_size")).alias("_less"))).alias("m")).select(pool, (-F.col("m._less")).alias("_size"))
    counts = written(sizes.withColumn("pid", F.monotonically_increasing_id()), "pool-sizes")  # pools are few: those of a tree's nodes
    points = usable.join(F.broadcast(counts), [pool, "_size"]).select("pid", F.col("_num").alias("num"), F.col("_vector").alias("vector"))
    found = forest.clusters(points, least_size, _spanning, _by_cut if by == "cut" else _by_mass)
    found = written(rows.select(pool, key, "_num").join(found.where("cluster >= 0").select(F.col("num").alias("_num"), "cluster"), "_num", "left"), "found")
    order = Window.partitionBy(pool).orderBy(F.desc("_n"), "_first", "_least")
    kept = found.where("cluster >= 0").groupBy(pool, "cluster").agg(F.count("*").alias("_n"), F.min(key).alias("_first"), F.min("_num").alias("_least"))
    kept = kept.withColumn("_k", F.row_number().over(order) - 1).where(F.col("_k") < KEPT).select(pool, "cluster", "_k")
    return found.join(F.broadcast(kept), [pool, "cluster"], "left").select(pool, key, F.coalesce("_k", F.lit(-1)).alias("cluster"))


def mass_clusters(rows: DataFrame, pool: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Clusters of most mass, as density clustering defines them; ``discover`` by its default cuts the tree once."""
    return discover(rows, pool, key, vector, "mass")


def report(found: DataFrame, pool: str) -> DataFrame:
    """For each pool its rows, the members that a cluster needs, whether it could be clustered, clusters kept, and rows without one."""
    n = F.count("*").alias("pool_size")
    rows = found.groupBy(pool).agg(n, F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.count_if(F.col("cluster") < 0).alias("n_noise"))
    least = F.greatest(F.lit(15), F.least(F.floor(0.003 * F.col("pool_size")), F.lit(50))).cast("int")
    return rows.select(pool, "pool_size", least.alias("min_cluster_size"), (F.col("pool_size") >= least).alias("clustered"), "n_clusters", "n_noise")
