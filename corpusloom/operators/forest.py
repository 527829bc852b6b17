"""The least spanning tree of a pool's mutual reachability distances, and the clusters that it has.

A pool's rows are dealt into blocks of bounded size. Core distances come from blocks that meet all blocks one by one. The
tree of a block, and what the least tree of two blocks has between them, hold all edges of the pool's tree (an edge that
isn't in the least tree of some rows isn't in that of more rows). Borůvka's rounds choose among these: each round is a
minimum by component and a join with the components' new names, on written tables, until the edges left are
about as many as the rows. The tree itself, three numbers a row, is cut into clusters in a task.

Pairs of rows are looked at in short floats with a margin; only those that may matter get exact distances. For core
distances these are pairs nearer than the farthest neighbour so far. Between two blocks they are pairs nearer than the
longest edge of the way that their trees and one edge between them have: others close a ring in which nothing is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Rows of a block, and blocks that meet the others in one task, at most. Groups of blocks that there should be.
BLOCK_ROWS, GROUP_BLOCKS, GROUPS = 2048, 8, 16
#: Groups that each block of a pool is sent to, at most; groups get larger for that, up to so many bytes of vectors.
COPIES, HELD = 64, 64 << 20
#: Edges are handed over for the last choice when they are at most so many times the rows, or so many in all.
LEFT, HANDED = 2, 1 << 20
#: Squared distances below NONE are none, so that equal vectors are; lengths are counted in whole units of 1 / UNITS.
NONE, UNITS = 1e-12, 1e9
#: Rows that are compared with a block at a time; pairs a row that are looked at one by one, on average, and components of them at a time.
TILE, PAIRS, VALUES = 128, 16, 1 << 21


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of unit length."""
    out = a @ b.T
    out *= -2
    out += 2
    out[out < NONE] = 0
    return out


def short(unit: np.ndarray) -> np.ndarray:
    """Vectors as short floats, whose products are right to within margin()."""
    return unit.astype(np.float32)


def margin(width: int) -> float:
    """What a product of two short vectors of unit length is off, at most: an error a component, and some."""
    return (width + 8) * 1.2e-7


def squares_of(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows r of a from rows c of b."""
    out, step = np.empty(len(r)), max(1, VALUES // max(1, a.shape[1]))
    for k in range(0, len(r), step):
        out[k : k + step] = np.einsum("ij,ij->i", a[r[k : k + step]], b[c[k : k + step]])
    out *= -2
    out += 2
    out[out < NONE] = 0
    return out


def beyond(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """Row and column of the products of short vectors that are above their row's bound, or their column's; None if there are more than ``most``."""
    out, n = [(np.zeros(0, np.int64),) * 2], 0
    for k in range(0, len(a), TILE):
        x = a[k : k + TILE] @ b.T
        found = x > rows[k : k + TILE, None]
        if columns is not None:
            found |= x > columns
        at = np.flatnonzero(found)
        n += len(at)
        if most is not None and n > most:
            return None
        out.append((at // len(b) + k, at % len(b)))
    r, c = (np.concatenate(x) for x in zip(*out, strict=True))
    return r, c


def nearer_rows(near: np.ndarray, a: np.ndarray, b: np.ndarray, a_short: np.ndarray, b_short: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` least squared distances of each row of a, which are near so far, when b's rows have come."""
    if near.shape[1] < most:
        return nearer(near, squares(a, b), most)
    bound = near.max(axis=1)
    r, c = beyond(a_short, b_short, (1 - bound / 2 - margin(a.shape[1])).astype(np.float32))
    far = squares_of(a, b, r, c)
    less = far < bound[r]
    r, far = r[less], far[less]
    counts = np.bincount(r, minlength=len(a))
    rows = np.flatnonzero(counts)
    if not len(rows):
        return near
    some = np.full((len(rows), counts.max()), np.inf)
    some[np.searchsorted(rows, r), np.arange(len(r)) - (np.cumsum(counts) - counts)[r]] = far
    near[rows] = np.partition(np.concatenate([near[rows], some], axis=1), most - 1, axis=1)[:, :most]
    return near


def nearer(near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` least values of each row of both; near has at most so many."""
    if near.shape[1] == most:  # few of many are less than the greatest so far
        r, c = np.nonzero(far < near.max(axis=1)[:, None])
        counts = np.bincount(r, minlength=len(far))
        some = np.full((len(far), counts.max(initial=0)), np.inf)
        some[r, np.arange(len(r)) - (np.cumsum(counts) - counts)[r]] = far[r, c]
        far = some
    both = np.concatenate([near, far], axis=1)
    return np.partition(both, most - 1, axis=1)[:, :most] if both.shape[1] > most else both


def units(length: np.ndarray) -> np.ndarray:
    """Lengths as whole numbers, so that sums in another order don't tell equal ones apart."""
    length = length * UNITS
    return np.rint(length, out=length)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def joined(one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions, by length, of the edges between points from 0 on that a least spanning forest has."""
    above = list(range(int(max(one.max(initial=-1), other.max(initial=-1))) + 1))

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    order = np.lexsort((np.maximum(one, other), np.minimum(one, other), length))
    for k, a, b in zip(order.tolist(), one[order].tolist(), other[order].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            above[a] = b
            out.append(k)
    return np.array(out, np.int64)


def _groups(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, an order of their places, and where each begins in it."""
    order = np.argsort(names, kind="stable")
    own = names[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], order, first


def crossing(far: np.ndarray, inner: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and length of the edges between two blocks in the least tree of both.

    far: distances of rows and columns, in units. inner: the edges (one, other, length) of each block's own tree.
    In each round every component takes its least edge; then rows, and columns, of a component become one by their least
    distances, so later rounds look at few.
    """
    n, m = far.shape
    label = np.arange(n + m)  # of rows, then columns
    ends = [np.concatenate([inner[0][k], inner[1][k] + n]) for k in (0, 1)]
    length = np.concatenate([inner[0][2], inner[1][2]])
    least, rows, columns = far, np.arange(n), np.arange(m) + n  # distances of components, and their names
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    while True:
        c, r = least.argmin(axis=1), least.argmin(axis=0)
        i, j = np.concatenate([np.arange(len(rows)), r]), np.concatenate([c, np.arange(len(columns))])
        u, v = np.concatenate([rows[i], label[ends[0]]]), np.concatenate([columns[j], label[ends[1]]])
        w = np.concatenate([least[i, j], length])
        open_ = np.flatnonzero((u != v) & np.isfinite(w))
        if not len(open_):
            break
        owner, edge = np.concatenate([u[open_], v[open_]]), np.tile(open_, 2)
        order = np.lexsort((w[edge], owner))
        first = np.unique(edge[order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]])
        first = first[joined(u[first], v[first], w[first])]  # edges of one length may close a ring
        across = first[first < len(i)]
        if least is far:
            out.append((i[across], j[across], w[across]))
        elif len(across):
            (own, by_row, begin), (other, by_column, start) = _groups(label[:n]), _groups(label[n:])
            begin, start, where = np.append(begin, n), np.append(start, m), []
            for x, y, z in zip(np.searchsorted(own, u[across]).tolist(), np.searchsorted(other, v[across]).tolist(), w[across].tolist(), strict=True):
                x, y = by_row[begin[x] : begin[x + 1]], by_column[start[y] : start[y + 1]]
                at = int((far[np.ix_(x, y)] == z).argmax())
                where.append((x[at // len(y)], y[at % len(y)]))
            a, b = np.array(where, np.int64).T
            out.append((a, b, w[across]))
        u, v, new = u[first], v[first], np.arange(n + m)
        while True:  # the least name of a component goes to all of it
            low = np.minimum(new[u], new[v])
            np.minimum.at(new, new[u], low)
            np.minimum.at(new, new[v], low)
            while (new[new] != new).any():
                new = new[new]
            if (new[u] == new[v]).all():
                break
        label = new[label]
        (rows, by_row, a), (columns, by_column, b) = _groups(new[rows]), _groups(new[columns])
        least = np.minimum.reduceat(np.minimum.reduceat(least[by_row], a, axis=0)[:, by_column], b, axis=1)
        least[rows[:, None] == columns[None, :]] = np.inf
        stay = label[ends[0]] != label[ends[1]]
        ends, length = [x[stay] for x in ends], length[stay]
    a, b, w = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, w


def longest(n: int, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The longest edge on each point's way, in a tree of n points with edges by length, to a point among the half that is tied first."""
    name, sizes, beside, root = list(range(n)), [1] * n, [[] for _ in range(n)], 0

    def named(x: int) -> int:
        while name[x] != x:
            name[x] = name[name[x]]
            x = name[x]
        return x

    most = 1
    for a, b, w in zip(one.tolist(), other.tolist(), length.tolist(), strict=True):
        beside[a].append((b, w))
        beside[b].append((a, w))
        x, y = named(a), named(b)
        name[x] = y
        sizes[y] += sizes[x]
        if sizes[y] > most:
            if 2 * most <= n:
                root = a
            most = sizes[y]
    out = np.full(n, np.inf)
    out[root], left = 0, [root]
    while left:
        a = left.pop()
        for b, w in beside[a]:
            if out[b] == np.inf:
                out[b] = max(out[a], w)
                left.append(b)
    return out


def between(mine: tuple[np.ndarray, ...], theirs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Row, column and length of edges between two blocks that, with the blocks' own trees, hold a least tree of both; None if too many may be needed.

    Of a block: its vectors, these as short floats, the core distances and what longest() gives. One edge ties the trees;
    a pair that isn't nearer than the longest edge between its ends by this edge isn't needed.
    """
    (a, a_short, core, way), (b, b_short, cores, ways) = mine, theirs

    def lengths(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return units(np.maximum(np.maximum(np.sqrt(squares_of(a, b, r, c)), core[r]), cores[c]))

    some = np.argsort(way, kind="stable")[:64]
    far = units(np.maximum(np.maximum(np.sqrt(squares(a[some], b)), core[some][:, None]), cores))
    i, j = np.unravel_index(np.argmin(np.maximum(np.maximum(far, way[some][:, None]), ways)), far.shape)
    i, j = np.array([some[i]]), np.array([j])
    tie = lengths(i, j)
    least = max(float(tie[0]), float(way[i[0]]), float(ways[j[0]]))
    bound = lambda x: (1 - (np.maximum(x, least) / UNITS) ** 2 / 2 - margin(a.shape[1])).astype(np.float32)
    found = beyond(a_short, b_short, bound(way), bound(ways), PAIRS * (len(a) + len(b)))
    if found is None:
        return None
    r, c = found
    w = lengths(r, c)
    need = w < np.maximum(np.maximum(way[r], ways[c]), least)
    return np.concatenate([r[need], i]), np.concatenate([c[need], j]), np.concatenate([w[need], tie])


SCHEMAS = {
    "blocks": pa.schema([("pid", pa.int64()), ("block", pa.int32()), ("nums", pa.binary()), ("vecs", pa.binary()), ("width", pa.int32())]),
    "trees": pa.schema([("pid", pa.int64()), ("block", pa.int32()), ("core", pa.binary()), ("one", pa.binary()), ("other", pa.binary()), ("length", pa.binary()), ("way", pa.binary())]),
    "edges": pa.schema([("pid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]),
}
BLOCKS = "pid long, block int, nums binary, vecs binary, width int"
TREES = "pid long, block int, core binary, one binary, other binary, length binary, way binary"
EDGES = "pid long, a long, b long, w double"


def _blocks(points: DataFrame) -> DataFrame:
    """Blocks of each pool's rows, with the pool's number of blocks and of rows. points: pid, num, vector."""
    sizes = written(points.groupBy("pid").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_blocks")), "pool-sizes")
    dealt = points.join(F.broadcast(sizes), "pid").select("pid", F.pmod(F.xxhash64("num"), "n_blocks").cast("int").alias("block"), "num", "vector")
    dealt = dealt.repartition("pid", "block").sortWithinPartitions("pid", "block", "num")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                nums, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_pylist([{"pid": place[0], "block": place[1], "nums": nums.tobytes(), "vecs": _unit(vectors).tobytes(), "width": vectors.shape[1]}], schema=SCHEMAS["blocks"])

        for part in parts:
            pid, block = part.column(0).to_numpy(), part.column(1).to_numpy()
            ends = np.flatnonzero((pid[1:] != pid[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), part.num_rows], strict=True):
                if a < b:
                    if (pid[a], block[a]) != place:
                        yield from done()
                        place, held = (int(pid[a]), int(block[a])), []
                    some = part.slice(a, b - a)
                    held.append((some.column(2).to_numpy(), some.column(3).flatten().to_numpy().reshape(b - a, -1)))
        yield from done()

    return written(dealt.mapInArrow(run, BLOCKS), "blocks").join(F.broadcast(sizes), "pid")  # pools are few


def _met(blocks: DataFrame) -> DataFrame:
    """Groups of blocks, each followed by all blocks of its pool: side 0, then side 1."""
    few = F.least(F.lit(GROUP_BLOCKS), F.ceil(F.col("n_blocks") / GROUPS))
    many = F.least(F.ceil(F.col("n_blocks") / COPIES), F.floor(F.lit(HELD) / (8 * BLOCK_ROWS * F.col("width"))))
    rows = blocks.withColumn("_g", F.greatest(F.lit(1), few, many).cast("int"))
    own = rows.withColumn("group", F.floor(F.col("block") / F.col("_g")).cast("int")).withColumn("side", F.lit(0))
    last = F.floor((F.col("n_blocks") - 1) / F.col("_g")).cast("int")
    each = rows.withColumn("group", F.explode(F.sequence(F.lit(0), last))).withColumn("side", F.lit(1))
    both = own.unionByName(each).drop("_g")
    return both.repartition("pid", "group").sortWithinPartitions("pid", "group", "side", "block")


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in parts:
        for i in range(part.num_rows):
            yield part.slice(i, 1).to_pylist()[0]


def _vectors(row: dict) -> np.ndarray:
    return np.frombuffer(row["vecs"], np.float64).reshape(len(row["nums"]) // 8, row["width"])


def _tree(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["one"], np.int64), np.frombuffer(row["other"], np.int64), np.frombuffer(row["length"], np.float64)


def _with_trees(blocks: DataFrame, least_of: Callable[[int], int], spanning: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """The blocks with the core distance of each row, and each block's own tree."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own, near = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            for row, found in zip(own, near, strict=True):
                at = min(least_of(row["n"]), row["n"]) - 1
                core = np.sqrt(np.partition(found, at, axis=1)[:, at])
                one, other, length = spanning(_vectors(row), core) if len(core) > 1 else [np.zeros(0)] * 3
                made = {"core": core, "one": np.asarray(one, np.int64), "other": np.asarray(other, np.int64), "length": units(length)}
                made["way"] = longest(len(core), made["one"], made["other"], made["length"])
                yield pa.RecordBatch.from_pylist([{"pid": row["pid"], "block": row["block"]} | {k: v.tobytes() for k, v in made.items()}], schema=SCHEMAS["trees"])

        for row in _rows(parts):
            if (row["pid"], row["group"]) != place:
                yield from done()
                place, own, near = (row["pid"], row["group"]), [], []
            if row["side"] == 0:
                own.append(row | {"short": short(_vectors(row))})
                near.append(np.zeros((len(row["nums"]) // 8, 0)))
                continue
            others, most = _vectors(row), least_of(row["n"])
            others_short = short(others)
            for k, mine in enumerate(own):
                near[k] = nearer_rows(near[k], _vectors(mine), others, mine["short"], others_short, most)
        yield from done()

    return written(blocks.join(written(_met(blocks).mapInArrow(run, TREES), "trees"), ["pid", "block"]), "blocks-and-trees")


def _edges(blocks: DataFrame) -> DataFrame:
    """The edges of the blocks' own trees, and those between each two blocks."""

    def batch(row: dict, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"pid": np.full(len(a), row["pid"]), "a": np.minimum(a, b), "b": np.maximum(a, b), "w": w}, schema=SCHEMAS["edges"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own = None, []
        for row in _rows(parts):
            if (row["pid"], row["group"]) != place:
                place, own = (row["pid"], row["group"]), []
            nums = np.frombuffer(row["nums"], np.int64)
            if row["side"] == 0:
                own.append(row | {"short": short(_vectors(row))})
                one, other, length = _tree(row)
                yield batch(row, nums[one], nums[other], length)
                continue
            cores = np.frombuffer(row["core"], np.float64)
            theirs = (_vectors(row), short(_vectors(row)), cores, np.frombuffer(row["way"], np.float64))
            for mine in own:
                if mine["block"] < row["block"]:
                    core = np.frombuffer(mine["core"], np.float64)
                    found = between((_vectors(mine), mine["short"], core, np.frombuffer(mine["way"], np.float64)), theirs)
                    if found:
                        yield batch(row, np.frombuffer(mine["nums"], np.int64)[found[0]], nums[found[1]], found[2])
                        continue
                    far = squares(_vectors(mine), _vectors(row))
                    far = np.sqrt(far, out=far)
                    far = np.maximum(np.maximum(far, core[:, None], out=far), cores[None, :], out=far)
                    far = units(far)
                    a, b, w = crossing(far, [_tree(mine), _tree(row)])
                    yield batch(row, np.frombuffer(mine["nums"], np.int64)[a], nums[b], w)

    return written(_met(blocks).mapInArrow(run, EDGES), "edges")


def _renamed(best: DataFrame) -> DataFrame:
    """c and root: what a component is called after it has joined the one at the other end (o) of its edge."""
    ends = best.select(F.col("c").alias("o"), F.col("o").alias("_back"))
    at = best.join(ends, "o").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("root"))
    at = written(at, "above")
    while True:
        up = at.select(F.col("c").alias("root"), F.col("root").alias("_next"))
        at = written(at.join(up, "root").select("c", F.col("_next").alias("root"), (F.col("root") != F.col("_next")).alias("_moved")), "above")
        if not at.where("_moved").limit(1).count():
            return at.select("c", "root")


def forest(edges: DataFrame, n_points: int) -> DataFrame:
    """pid, a, b and w (in units) of edges that hold the least spanning forest, at most some LEFT times as many as points, or HANDED.

    Borůvka's rounds: every component takes the least of its edges, by length and then ends; components that it ties
    become one; of parallel edges the least stays.
    """
    kept = edges.limit(0)
    now = edges.select("pid", F.col("a").alias("ca"), F.col("b").alias("cb"), F.struct("w", "a", "b").alias("e"))
    n = now.count()
    while n > max(LEFT * n_points, HANDED):
        both = now.select("pid", F.col("ca").alias("c"), F.col("cb").alias("o"), "e").unionByName(now.select("pid", F.col("cb").alias("c"), F.col("ca").alias("o"), "e"))
        best = written(both.groupBy("c").agg(F.min(F.struct("e", "o", "pid")).alias("m")).select("c", "m.o", "m.pid", "m.e"), "least-edges")
        names = _renamed(best)
        # an edge that both ends took is there once
        kept = kept.unionByName(best.select("pid", "e.a", "e.b", "e.w").distinct())
        now = now.join(names.select(F.col("c").alias("ca"), F.col("root").alias("_a")), "ca").join(names.select(F.col("c").alias("cb"), F.col("root").alias("_b")), "cb")
        now = now.where("_a <> _b").select("pid", F.least("_a", "_b").alias("ca"), F.greatest("_a", "_b").alias("cb"), "e")
        now = written(now.groupBy("ca", "cb").agg(F.min(F.struct("e", "pid")).alias("m")).select("m.pid", "ca", "cb", "m.e"), "edges-left")
        n = now.count()
    return kept.unionByName(now.select("pid", "e.a", "e.b", "e.w"))


def clusters(points: DataFrame, least_of: Callable[[int], int], spanning: Callable, cut: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """pid, num and cluster (from 0, -1: none) of each row of pools of any size. points: pid, num (unique), vector (one size a pool).

    least_of: a pool's rows to the members that a cluster needs. spanning: the tree of a block. cut: clusters of a tree.
    """
    points = written(points, "points")
    blocks = _with_trees(_blocks(points), least_of, spanning)
    edges = forest(_edges(blocks), points.count())

    def run(part: pa.Table) -> pa.Table:
        a, b, w = (part.column(c).to_numpy() for c in ("a", "b", "w"))
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        one, other = ends[: len(a)], ends[len(a) :]
        tree = joined(one, other, w)
        label = cut(one[tree], other[tree], w[tree] / UNITS, least_of(len(names)))
        return pa.Table.from_pydict({"pid": np.full(len(names), part.column("pid")[0].as_py()), "num": names, "cluster": label.astype(np.int32)})

    return written(edges.groupBy("pid").applyInArrow(run, "pid long, num long, cluster int"), "clusters")
