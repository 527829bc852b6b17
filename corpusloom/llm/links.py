"""Exact links within groups, and components of links, for the operators on similar lines and documents.

A group of any size is cut into blocks by a hash of its members; each pair of blocks is a cell, and cells
are what tasks work on. So no group meets in one task, no pair is emitted: a cell returns for each
member what it found (its links, and one edge to the least member it is linked with).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small, tidy, written


def cells(members: DataFrame, group: str, size: str, key: str, block: int) -> DataFrame:
    """Each member once for each cell that its block belongs to.

    ``cell`` identifies the cell, ``side`` is 0 in a block's own cell and else 1 for the lower and 2 for
    the higher block: there only pairs of different sides count. Groups of at most ``block`` have one cell.
    """
    n = F.greatest(F.ceil(F.col(size) / block), F.lit(1)).cast("int")
    rows = members.withColumn("_n", n).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    cell = F.xxhash64(group, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return rows.select("*", cell.alias("cell"), side.cast("int").alias("side")).drop("_n", "_own", "_other")


def by_cell(rows: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """Work on whole cells, many at a time: it gets rows sorted by cell, and where each cell begins."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the last cell seen, which may go on
        for part in parts:
            if not part.num_rows:
                continue
            cell = part.column("cell").to_numpy()
            last = int(np.searchsorted(cell, cell[-1], "left"))
            if last:
                yield from flush([*held, part.slice(0, last)])
                held = [part.slice(last)]
            else:
                if held and held[-1].column("cell")[0].as_py() != cell[0]:
                    yield from flush(held)
                    held = []
                held.append(part)
        if held:
            yield from flush(held)

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        cell = table.column("cell").to_numpy()
        begins = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
        yield from work(table, begins)

    dealt = rows.repartition(partitions, "cell") if partitions else rows.repartition("cell")
    return dealt.sortWithinPartitions("cell").mapInArrow(tidy(run), schema)


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that edges connect it with."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]  # roots, as labels are followed to their ends below
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def components(edges: DataFrame) -> DataFrame:
    """id and the least id of its component, from edges a, b; nodes without an edge aren't there.

    Large-star and small-star steps alternate until nothing changes; each step is a minimum by node, made
    before the shuffle and written, and a join back. The minima are broadcast where they are proven small; else
    both sides of the join are plain shuffles, so adaptive execution splits a node with very many edges. The
    edges never outnumber those given.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, seen = written(edges, "edges"), None
    while True:
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = small(written(sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least"))
        large = sym.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        tied = large.join(small(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(least.select("a", F.col("m").alias("b")).unionByName(tied).distinct(), "small-star")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == seen or not now["n"]:
            break
        seen = (now["n"], now["s"])
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))


#: Members of a block whose sets are compared as a whole.
SET_BLOCK = 256
#: Groups of so few members, and so many values in all their pairs, are compared many at a time.
FEW, VALUES = 16, 1 << 18
_RESULT = "id binary, links long, later boolean, other binary"


def _linked(sets: list[np.ndarray], side: np.ndarray, five: int, four: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose Jaccard similarity is at least four/five, of different sides where sides differ; all exactly."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    which = np.repeat(np.arange(m), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    which, token = which[shared], token[shared]
    _, token = np.unique(token, return_inverse=True)
    width = int(token.max()) + 1 if len(token) else 0
    both = np.zeros((m, m), np.float32)
    step = max(1, 4_000_000 // m)
    order = np.argsort(token, kind="stable")
    which, token = which[order], token[order]
    for low in range(0, width, step):
        a, b = np.searchsorted(token, [low, low + step])
        part = np.zeros((m, min(step, width - low)), np.float32)
        part[which[a:b], token[a:b] - low] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    ok = five * both >= four * (sizes[:, None] + sizes[None, :] - both)
    ok &= (side[:, None] == 0) | (side[:, None] != side[None, :])
    return np.nonzero(np.triu(ok, 1))


def _few_linked(sets: list[np.ndarray], side: np.ndarray, begins: np.ndarray, five: int, four: int) -> tuple[np.ndarray, np.ndarray]:
    """What _linked finds, for many small groups together: group k is from begins[k] to begins[k + 1]."""
    sizes = np.array([len(s) for s in sets], np.int64)
    after = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(sets)) - 1  # members of the group that come after each
    i = np.repeat(np.arange(len(sets)), after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    ok = ((side[i] == 0) | (side[i] != side[j])) & (five * np.minimum(sizes[i], sizes[j]) >= four * np.maximum(sizes[i], sizes[j]))
    i, j = i[ok], j[ok]
    different, value = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    member, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    n = sizes[member]
    at = np.repeat(first[member] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    key = np.sort(np.repeat(pair, n) * len(different) + value[at])
    both = np.bincount(key[1:][key[1:] == key[:-1]] // max(1, len(different)), minlength=len(i))
    ok = five * both >= four * (sizes[i] + sizes[j] - both)
    return i[ok], j[ok]


def _key(place: dict) -> tuple:
    """A struct as something to sort by; nulls come first, as they do in Spark."""
    return tuple((x is not None, x) for x in place.values())


def verified(members: DataFrame, four: int = 4, five: int = 5, block: int = SET_BLOCK) -> DataFrame:
    """Exact links of members within their groups.

    members: root (the group), n_group, id, ``set`` (its distinct 64-bit values as bytes), copies and ``ord``
    (a struct that orders members). Returns id, links (the copies of those linked), later (whether one
    linked comes before), other (the least linked id or its own), a row for each cell.
    """

    def work(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, raw, order = table.column("id").to_pylist(), table.column("set").to_pylist(), [_key(x) for x in table.column("ord").to_pylist()]
        side, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
        out: tuple[list, list, list, list] = ([], [], [], [])

        def found(at: list[int], i: np.ndarray, j: np.ndarray) -> None:
            if not len(i):
                return
            rank = np.empty(len(at), np.int64)
            rank[sorted(range(len(at)), key=lambda k: order[at[k]])] = np.arange(len(at))
            links, later = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            own = copies[at]
            np.add.at(links, i, own[j])
            np.add.at(links, j, own[i])
            later[i[rank[j] < rank[i]]] = True
            later[j[rank[i] < rank[j]]] = True
            label = least_labels(len(at), i, j)
            for k in np.flatnonzero(links).tolist():
                for column, x in zip(out, (ids[at[k]], int(links[k]), bool(later[k]), ids[at[label[k]]]), strict=True):
                    column.append(x)

        few: list[int] = []  # members of small groups
        ends, values = [0], 0
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            at = list({ids[i]: i for i in range(b - 1, a - 1, -1)}.values())  # a member comes once
            if len(at) < 2:
                continue
            size = (len(at) - 1) * sum(len(raw[k]) for k in at) // 8 if len(at) <= FEW else VALUES
            if size >= VALUES:
                found(at, *_linked([np.frombuffer(raw[k], np.uint64) for k in at], side[at], five, four))
                continue
            few += at
            ends.append(len(few))
            values += size
            if values >= VALUES:
                found(few, *_few_linked([np.frombuffer(raw[k], np.uint64) for k in few], side[few], np.array(ends), five, four))
                few, ends, values = [], [0], 0
        if few:
            found(few, *_few_linked([np.frombuffer(raw[k], np.uint64) for k in few], side[few], np.array(ends), five, four))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["id", "links", "later", "other"])

    return by_cell(cells(members, "root", "n_group", "id", block).drop("root", "n_group"), work, _RESULT)


def grouped(edges: DataFrame) -> DataFrame:
    """id, root and n_group of each node of the edges, written."""
    roots = written(components(edges), "components")
    sizes = written(roots.groupBy("root").agg(F.count("*").alias("n_group")), "sizes")
    return written(roots.join(small(sizes), "root"), "groups")
