"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt into LISTS parts. A part of the rows is a list: it knows what its components add to a
score, no more. Shards of rows and blocks of queries meet in cells, a part at a time:

1. Each cell gives the K rows to which its part adds most, for each query. Their scores are resolved, and the K-th best
   of a query is a safe cutoff, as K rows reach it.
2. The cutoff goes to all cells with the queries. A row whose every part adds less than a LISTS-th of it can't reach
   it, so each cell collects the rows to which its part adds that much. Where that is a good part of a shard, it only says so.
3. What the lists say of a row is put together. With what the silent lists can add at most, rows that stay below the
   cutoff go; the others' missing parts are worked out, and the K best of a cell are ranked with those of the others.

Equal vectors are one row until the end, with as many ids as can be in a result, so a frequent vector is no hot spot.

Vectors that are null or hold null or non-finite components take no part. Vectors of different sizes have no score with
each other; empty ones have 0. Rows that repeat vec_id and vector are one row; rows that repeat a vec_id with other
vectors are rows of their own, as queries too. A null vec_id is no query, and found after others of its score. Ties go
to the smaller vec_id. Other columns aren't read. An empty table gives no row. Components beyond 2^62 count as that, scores
beyond 64 bits as the nearest that fits. Equal vectors are told by SHA-1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import tidy, written

#: Rows returned, the divisor of query ids, the scale of components, and lists.
TOP, EVERY, SCALE, LISTS = 20, 20, 64, 2
#: Rows and components of a shard and rows of a block, at most; shards and blocks that there should be; blocks of a stripe.
SHARD_ROWS, SHARD_VALUES, BLOCK_ROWS, SHARDS, BLOCKS, STRIPE = 65_536, 1 << 22, 32_768, 16, 4, 16
#: Rows of a shard and of a block, at least, and pairs that are worked on at a time.
LEAST_ROWS, LEAST_QUERIES, PAIRS = 2048, 1024, 1 << 22
#: A list says "all" for a query if it would name more than this part of a shard.
MANY = 32

#: Components that count as larger are cut to LIMIT; vectors with one of WIDE have shards and blocks of their own.
LIMIT, WIDE = 1 << 62, 1 << 20


def bounded(values: np.ndarray) -> int:
    """The greatest absolute value."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact integers in the narrowest float type that holds all sums, or else in long."""
    most = bounded(a) * bounded(b) * max(1, a.shape[1])
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return a.astype(kind) @ b.astype(kind).T
    sums = a.astype(object) @ b.astype(object).T
    return np.clip(sums, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def packed(values: np.ndarray) -> tuple[bytes, str]:
    """Values in the narrowest type that holds them, and its name."""
    most = bounded(values)
    kind = next(k for k, top in (("int8", 1 << 7), ("int16", 1 << 15), ("int32", 1 << 31), ("int64", 1 << 63)) if most < top)
    return np.ascontiguousarray(values, kind).tobytes(), kind


def best_of(owner: np.ndarray, score: np.ndarray, lost: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each owner, ties to the smaller first id."""
    order = np.lexsort((first, lost, ~score, owner))
    sorted_ = owner[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]


LIST = "dim int, part int, shard int, nums binary, firsts binary, lost binary, vals binary, kind string"
ASK = "dim int, part int, block int, nums binary, vals binary, kind string"
ENTRY = "dim int, part int, shard int, block int, sub int, queries binary, rows binary, adds binary, all binary"
HIT = "query long, num long, score long"


@dataclass(frozen=True)
class Layout:
    """Rows that are kept a query, shards and blocks, and the constants of the same names that tasks go by."""

    k: int
    shards: int
    blocks: int
    lists: int
    many: int
    pairs: int


def vectors_of(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (num, dim, wide, ints, ids, lost, first, asked), and the queries (query_id, num); both written.

    ids are structs of the k + 1 smallest vec_ids; more can't be among a query's k best, even without its own.
    """
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    ints = F.transform("embedding", lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(good).select("vec_id", ints.alias("ints"))
    rows = rows.select("vec_id", "ints", F.unhex(F.sha1(F.concat_ws(",", F.transform("ints", lambda v: v.cast("string"))))).alias("key"), (F.col("vec_id") % EVERY == 0).alias("q"))
    rows = rows.select("vec_id", "ints", "key", F.coalesce("q", F.lit(False)).alias("q"))
    rows = written(rows.dropDuplicates(["vec_id", "key"]), "rows")
    place = Window.partitionBy("key").orderBy(F.asc_nulls_last("vec_id"))
    few = rows.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1)  # trimmed before the shuffle too
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_r", "vec_id"))), lambda s: F.struct(s["vec_id"].alias("vec_id")))
    one = few.groupBy("key").agg(F.first("ints").alias("ints"), ids.alias("ids"))
    asked = rows.where("q").select("key").distinct().withColumn("asked", F.lit(True))
    one = one.join(asked, "key", "left").withColumn("num", F.monotonically_increasing_id())
    first = F.col("ids")[0]["vec_id"]
    vectors = written(one.select("num", "key", F.size("ints").alias("dim"), F.exists("ints", lambda v: F.abs(v) >= WIDE).alias("wide"), "ints", "ids", first.isNull().alias("lost"), F.coalesce(first, F.lit(0)).alias("first"), F.coalesce("asked", F.lit(False)).alias("asked")), "vectors")
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), "key").join(vectors.where("asked").select("key", "num"), "key").select("query_id", "num")
    return vectors.drop("key"), written(queries, "queries")


def _place(n: int, wide: int) -> Column:
    """The shard or block of a vector, by a hash of its number; those for wide vectors come last."""
    at = F.xxhash64("num")
    return F.when(F.col("wide"), n + F.pmod(at, F.lit(max(1, wide)))).otherwise(F.pmod(at, F.lit(n))).cast("int")


def _cut(vectors: DataFrame, by: str, place: Column, n_lists: int, schema: str) -> DataFrame:
    """Shards or blocks of vectors as a row a part."""
    rows = vectors.select("dim", place.alias(by), "num", "first", "lost", "ints")
    dealt = rows.repartition("dim", by).sortWithinPartitions("dim", by, "num")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            nums, first, lost = (np.concatenate([h[i] for h in held]) for i in range(3))
            whole = np.concatenate([h[3] for h in held])
            for part, cut in enumerate(np.array_split(whole, n_lists, axis=1)):
                values, kind = packed(cut)
                row = {"dim": place[0], "part": part, by: place[1], "nums": nums.tobytes(), "firsts": first.tobytes(), "lost": lost.tobytes(), "vals": values, "kind": kind}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in names}], schema=_arrow(schema))

        for part in parts:
            dims, at = part.column(0).to_numpy(), part.column(1).to_numpy()
            ends = np.flatnonzero((dims[1:] != dims[:-1]) | (at[1:] != at[:-1])) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), part.num_rows], strict=True):
                if a == b:
                    continue
                if (dims[a], at[a]) != place:
                    if held:
                        yield from done()
                    place, held = (int(dims[a]), int(at[a])), []
                some = part.slice(a, b - a)
                lost = some.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((some.column(2).to_numpy(), some.column(3).to_numpy(), lost, some.column(5).flatten().to_numpy().reshape(b - a, int(dims[a]))))
        if held:
            yield from done()

    return written(dealt.mapInArrow(tidy(run), schema), by)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])


def _matrix(row: dict, prefix: str = "") -> np.ndarray:
    n = len(row[f"{prefix}nums"]) // 8
    return np.frombuffer(row[f"{prefix}vals"], row[f"{prefix}kind"]).reshape(n, -1 if n and len(row[f"{prefix}vals"]) else 0)


def _subs(n_queries: int, n_rows: int, pairs: int) -> Iterator[tuple[int, int, int]]:
    """Number and ends of the ranges of queries that go together in a cell."""
    step = max(1, pairs // max(1, n_rows))
    for sub, a in enumerate(range(0, n_queries, step)):
        yield sub, a, min(a + step, n_queries)


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in parts:
        for i in range(part.num_rows):
            yield part.slice(i, 1).to_pylist()[0]


def _entry(row: dict, sub: int, queries: np.ndarray, rows: np.ndarray, adds: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    made = {n: row[n] for n in ("dim", "part", "shard", "block")} | {"sub": sub, "queries": queries.astype(np.int32).tobytes(), "rows": rows.astype(np.int32).tobytes(), "adds": adds.astype(np.int64).tobytes(), "all": whole.astype(np.int32).tobytes()}
    return pa.RecordBatch.from_pylist([made], schema=_arrow(ENTRY))


def _cells(lists: DataFrame, asks: DataFrame, layout: Layout) -> DataFrame:
    """Each list with each block of queries of its part."""
    stripes = -(-layout.blocks // STRIPE)
    many = lists.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    own = asks.select("dim", "part", "block", F.col("nums").alias("q_nums"), F.col("vals").alias("q_vals"), F.col("kind").alias("q_kind"), *(c for c in asks.columns if c == "cutoffs"), F.pmod("block", F.lit(stripes)).alias("stripe"))
    return many.join(own.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(layout.shards - 1)))), ["dim", "part", "shard", "stripe"])


def gathered(cells: DataFrame, layout: Layout) -> DataFrame:
    """Phase 1: for each query of a cell the k rows to which the part adds most."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            values, asked = _matrix(row), _matrix(row, "q_")
            exact = _exact(asked, values, layout)
            few = min(layout.k, len(values))
            for sub, a, b in _subs(len(asked), len(values), layout.pairs):
                if not exact:
                    yield _entry(row, sub, *[np.zeros(0)] * 3, np.arange(a, b))
                    continue
                adds = products(asked[a:b], values)
                at = np.argpartition(adds, adds.shape[1] - few, axis=1)[:, -few:]
                yield _entry(row, sub, np.repeat(np.arange(a, b), few), at.ravel(), np.take_along_axis(adds, at, 1).ravel(), np.zeros(0))

    return written(cells.mapInArrow(tidy(run), ENTRY), "gathered")


def collected(cells: DataFrame, layout: Layout) -> DataFrame:
    """Phase 2: the rows to which the part adds its share of the cutoff. cutoffs: num and cutoff of a block's queries that have one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(parts):
            values, asked, least = _matrix(row), _matrix(row, "q_"), _cutoffs(row["q_nums"], row["cutoffs"])
            exact = _exact(asked, values, layout)
            for sub, a, b in _subs(len(asked), len(values), layout.pairs):
                if not exact:
                    yield _entry(row, sub, *[np.zeros(0)] * 3, np.arange(a, b))
                    continue
                adds = products(asked[a:b], values)
                top = bounded(adds)
                need = [max(-top, min(top + 1, -(-x // layout.lists))) if x is not None else 0 for x in least[a:b]]
                high = adds >= np.array(need, adds.dtype)[:, None]
                whole = np.array([x is None for x in least[a:b]]) | (high.sum(axis=1) * layout.many > max(len(values), layout.many**2))
                high[whole] = False
                q, r = np.nonzero(high)
                yield _entry(row, sub, q + a, r, adds[q, r], np.flatnonzero(whole) + a)

    return written(cells.mapInArrow(tidy(run), ENTRY), "collected")


def _exact(asked: np.ndarray, values: np.ndarray, layout: Layout) -> bool:
    """Whether sums over all parts fit; else scores are worked out whole, as what is cut off can't be added."""
    return bounded(asked) * bounded(values) * max(1, values.shape[1]) * layout.lists < LIMIT


def _cutoffs(nums: bytes, cutoffs: list[dict] | None) -> list[int | None]:
    known = {x["num"]: x["cutoff"] for x in cutoffs or ()}
    return [known.get(n) for n in np.frombuffer(nums, np.int64).tolist()]


class Cell:
    """A shard and a block of queries with all parts, where scores are resolved."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.lists: dict[int, dict] = {}
        self.asks: dict[int, dict] = {}
        self.sub, self.entries = -1, []

    def values(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(self.asks[part]), _matrix(self.lists[part])

    def resolved(self) -> Iterator[pa.RecordBatch]:
        """The k best rows of the queries of the entries at hand."""
        if not self.entries:
            return
        nums = np.frombuffer(self.lists[0]["nums"], np.int64)
        asked = np.frombuffer(self.asks[0]["nums"], np.int64)
        first, lost = np.frombuffer(self.lists[0]["firsts"], np.int64), np.frombuffer(self.lists[0]["lost"], np.int64)
        least = _cutoffs(self.asks[0]["nums"], self.asks[0]["cutoffs"])
        floor = np.array([-(1 << 63) if x is None else x for x in least], np.int64)
        whole = np.unique(np.concatenate([np.frombuffer(e["all"], np.int32) for e in self.entries]))
        keys, known = [], []
        for e in self.entries:
            q, r = np.frombuffer(e["queries"], np.int32).astype(np.int64), np.frombuffer(e["rows"], np.int32)
            open_ = ~np.isin(q, whole)
            keys.append((q * len(nums) + r)[open_])
            known.append(np.frombuffer(e["adds"], np.int64)[open_])
        pairs = np.unique(np.concatenate(keys))
        n_lists = self.layout.lists
        adds, has = np.zeros((n_lists, len(pairs)), np.int64), np.zeros((n_lists, len(pairs)), bool)
        for e, key, add in zip(self.entries, keys, known, strict=True):
            at = np.searchsorted(pairs, key)
            adds[e["part"], at], has[e["part"], at] = add, True
        q, r = pairs // len(nums), pairs % len(nums)
        # a list that doesn't name a row adds less than its share of the cutoff
        most = -(-floor[q] // n_lists) - 1
        can = (floor[q] <= -LIMIT) | (np.where(has, adds, most).sum(axis=0) >= floor[q])
        q, r, adds, has = q[can], r[can], adds[:, can], has[:, can]
        for part in range(n_lists):
            own, values = self.values(part)
            for a in range(0, len(q), 65_536):
                open_ = np.flatnonzero(~has[part, a : a + 65_536]) + a
                adds[part, open_] = np.einsum("ij,ij->i", own[q[open_]].astype(np.int64), values[r[open_]].astype(np.int64))
        score = adds.sum(axis=0)
        step = max(1, self.layout.pairs // max(1, len(nums)))
        own, values = (np.concatenate(x, axis=1) if len(whole) else None for x in zip(*map(self.values, range(n_lists)), strict=True))
        for a in range(0, len(whole), step):
            some = whole[a : a + step]
            sums = products(own[some], values).astype(np.int64)
            x, y = np.nonzero(sums >= floor[some][:, None])
            best = best_of(x, sums[x, y], lost[y], first[y], self.layout.k)
            q, r, score = np.concatenate([q, some[x[best]]]), np.concatenate([r, y[best]]), np.concatenate([score, sums[x[best], y[best]]])
        good = score >= floor[q]
        q, r, score = q[good], r[good], score[good]
        best = best_of(q, score, lost[r], first[r], self.layout.k)
        self.entries = []
        yield pa.RecordBatch.from_arrays([pa.array(asked[q[best]], pa.int64()), pa.array(nums[r[best]], pa.int64()), pa.array(score[best], pa.int64())], names=["query", "num", "score"])


def resolved(entries: DataFrame, lists: DataFrame, asks: DataFrame, layout: Layout, name: str) -> DataFrame:
    """Phase 3: query, num and score of the k best rows of each cell among those that its lists name."""
    if "cutoffs" not in asks.columns:
        asks = asks.withColumn("cutoffs", F.lit(None).cast("array<struct<num:long,cutoff:long>>"))
    sides = [
        lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(layout.blocks - 1)))).withColumn("side", F.lit(0)),
        asks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(layout.shards - 1)))).withColumn("side", F.lit(1)),
        entries.withColumn("side", F.lit(2)),
    ]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).unionByName(sides[2], allowMissingColumns=True)
    cell = ["dim", "shard", "block"]
    dealt = both.repartition(*cell).sortWithinPartitions(*cell, "side", "sub", "part")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, now = None, Cell(layout)
        for row in _rows(parts):
            here = tuple(row[c] for c in cell)
            if here != place:
                yield from now.resolved()
                place, now = here, Cell(layout)
            if row["side"] == 0:
                now.lists[row["part"]] = row
            elif row["side"] == 1:
                now.asks[row["part"]] = row
            else:
                if row["sub"] != now.sub:
                    yield from now.resolved()
                now.sub = row["sub"]
                now.entries.append(row)
        yield from now.resolved()

    return written(dealt.mapInArrow(tidy(run), HIT), name)


def _ranked(hits: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each query, ties to the smaller first id."""
    rows = hits.join(vectors.select("num", "lost", "first"), "num")
    place = Window.partitionBy("query").orderBy(F.desc("score"), "lost", "first")
    return rows.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k)


def top_products(rows: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id and score of the k rows of the greatest inner product with each query, its own row left out."""
    vectors, queries = vectors_of(rows, k)
    n = {(w, q): 0 for w in (False, True) for q in (False, True)}
    values = 0
    for r in vectors.groupBy("wide", "asked").agg(F.count("*").alias("n"), F.sum("dim").alias("values")).collect():
        n[r["wide"], r["asked"]], values = r["n"], values + r["values"]
    places = []
    for few, least, most, parts in ((n[False, False] + n[False, True], LEAST_ROWS, SHARD_ROWS, SHARDS), (n[False, True], LEAST_QUERIES, BLOCK_ROWS, BLOCKS)):
        cut = -(-few // min(most, max(least, -(-few // parts))))
        places.append(max(1, cut, -(-values // SHARD_VALUES // (EVERY if places else 1))))
    wide = [-(-(n[True, False] + n[True, True]) // LEAST_ROWS), -(-n[True, True] // LEAST_QUERIES)]
    layout = Layout(k + 1, places[0] + wide[0], places[1] + wide[1], LISTS, MANY, PAIRS)  # a query's own vector is one of k + 1
    lists = _cut(vectors, "shard", _place(places[0], wide[0]), LISTS, LIST)
    block = _place(places[1], wide[1])
    asks = _cut(vectors.where("asked"), "block", block, LISTS, ASK)
    first = resolved(gathered(_cells(lists, asks, layout), layout), lists, asks, layout, "first")
    best = first.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("_r") <= k + 1)
    cutoffs = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("cutoff")).where(F.col("n") == k + 1)
    cutoffs = vectors.where("asked").select(F.col("num").alias("query"), "dim", block.alias("block")).join(cutoffs, "query")
    cutoffs = cutoffs.groupBy("dim", "block").agg(F.collect_list(F.struct(F.col("query").alias("num"), "cutoff")).alias("cutoffs"))  # at most a block's rows
    asks = written(asks.join(cutoffs, ["dim", "block"], "left"), "cutoffs")
    hits = resolved(collected(_cells(lists, asks, layout), layout), lists, asks, layout, "hits")
    found = _ranked(hits, vectors, k + 1).select("query", "num", "score").join(vectors.select("num", F.inline("ids")), "num")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = written(found.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k + 1).drop("_r"), "found")
    rows = queries.withColumnRenamed("num", "query").join(found, "query").where("NOT (vec_id <=> query_id AND num = query)")
    place = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The contract in DuckDB's SQL.
SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS own, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND len(q.v) = len(c.v) AND NOT (q.vec_id = c.vec_id AND q.v = c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
