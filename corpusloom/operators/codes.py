"""Nearest rows by codes of a byte a component: the exact answers from a part of the bytes.

A row's code is its vector of unit length in 255 steps of its own size, and how far the code is from it. A search compares queries with
codes alone; what a code is off by bounds the true similarity from both sides. Rows whose upper bound is below the k-th
lower bound of a query can't be among its k; the few others are compared exactly, with their vectors.

Codes are kept in shards of bounded size, a row each, which meet blocks of queries in cells. Rows without a vector, without length, with
a component that isn't finite, or of another size than most are left out, and queries of another size have no hit. Rows
that repeat a key are rows of their own. An empty table has no codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..session import written

#: Rows of a shard, queries of a block, and similarities that are held at a time.
SHARD_ROWS, QUERY_ROWS, BLOCK = 16_384, 2048, 1 << 22
#: What sums of short floats and the rounding of similarities may be off by.
SLACK = 1e-5

SHARDS = pa.schema([("shard", pa.int64()), ("nums", pa.binary()), ("codes", pa.binary()), ("steps", pa.binary()), ("off", pa.binary())])
CANDIDATES = "query_id long, num long, low double, high double"


@dataclass(frozen=True)
class Codes:
    """rows: num, key, vector. shards: see SHARDS. width: components of a vector."""

    rows: DataFrame
    shards: DataFrame
    key: str
    width: int
    n_shards: int


def encoded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of rows, the size of a step of each, and the distance of each from its vector of unit length."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    step = np.maximum(np.abs(unit).max(axis=1), 1e-30) / 127
    code = np.rint(unit / step[:, None]).astype(np.int8)
    return code, step, np.linalg.norm(unit - code * step[:, None], axis=1)


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Codes:
    """Codes of all rows."""
    fine = lambda v: F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull()).where(fine("vector"))
    rows = written(rows.withColumn("num", F.monotonically_increasing_id()), "rows")
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    width, n = (sizes["size"], sizes["n"]) if sizes else (0, 0)
    rows = rows.where(F.size("vector") == width)
    n_shards = max(1, -(-n // SHARD_ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("num"), F.lit(n_shards)).alias("shard"), "num", "vector").repartition("shard").sortWithinPartitions("shard", "num")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                nums, codes, steps, off = (np.concatenate(x) for x in zip(*held, strict=True))
                yield pa.RecordBatch.from_pylist([{"shard": place, "nums": nums.tobytes(), "codes": codes.tobytes(), "steps": steps.astype(np.float32).tobytes(), "off": off.astype(np.float32).tobytes()}], schema=SHARDS)

        for part in parts:
            shard = part.column(0).to_numpy()
            ends = (np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist()
            for a, b in zip([0, *ends], [*ends, part.num_rows], strict=True):
                if a < b:
                    if shard[a] != place:
                        yield from done()
                        place, held = int(shard[a]), []
                    some = part.slice(a, b - a)
                    held.append((some.column(1).to_numpy(), *encoded(some.column(2).flatten().to_numpy().reshape(b - a, -1))))
        yield from done()

    shards = written(dealt.mapInArrow(run, "shard long, nums binary, codes binary, steps binary, off binary"), "codes")
    return Codes(rows, shards, key, width, n_shards)


def _asked(codes: Codes, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """Queries of the codes' size, in blocks: block, ids and vectors of unit length, as a row each."""
    rows = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == codes.width) & F.forall("v", lambda x: x.isNotNull()))
    rows = written(rows, "queries")
    blocks = max(1, -(-rows.count() // QUERY_ROWS))
    held = rows.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))  # a block's queries
    return held


def search(codes: Codes, queries: DataFrame, k: int, key: str = "query_id", vector: str = "asked", skip_self: bool = False, digits: int = 6, cost: dict | None = None) -> DataFrame:
    """query_id, the codes' key, cos and rank: the k nearest rows of each query, ties to the smaller key, exactly.

    ``cost`` receives the bytes of codes and of vectors, and how many rows were compared exactly.
    """
    name, width = codes.key, codes.width
    asked = _asked(codes, queries, key, vector).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(codes.n_shards - 1).cast("long"))))
    need = k + 1 if skip_self else k  # a query's own row may be among the best

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                row = part.slice(i, 1)
                nums, table, step, off = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in ((1, np.int64), (2, np.int8), (3, np.float32), (4, np.float32)))
                own = row.column(5).flatten()
                ids, q = own.field(0).to_numpy(), own.field(1).flatten().to_numpy().reshape(-1, width)
                q = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)).astype(np.float32)
                known = (table.reshape(-1, width) * step[:, None]).T
                for a in range(0, len(ids), max(1, BLOCK // len(nums))):
                    near = q[a : a + max(1, BLOCK // len(nums))] @ known
                    low = near - (off + np.float32(SLACK))
                    least = np.partition(low, -need, axis=1)[:, -need] if low.shape[1] > need else np.full(len(low), -np.inf, np.float32)
                    at, r = np.nonzero(near + (off + np.float32(SLACK)) >= least[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + at]), pa.array(nums[r]), pa.array(low[at, r], pa.float64()), pa.array((near[at, r] + off[r] + np.float32(SLACK)).astype(np.float64))], names=["query_id", "num", "low", "high"])

    cells = codes.shards.join(asked, "shard").select("shard", "nums", "codes", "steps", "off", "asked")
    found = written(cells.mapInArrow(run, CANDIDATES), "candidates")
    place = Window.partitionBy("query_id").orderBy(F.desc("low"))
    least = found.withColumn("_r", F.row_number().over(place)).where(F.col("_r") == need).select("query_id", F.col("low").alias("_least"))
    left = found.join(least, "query_id", "left").where(F.col("_least").isNull() | (F.col("high") >= F.col("_least"))).select("query_id", "num")
    left = written(left, "left")
    if cost is not None:
        cost["rows"], cost["compared"] = codes.rows.count(), left.count()
        cost["code_bytes"], cost["vector_bytes"] = (codes.shards.agg(F.sum(F.length("codes") + F.length("steps") + F.length("off"))).first()[0] or 0), cost["rows"] * width * 8
    vectors = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("_q"))
    rows = left.join(codes.rows, "num").join(vectors, "query_id").select("query_id", name, F.round(cosine(F.col("_q"), F.col("vector")), digits).alias("cos"))
    if skip_self:
        rows = rows.where(F.col("query_id") != F.col(name))
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
