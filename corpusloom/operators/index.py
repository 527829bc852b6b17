"""An index of vectors by lists: approximate nearest neighbours that read a part of the rows.

Centroids are learned on a bounded sample; every row is put into the list of its nearest centroid. A search looks
into a query's nearest lists and ranks their rows exactly. Lists of any size are cut into shards of bounded size by a
hash of the key, so a frequent vector's list is many tasks' work. With all lists probed the answer is exact.

Rows without a vector, and those of another size than the centroids, are in no list. Queries without one have no hit.
Rows that repeat a key stay rows. An empty table has an index without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import best_k, matrix
from ..session import written

#: Rows that centroids are learned on, those of them that are searched to set the probes, most lists, rows of a shard,
#: and queries of a block.
SAMPLE, TRIED, LISTS, SHARD_ROWS, QUERY_ROWS = 20_000, 512, 1024, 8192, 2048


def learned(vectors: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length by rounds of means; the first are rows spread over those given, empty lists keep theirs."""
    centroids = vectors[np.linspace(0, len(vectors) - 1, min(lists, len(vectors))).astype(int)] if len(vectors) else vectors
    for _ in range(rounds if len(centroids) else 0):
        of = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, vectors)
        long = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(long > 1e-12, sums / np.maximum(long, 1e-12), centroids)
    return centroids


def probes_for(vectors: np.ndarray, centroids: np.ndarray, recall: float, k: int) -> int:
    """The fewest lists in which this part of the k nearest rows are, for the first TRIED vectors among those given.

    Neighbours in a sample are farther than those in the whole table, and so in lists farther off.
    """
    asked = vectors[:TRIED]
    if len(vectors) < 2:
        return 1
    cos = asked @ vectors.T
    cos[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(k, len(vectors) - 1)
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    need = np.take_along_axis(place, (vectors @ centroids.T).argmax(axis=1)[near], axis=1)
    return int(np.quantile(need, recall, method="higher")) + 1


@dataclass(frozen=True)
class Index:
    """Rows (key, vector, list, shard), the shards of each list, the centroids, at most LISTS, and the lists to probe."""

    rows: DataFrame
    shards: DataFrame
    centroids: np.ndarray
    key: str
    probes: int


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 10) -> Index:
    """An index of all rows with a vector. Without a number of lists it is about the root of the rows, at most LISTS.

    The sample tells how many lists a search must probe for a recall of the k nearest rows.
    """
    rows = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vector")).where(F.size("vector") > 0)
    rough = rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()  # SAMPLE rows
    n = rows.count()
    vectors = matrix(rough)
    centroids = learned(vectors, max(1, min(lists or int(n**0.5), LISTS)))
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # at most LISTS vectors

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in parts:
            fit = pc.equal(pc.list_value_length(part.column(1)), own.shape[1])
            part = part.filter(fit)
            if part.num_rows:
                of = (matrix(part.column(1)) @ own.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(of, pa.int32())], names=[key, "vector", "list"])

    placed = written(rows.mapInArrow(run, f"{key} long, vector array<double>, list int"), "lists")
    shards = placed.groupBy("list").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("n_shards"))
    placed = placed.join(F.broadcast(shards), "list").withColumn("shard", F.pmod(F.xxhash64(key), F.col("n_shards")).cast("int")).drop("n_shards")
    return Index(placed, shards, centroids, key, probes_for(vectors, centroids, recall, k))


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, key: str = "query_id", vector: str = "asked", skip_self: bool = False, digits: int = 6) -> DataFrame:
    """query_id, the index's key, cos and rank: the k best rows of each query's nearest lists, ties to the smaller key.

    A list's queries are cut into blocks; a block and a shard meet in a cell, so cells are bounded on both sides.
    A batch of a shard returns k rows for each query of the cell; only these are ranked together. Lists that no query
    probes aren't shuffled.
    """
    name, width, centroids, probes = index.key, index.centroids.shape[1], index.centroids, probes or index.probes
    sent = queries.sparkSession.sparkContext.broadcast(centroids)

    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for part in parts:
            part = part.filter(pc.equal(pc.list_value_length(part.column(1)), width))
            if not part.num_rows or not len(own):
                continue
            near = np.argsort(-(matrix(part.column(1)) @ own.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            at = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns), pa.array(near.ravel())], names=["id", "vector", "list"])

    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = written(asked.mapInArrow(probe, "id long, vector array<double>, list int"), "probes")
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("n_blocks"))
    cells = F.broadcast(index.shards.join(blocks, "list"))  # a row for each list
    asked = asked.join(cells, "list").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("n_shards") - 1)))
    asked = asked.select("id", "vector", "list", "shard", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int").alias("block"), F.lit(0).alias("side"))
    rows = index.rows.join(cells, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    both = asked.unionByName(rows.select(F.col(name).alias("id"), "vector", "list", "shard", "block", F.lit(1).alias("side")))
    cell = ["list", "shard", "block"]
    dealt = both.repartition(*cell).sortWithinPartitions(*cell, "side")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, vectors = None, [], []
        for part in parts:
            columns = [part.column(i).to_numpy() for i in range(2, 6)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), part.num_rows], strict=True):
                if a == b:
                    continue
                here, some = tuple(c[a] for c in columns[:3]), part.slice(a, b - a)
                if here != place:
                    place, ids, vectors = here, [], []
                own, v = some.column(0).to_numpy(), matrix(some.column(1))
                if columns[3][a] == 0:  # queries come first
                    ids.append(own)
                    vectors.append(v)
                    continue
                for q, w in zip(ids, vectors, strict=True):
                    yield ranked(q, w, own, v)

    def ranked(q: np.ndarray, w: np.ndarray, own: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        cos = np.round(w @ v.T, digits)
        if skip_self:
            cos[q[:, None] == own[None, :]] = -np.inf
        if cos.shape[1] > k:  # the k best and their ties
            cos[cos < np.partition(cos, -k, axis=1)[:, -k, None]] = -np.inf
        at, row = np.nonzero(np.isfinite(cos))
        at, ids, best = best_k(at, own[row], cos[at, row], k)
        return pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(ids), pa.array(best)], names=["query_id", name, "cos"])

    hits = dealt.mapInArrow(run, f"query_id long, {name} long, cos double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), name)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
