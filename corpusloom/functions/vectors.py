"""Vector expressions, and similarity search as block products in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to all tasks at once, and bytes of them; more are taken in blocks, which meet shards of so many rows.
QUERY_BLOCK, QUERY_BYTES, SHARD_ROWS = 4096, 64 << 20, 65_536
#: Similarities that are held at a time.
BLOCK = 1 << 22


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)


def normalised(a: Column) -> Column:
    """To unit length; a zero vector stays."""
    # the length is computed once, and handed to each element
    return F.zip_with(a, F.array_repeat(F.greatest(norm(a), F.lit(1e-12)), F.size(a)), lambda x, n: x.cast("double") / n)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal size as rows, of unit length; nulls and vectors of other sizes are zero."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    if not len(sizes) or not sizes.max():
        return np.zeros((len(sizes), 0))
    width = int(np.bincount(sizes[sizes > 0]).argmax())
    out = np.zeros((len(sizes), width))
    ok = sizes == width
    if ok.all():
        out[:] = np.asarray(column.flatten(), np.float64).reshape(-1, width)
    else:
        for i in np.flatnonzero(ok):
            out[i] = column[int(i)].as_py()
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def best_k(q: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hits (query, id, cosine) the k best of each query, ties to the smaller id, by query."""
    order = np.lexsort((ids, -cos, q))
    q = q[order]
    stay = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[stay], ids[order[stay]], cos[order[stay]]


class Nearest:
    """The k nearest rows of some queries among those that were shown. Rows come in blocks of at most BLOCK similarities."""

    def __init__(self, names: np.ndarray, own: np.ndarray, k: int, skip_self: bool, digits: int):
        self.names, self.own, self.k, self.skip_self, self.digits = names, own, k, skip_self, digits
        self.least = np.full(len(names), -np.inf)
        self.hits = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def show(self, rows: np.ndarray, vectors: np.ndarray) -> None:
        """Rows of unit length, or without columns if none has a vector."""
        step = max(1, BLOCK // max(1, len(self.names)))
        for a in range(0, len(rows) if len(self.names) else 0, step):
            ids, some = rows[a : a + step], vectors[a : a + step]
            cos = np.round(self.own @ some.T, self.digits) if some.shape[1] == self.own.shape[1] else np.zeros((len(self.names), len(ids)))
            if self.skip_self:
                cos[ids[None, :] == self.names[:, None]] = -np.inf
            # what is below a query's k-th can't be among its k; ties stay, as ids decide
            floor = np.maximum(self.least, np.partition(cos, -self.k, axis=1)[:, -self.k]) if cos.shape[1] > self.k else self.least
            q, c = np.nonzero((cos >= floor[:, None]) & np.isfinite(cos))
            self.hits = best_k(*(np.concatenate(x) for x in zip(self.hits, (q, ids[c], cos[q, c]), strict=True)), self.k)
            q, full = self.hits[0], np.bincount(self.hits[0], minlength=len(self.names)) == self.k
            self.least[full] = self.hits[2][np.searchsorted(q, np.flatnonzero(full), "right") - 1]

    def batch(self, key: str) -> pa.RecordBatch:
        q, ids, cos = self.hits
        return pa.RecordBatch.from_arrays([pa.array(self.names[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(cos)], names=["query_id", key, "cos"])


def top_k(corpus: DataFrame, queries: list[tuple[int, list[float]]] | DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = False, digits: int = 6) -> DataFrame:
    """query_id, vec_id, cos and rank: the k most similar rows for each query, ties to the smaller id.

    Queries are a list, or a table of query_id and asked. Up to QUERY_BLOCK of at most QUERY_BYTES are sent to all tasks,
    each of which keeps k rows a query; more meet the rows in cells, blocks of queries and shards of rows, and never
    pass the driver. Only what cells and tasks keep is ranked together. Vectors of queries have one size.
    """
    if isinstance(queries, DataFrame):
        few = queries.agg(F.count("*").alias("n"), F.sum(F.size("asked")).alias("values")).first()
        if few["n"] > QUERY_BLOCK or (few["values"] or 0) * 8 > QUERY_BYTES:
            out = _cells(corpus, queries, few["n"], few["values"], k, key, vector, skip_self, digits)
        else:
            rows = queries.select("query_id", "asked").orderBy("query_id").collect()  # at most QUERY_BLOCK
            out = _sent(corpus, [(r["query_id"], r["asked"]) for r in rows], k, key, vector, skip_self, digits)
    else:
        out = None
        for at in range(0, max(1, len(queries)), QUERY_BLOCK):
            part = _sent(corpus, queries[at : at + QUERY_BLOCK], k, key, vector, skip_self, digits)
            out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _sent(corpus: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str, vector: str, skip_self: bool, digits: int) -> DataFrame:
    names = np.array([q for q, _ in queries], np.int64)
    raw = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    sent = corpus.sparkSession.sparkContext.broadcast((names, raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(*sent.value, k, skip_self, digits)
        for part in parts:
            nearest.show(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), matrix(part.column(1)))
        yield nearest.batch(key)

    return corpus.select(key, vector).mapInArrow(run, f"query_id long, {key} long, cos double")


def _cells(corpus: DataFrame, queries: DataFrame, n: int, values: int, k: int, key: str, vector: str, skip_self: bool, digits: int) -> DataFrame:
    blocks = max(-(-n // QUERY_BLOCK), -(-values * 8 // QUERY_BYTES))
    rows = corpus.select(F.lit(1).alias("side"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = rows.withColumn("shard", at("id", shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select(F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("asked").cast("array<double>").alias("vector"))
    asked = asked.withColumn("block", at("id", blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return _met(asked.unionByName(rows).select("shard", "block", "side", "id", "vector"), k, key, skip_self, digits)


def top_k_within(corpus: DataFrame, queries: DataFrame, k: int, by: str, key: str = "vec_id", vector: str = "embedding", skip_self: bool = True, digits: int = 6) -> DataFrame:
    """query_id, key, cos and rank: the k most similar rows of each query's own group. queries: query_id, by, asked.

    A group's rows are dealt into shards and its queries into blocks, which meet in cells, so a frequent group is many
    tasks' work; a cell returns k rows a query. Groups without a query aren't shuffled.
    """
    counts = lambda rows, size, name: rows.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).cast("int").alias(name))
    rows = corpus.join(queries.select(by).distinct(), by, "left_semi")
    sizes = counts(rows, SHARD_ROWS, "_shards").join(counts(queries, QUERY_BLOCK, "_blocks"), by)
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = rows.join(sizes, by).select(by, "_blocks", at(key, "_shards").alias("_shard"), F.lit(1).alias("side"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    shown = shown.select("*", each("_blocks").alias("_block"))
    asked = queries.join(sizes, by).select(by, "_shards", at("query_id", "_blocks").alias("_block"), F.lit(0).alias("side"), F.col("query_id").cast("long").alias("id"), F.col("asked").cast("array<double>").alias("vector"))
    asked = asked.select("*", each("_shards").alias("_shard"))
    cell = lambda df: df.select(F.xxhash64(by).alias("shard"), F.hash("_shard", "_block").alias("block"), "side", "id", "vector")
    out = _met(cell(asked).unionByName(cell(shown)), k, key, skip_self, digits)
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _met(rows: DataFrame, k: int, key: str, skip_self: bool, digits: int) -> DataFrame:
    """The k nearest rows (side 1) of each query (side 0) of each cell (shard, block)."""
    dealt = rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "side")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, names, own, nearest = None, [], [], None
        for part in parts:
            columns = [part.column(i).to_numpy() for i in range(3)]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), part.num_rows], strict=True):
                if a == b:
                    continue
                if (here := tuple(c[a] for c in columns[:2])) != place:
                    if nearest:
                        yield nearest.batch(key)
                    place, names, own, nearest = here, [], [], None
                ids, vectors = part.column(3).to_numpy()[a:b], matrix(part.column(4).slice(a, b - a))
                if columns[2][a] == 0:
                    names.append(ids)
                    own.append(vectors)
                elif names:
                    nearest = nearest or Nearest(np.concatenate(names), np.concatenate(own), k, skip_self, digits)
                    nearest.show(ids, vectors)
        if nearest:
            yield nearest.batch(key)

    return dealt.mapInArrow(run, f"query_id long, {key} long, cos double")


def centroids(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key, n and centroid (the mean vector). Sums are made in the tasks that read, so a frequent key is no hot spot."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for part in parts:
            keys = part.column(0).to_pylist()
            for i, v in enumerate(part.column(1).to_pylist()):
                if v is not None:
                    s = sums.setdefault(keys[i], [0, np.zeros(len(v))])
                    s[0] += 1
                    s[1] += v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64() if kind in ("int", "bigint") else None), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tolist() for s in sums.values()], pa.list_(pa.float64()))], names=[key, "n", "total"])

    source = rows.select(F.col(key).cast("long").alias(key) if kind == "int" else key, vector)
    parts = source.mapInArrow(run, f"{key} {'long' if kind == 'int' else kind}, n long, total array<double>")
    sums = parts.select(key, "n", F.posexplode("total").alias("at", "x")).groupBy(key, "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x"))))
    return sums.groupBy(key).agg(F.max("n").alias("n"), F.transform(ordered, lambda s: s["x"]).alias("centroid"))
