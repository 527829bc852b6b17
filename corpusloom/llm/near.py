"""N-gram Jaccard join of documents with Bayesian pruning.

Documents are sets of runs of five words. Rows with the same set are one class. Classes that agree in a
band of MinHash values are candidates; their values are compared a few at a time, and a pair is dropped
once the posterior probability that its similarity reaches the threshold is below TOLERANCE. What remains
ties candidates into components, and within each component all pairs are verified exactly, by their sets.

32 bands of 4 values miss a pair at similarity 0.8 with probability 5e-8, and one above with less;
TOLERANCE bounds what pruning may drop. Links are exact counts over sets of 64-bit hashes.

Nulls, and texts without words, are linked with nothing. Texts of one to four words are one run. Rows that
repeat a doc_id are rows of their own; class_id is the least doc_id of the class (null if it has none).
Very long texts are taken whole. Empty tables give no row. Other columns of docs stay in one_of_each(), whatever
their names, and aren't carried elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import by_cell, cells, components, grouped, least_labels, verified
from .shared import FOLD, Words, chunks, mix, same_row, small, text_bytes, tidy, written

SHINGLE = 5
HASHES, BAND = 128, 4
BUCKET_BLOCK = 1024
TOLERANCE, STEP = 1e-6, 16
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of five words."""
    t = Words(texts, FOLD)
    at, h = t.windows(SHINGLE)
    first = np.searchsorted(at, t.first)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b > a:
            out.append(np.unique(h[a:b]))
        elif t.counts[i]:
            one = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for x in t.hashes[t.first[i] : t.first[i + 1]]:
                    one = mix(one * np.uint64(31) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(values: np.ndarray) -> bytes:
    """128 bits that stand for a set of 64-bit values."""
    with np.errstate(over="ignore"):
        a = mix(values).sum(dtype=np.uint64)
        b = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(values))
    return a.tobytes() + b.tobytes()


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash values for each set; none may be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if sets:
        values = np.concatenate(sets)
        begins = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(s) for s in sets])[:-1]])
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                out[:, k] = np.minimum.reduceat(((values * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), begins)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), n, id of the set, sig (low bytes of MinHash values) and the bands' hashes, for each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = text_bytes(part.column(2))
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b])
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                values = minhashes([sets[i] for i in full])
                wide = values.reshape(len(full), -1, BAND).astype(np.uint64)
                with np.errstate(over="ignore"):
                    band = np.broadcast_to(np.arange(HASHES // BAND, dtype=np.uint64), wide.shape[:2]).copy()
                    for k in range(BAND):
                        band = mix(band * np.uint64(0x9FB21C651E98DF25) + wide[:, :, k])
                sig: list = [None] * (b - a)
                bands: list = [None] * (b - a)
                low = values.astype(np.uint8)
                for r, i in enumerate(full.tolist()):
                    sig[i], bands[i] = low[r].tobytes(), band[r].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(a, b - a), part.column(1).slice(a, b - a), pa.array(sizes, pa.int32()), pa.array([set_id(s) for s in sets], pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.binary())],
                    names=["doc_id", "th", "n", "id", "sig", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, th long, n int, id binary, sig binary, bands binary")


def _keys(rows: DataFrame) -> DataFrame:
    """key and id: a row for each band of each class."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = HASHES // BAND
        for part in parts:
            for a in range(0, part.num_rows, 20_000):
                piece = part.slice(a, 20_000)
                bands = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bands), piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), per)))], names=["key", "id"])

    return rows.select("id", "bands").mapInArrow(tidy(run), "key long, id binary")


def least_matches(threshold: float, compared: int, tolerance: float = TOLERANCE) -> int:
    """The fewest equal values among those compared at which the threshold isn't ruled out.

    Values are single bytes, so unequal sets' values agree by chance once in 256; the prior is uniform.
    """
    s = np.linspace(1e-6, 1 - 1e-6, 4001)
    agree = s + (1 - s) / 256
    for m in range(compared + 1):
        log = m * np.log(agree) + (compared - m) * np.log1p(-agree)
        like = np.exp(log - log.max())
        if like[s >= threshold].sum() / like.sum() >= tolerance:
            return m
    return compared + 1


def _pruned(members: DataFrame, threshold: float) -> DataFrame:
    """Edges a, b of candidates that pruning keeps: for each task and member one edge to the least it is tied to."""
    bounds = [(k, least_matches(threshold, k)) for k in range(STEP, HASHES + 1, STEP)]

    def work(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = table.column("id").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        side = table.column("side").to_numpy()
        names, node = np.unique(np.array([*ids, None], object)[:-1], return_inverse=True)
        cell = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        found_a, found_b = [], []
        lag, base = 1, np.flatnonzero(np.diff(begins)[cell] > 1)
        while len(base):
            base = base[base + lag < begins[cell[base] + 1]]
            if not len(base):
                break
            i, j = base, base + lag
            ok = ((side[i] == 0) | (side[i] != side[j])) & (node[i] != node[j])
            i, j = i[ok], j[ok]
            equal = np.zeros(len(i), np.int64)
            for k, least in bounds:
                equal += (sig[i, k - STEP : k] == sig[j, k - STEP : k]).sum(axis=1)
                alive = equal >= least
                i, j, equal = i[alive], j[alive], equal[alive]
            found_a.append(node[i])
            found_b.append(node[j])
            lag += 1
        if found_a:
            label = least_labels(len(names), np.concatenate(found_a), np.concatenate(found_b))
            moved = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[moved].tolist(), pa.binary()), pa.array(names[label[moved]].tolist(), pa.binary())], names=["a", "b"])

    return by_cell(cells(members, "key", "n_key", "id", BUCKET_BLOCK).drop("key", "n_key"), work, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """For each row: doc_id, class_id (the least doc_id that links connect it with) and n_links, the rows linked with it."""
    if not 0.8 <= threshold <= 1:
        raise ValueError("the bands are made for thresholds from 0.8 to 1")
    four, five = round(threshold * 100), 100
    rows = written(_signed(docs), "signed")
    classes = written(
        rows.where("n > 0").groupBy("id").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        "classes",
    )
    keys = _keys(classes)
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n_key")).where("n_key > 1"), "bands")
    members = written(keys.join(small(shared), "key"), "members")
    edges = _pruned(members.join(classes.select("id", "sig"), "id"), threshold)
    groups = grouped(edges)
    chosen = written(groups.join(classes.select("id", "copies", "first"), "id"), "chosen")
    sets = _sets(docs, chosen)
    found = written(verified(sets, four, five), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = written(linked.join(classes.select("id", "copies", F.col("first.doc_id").alias("doc")), "id").join(links, "id"), "linked")
    least = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    linked = written(named.join(small(written(least, "class-ids")), "root").select("id", "class_id", "links"), "classed")
    whole = classes.select("id", "copies", F.col("first.doc_id").alias("doc")).join(small(linked), "id", "left")
    whole = whole.select("id", F.when(F.col("links").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    many = written(whole.where("n_links > 0"), "many")
    joined = rows.select("doc_id", "n", "id", "th").join(small(many), "id", "left")
    alone = F.col("n_links").isNull() | (F.col("n") == 0)
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), "th", F.when(~alone, F.col("id")).alias("set_id"))


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen classes with their sets, made anew from a row of each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = text_bytes(part.column(0))
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    wanted = small(written(chosen.select(F.col("first.doc_id").alias("_doc"), F.col("first.th").alias("_th")), "wanted"))
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = rows.join(wanted, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi").select("text")
    return rows.mapInArrow(tidy(run), "id binary, set binary").join(small(chosen.select("id", "root", "n_group", "copies", F.col("first").alias("ord"))), "id")


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, less those that are linked with a row kept; all columns stay.

    Of each class one row stays: of those with its least doc_id, the text with the least hash, and of rows that
    repeat both, any one.
    """
    found = near_duplicates(docs, threshold).where("n_links > 0")
    found = written(found.select("doc_id", "class_id", "th"), "linked-rows")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("th").alias("keep"))
    drop = found.join(first.withColumnRenamed("class_id", "_class"), F.col("class_id").eqNullSafe(F.col("_class"))).where(~F.col("doc_id").eqNullSafe(F.col("class_id")) | (F.col("th") != F.col("keep")))
    drop = drop.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).distinct()
    kept = found.join(first.withColumnRenamed("class_id", "_class"), F.col("class_id").eqNullSafe(F.col("_class"))).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("keep")))
    again = kept.groupBy(F.col("doc_id").alias("_doc"), F.col("th").alias("_th")).agg(F.count("*").alias("n")).where("n > 1").select("_doc", "_th")
    hit = small(written(drop.unionByName(again), "dropped"))
    rest = docs.join(hit, same_row(docs, hit), "left_anti")
    again = written(again, "again")
    if again.isEmpty():
        return rest
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")
    once = docs.join(small(again), same_row(docs, again)).select(again["_doc"], again["_th"], whole).groupBy("_doc", "_th").agg(F.first("row").alias("row"))
    return rest.unionByName(once.select("row.*"))
