"""Stores that grow: first writes that stay, an event log and its latest state, shards of vectors that can be written again and resumed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalised
from ..session import exists, names_in, remove, written
from ..sources.documents import read_latest, write_versioned


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The old rows and, of keys that they lack, the first new one by an order. A null is a key like others."""
    others = [c for c in old.columns if c != key]
    known = old.select(F.col(key).alias("_known"))
    first = new.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti").groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    return old.unionByName(first.select(key, *(F.col(f"_row.{c}").alias(c) for c in others)))


def import_outcomes(store: DataFrame, batch: DataFrame, key: str = "doc_id", digest: str = "content_hash") -> DataFrame:
    """key, outcome and the kept row of each row of a batch: in_store, in_batch (a smaller key of it has the content) or new.

    The first of each content is a minimum made before the shuffle, in the store and in the batch. A row without a digest
    has no content to compare: it is new, and kept itself.
    """
    kept = store.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(key).alias("_stored"))
    known = batch.where(F.col(digest).isNotNull())
    first = known.groupBy(digest).agg(F.min(key).alias("_first")).join(kept, digest, "left")
    rows = known.select(key, digest).join(first, digest)
    outcome = F.when(F.col("_stored").isNotNull(), "in_store").when(F.col("_first") < F.col(key), "in_batch").otherwise("new")
    out = rows.select(key, outcome.alias("outcome"), F.coalesce("_stored", "_first").alias("kept"))
    return out.unionByName(batch.where(F.col(digest).isNull()).select(key, F.lit("new").alias("outcome"), F.col(key).alias("kept")))


def latest_state(events: DataFrame, key: str, order: list[str], columns: list[str], at: str) -> DataFrame:
    """The state that a log of events leaves: the last value of each column, first and last time, and the number of changes.

    A null doesn't overwrite a value, as an update names only the columns that it changes.
    """
    place = F.struct(*order)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns]
    return events.groupBy(key).agg(*last, F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.count("*").alias("n_events"))


def batch_states(files: DataFrame, task: str, attempt: Column, failed: Column, most: int = 3) -> DataFrame:
    """For each task its files, those done, those to try again and those that failed for good, and its state."""
    rows = files.select(task, failed.alias("_f"), attempt.alias("_a"))
    out = rows.groupBy(task).agg(F.count("*").alias("n"), F.count_if(~F.col("_f")).alias("done"), F.count_if(F.col("_f") & (F.col("_a") < most)).alias("retry"), F.count_if(F.col("_f") & (F.col("_a") >= most)).alias("failed"))
    return out.withColumn("state", F.when(F.col("retry") > 0, "running").when(F.col("failed") == 0, "done").when(F.col("done") == 0, "failed").otherwise("partial"))


def shard_gaps(rows: DataFrame, index: str, total: int, size: int) -> DataFrame:
    """Shards of so many positions that lack rows: shard, wanted, found. A missing shard has found 0."""
    count = -(-total // size)
    wanted = rows.sparkSession.range(count).select(F.col("id").alias("shard"), F.least(F.lit(size), F.lit(total) - F.col("id") * size).alias("wanted"))
    found = rows.where(F.col(index).between(0, total - 1)).groupBy(F.floor(F.col(index) / size).alias("shard")).agg(F.count_distinct(index).alias("found"))
    return wanted.join(found, "shard", "left").select("shard", "wanted", F.coalesce("found", F.lit(0)).alias("found")).where("found < wanted")


def _finish(spark: SparkSession, path: str) -> None:
    """Brings in what a write has prepared, and notes it."""
    for name in names_in(spark, f"{path}/_pending"):
        pending = f"{path}/_pending/{name}"
        if exists(spark, f"{pending}/_SUCCESS"):
            spark.read.parquet(pending).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
            if name != "batch=none":
                note = spark.createDataFrame([(name.removeprefix("batch="),)], "batch string")
                note.coalesce(1).write.mode("overwrite").parquet(f"{path}/_batches/{name}")
        remove(spark, pending)


def write_shards(rows: DataFrame, path: str, index: str = "doc_index", size: int = 4096, batch: int | str | None = None) -> bool:
    """Puts rows into a folder of shards, one row an index: of rows that are there the new one stays. False if the batch was written before.

    What the touched shards will have is written beside them first; then only these shards are replaced. So a write that
    failed, wherever it did, is made good by the next one, and a repeated one changes nothing. An index that a write has
    several times is refused. One writer at a time.
    """
    spark, name = rows.sparkSession, f"batch={'none' if batch is None else batch}"
    _finish(spark, path)
    if batch is not None and exists(spark, f"{path}/_batches/{name}/_SUCCESS"):
        return False
    new = written(rows.withColumn("shard", F.floor(F.col(index) / size).cast("long")), "new-shards")
    n = new.agg(F.count("*").alias("n"), F.count_distinct(index).alias("d")).first()
    if n["n"] != n["d"]:
        raise ValueError("an index comes several times, or is null")
    whole = new
    if any(x.startswith("shard=") for x in names_in(spark, path)):
        old = spark.read.schema(new.schema).parquet(path)
        touched = old.join(new.select("shard").distinct(), "shard", "left_semi").join(new.select(index), index, "left_anti")
        whole = new.unionByName(touched)
    whole.repartition("shard").write.mode("overwrite").parquet(f"{path}/_pending/{name}")
    _finish(spark, path)
    return True


def read_shards(rows: DataFrame, total: int, index: str = "doc_index", size: int = 4096, vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """index and vector (of unit length) of a complete set of shards: each index once, all vectors of one size; else an error tells."""
    lacking = [r["shard"] for r in shard_gaps(rows, index, total, size).orderBy("shard").limit(20).collect()]
    if lacking:
        raise ValueError(f"shards without all their rows: {lacking}")
    inside = rows.where((F.col(index) >= 0) & (F.col(index) < total))
    sizes = F.when(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()), F.size(vector)).otherwise(-1)
    found = inside.agg(F.count("*").alias("n"), F.min(sizes).alias("low"), F.max(sizes).alias("high")).first()
    if found["n"] != total:
        raise ValueError(f"there are {found['n']} rows for {total} indexes")
    if total and (found["low"] != found["high"] or found["low"] < 0 or dim not in (None, found["low"])):
        raise ValueError(f"vectors have from {found['low']} to {found['high']} components, not {dim or 'one number of them'}")
    return inside.select(index, normalised(F.col(vector)).alias(vector))


def record(path: str, changes: DataFrame, key: str, at: str, columns: list[str], batch: int | str) -> bool:
    """Adds changes to a log of events, once a batch. They name the columns that they change, which the log must have; others stay as they were."""
    spark, names = changes.sparkSession, [c for c in changes.columns if c not in (key, at)]
    unknown = sorted(set(names) - set(columns))
    if unknown or not names:
        raise ValueError(f"no columns of the log: {unknown}" if unknown else "a change must name a column")
    target = f"{path}/batch={batch}"
    if exists(spark, f"{target}/_SUCCESS"):
        return False
    changes.select(key, at, F.array(*map(F.lit, names)).alias("changed"), *(F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").parquet(target)
    return True


#: Rows of a leaf, and digests of a node, of a digest of rows in order.
LEAF = 4096


def ordered_digest(rows: DataFrame, index: str, *values: str, upto: int | None = None) -> str:
    """A digest of values in the order of an index from 0, or of the first so many: a tree of digests of LEAF each.

    No task has more than LEAF rows or digests together, and it doesn't depend on how rows are dealt. Nulls count, and
    differ from empty strings.
    """
    if upto is not None:
        rows = rows.where(F.col(index) < upto)
    one = F.sha2(F.concat_ws("\0", F.col(index).cast("string"), *(F.coalesce(F.concat(F.lit("="), F.col(v).cast("string")), F.lit("-")) for v in values)), 256)
    level = rows.select(F.col(index).cast("long").alias("i"), one.alias("d"))
    while True:
        last = level.agg(F.max("i")).first()[0]
        if last is None:
            return hashlib.sha256(b"").hexdigest()
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"])
        level = written(level.groupBy(F.floor(F.col("i") / LEAF).cast("long").alias("i")).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("d")), "digests")
        if last < LEAF:
            return level.first()["d"]


class Changed(ValueError):
    """What was encoded before doesn't fit what is to be encoded now."""


def guard(rows: DataFrame, path: str, settings: dict, index: str, *values: str) -> dict:
    """The state under which rows are encoded, written if it is new or extends what is known: settings, n, digest, version.

    Other settings, fewer rows, and other or reordered rows among those known are refused, as results would be mixed.
    """
    spark, want = rows.sparkSession, json.dumps(settings, sort_keys=True)
    n = rows.count()
    known = read_latest(spark, path, seed=spark.createDataFrame([], "settings string, n long, digest string, version int")).first()
    if known:
        if known["settings"] != want:
            old = json.loads(known["settings"])
            raise Changed("settings changed: " + ", ".join(f"{k} from {old.get(k)!r} to {settings.get(k)!r}" for k in sorted({*old, *settings}) if old.get(k) != settings.get(k)))
        if n < known["n"] or ordered_digest(rows, index, *values, upto=known["n"]) != known["digest"]:
            raise Changed(f"the first {known['n']} rows are no longer the same, or not in the same order")
        if n == known["n"]:
            return {"settings": settings, "n": n, "digest": known["digest"], "version": known["version"]}
    state = {"settings": want, "n": n, "digest": ordered_digest(rows, index, *values)}
    version = known["version"] + 1 if known else 1
    write_versioned(spark.createDataFrame([tuple(state.values())], "settings string, n long, digest string"), path, version)
    return state | {"settings": settings, "version": version}


def encode_resumable(rows: DataFrame, path: str, settings: dict, encode: Callable[[DataFrame], DataFrame], cache: DataFrame | None = None, index: str = "doc_index", key: str = "cache_key", size: int = 4096, most: int | None = None) -> dict:
    """Encodes what a folder of shards lacks, after the guard has let it; at most so many shards. Returns total, before, new and complete.

    rows: index (from 0), key and what encode needs. Each call brings in whole shards under a batch of their own, so one
    that stops half-way is taken up where it was. The state is kept in the folder ``_state`` beside the shards.
    """
    spark = rows.sparkSession
    state = guard(rows, f"{path}/_state", settings | {"shard_size": size}, index, key)
    _finish(spark, path)
    empty = spark.createDataFrame([], f"{index} long, embedding array<double>")
    done = spark.read.parquet(path).select(index, "embedding") if any(x.startswith("shard=") for x in names_in(spark, path)) else empty
    before = done.where(F.col(index) < state["n"]).count()
    gaps = written(shard_gaps(done, index, state["n"], size), "gaps")
    todo = gaps.orderBy("shard").limit(most).select("shard") if most is not None else gaps.select("shard")
    wanted = rows.withColumn("shard", F.floor(F.col(index) / size).cast("long")).join(todo, "shard", "left_semi").drop("shard")
    cache = cache if cache is not None else spark.createDataFrame([], f"{key} string, embedding array<double>")
    made = written(resume(wanted, done, cache, encode, index, key).select(index, "embedding"), "encoded")
    new = made.count()
    if new != wanted.join(done.select(index), index, "left_anti").count():
        raise ValueError("the encoder left rows out")
    if new:
        write_shards(made, path, index, size)
    return {"total": state["n"], "before": before, "new": new, "complete": before + new == state["n"]}


def resume(rows: DataFrame, done: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame], index: str = "doc_index", key: str = "cache_key", vector: str = "embedding") -> DataFrame:
    """index, key, vector and source of rows that ``done`` lacks: from the cache where it has their content, else encoded.

    Each distinct content is encoded once, whatever the number of rows that have it.
    """
    open_ = rows.join(done.select(index), index, "left_anti")
    known = cache.select(key, F.col(vector).alias("_kept")).dropDuplicates([key])
    split = open_.join(known, key, "left")
    misses = split.where("_kept IS NULL").drop("_kept")
    made = encode(misses.dropDuplicates([key])).select(key, vector)
    hits = split.where("_kept IS NOT NULL").select(index, key, F.col("_kept").alias(vector), F.lit("cache").alias("source"))
    return hits.unionByName(misses.select(index, key).join(made, key).select(index, key, vector, F.lit("encoder").alias("source")))


def expected_chunks(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """id and chunk_id of the chunks that answer a query: by their id, or by a document and, where one is named, its heading.

    queries: id, chunk_ids, document_id, heading and acceptable (array of document_id, heading). A heading fits if it is
    the chunk's, or stands in it or in the text. Rules are equal joins whose rows are united, not one join with alternatives.
    A query's own ids rule out its document only for these chunks, which they name already, so all may be united.
    """
    by_id = queries.select("id", F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id").select("id", "chunk_id")
    named = F.filter(F.concat(F.array(F.struct("document_id", "heading")), F.coalesce("acceptable", F.array().cast("array<struct<document_id:string,heading:string>>"))), lambda x: F.coalesce(x["document_id"], F.lit("")) != "")
    asked = queries.select("id", F.inline(named)).select("id", "document_id", F.coalesce("heading", F.lit("")).alias("_h"))
    held = chunks.select("chunk_id", "document_id", F.coalesce("heading", F.lit("")).alias("_own"), F.coalesce("content", F.lit("")).alias("_text"))
    fits = (F.col("_h") == "") | F.contains("_own", F.col("_h")) | F.contains("_text", F.col("_h"))
    by_place = asked.join(held, "document_id").where(fits).select("id", "chunk_id")
    return by_id.unionByName(by_place).distinct()


def misses(queries: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """Queries whose first right hit isn't among the first k, with its rank (null: none). ranks: id, rank of right hits."""
    first = ranks.groupBy("id").agg(F.min("rank").alias("rank"))
    return queries.join(first, "id", "left").where(F.col("rank").isNull() | (F.col("rank") > k))
