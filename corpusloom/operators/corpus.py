"""Corpus upkeep: listings, exact duplicates, strata quotas and samples, manifests, caches, imports, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def page(rows: DataFrame, order: list, number: int, size: int, most: int = 200) -> DataFrame:
    """A page of a listing, from 1. The order must be total."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def where_equal(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows with these values; an empty value doesn't filter."""
    for name, value in wanted.items():
        if value not in (None, ""):
            rows = rows.where(F.col(name) == value)
    return rows


def title_contains(rows: DataFrame, word: str, column: str = "title") -> DataFrame:
    """Rows whose title has a word, whatever its case."""
    return rows.where(F.contains(F.lower(column), F.lit(word.lower())))


def has_tag(rows: DataFrame, tag: str, column: str = "tags") -> DataFrame:
    """Rows with a tag, whatever its case."""
    return rows.where(F.exists(column, lambda t: F.lower(t) == tag.lower()))


def exact_duplicates(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, content_hash, duplicate_of: the first row by key with equal text, null for the first itself.

    The first of each hash is a minimum made before the shuffle; only hashes with several rows are joined back.
    A missing text has the hash of an empty one, but is a copy of missing ones alone.
    """
    hashed = rows.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"), F.col(text).isNull().alias("_none"))
    first = hashed.groupBy("content_hash", "_none").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = hashed.join(first, ["content_hash", "_none"], "left")
    return same.select(key, "content_hash", F.when(F.col("first") != F.col(key), F.col("first")).alias("duplicate_of"))


def quotas(rows: DataFrame, strata: list[str], total: int, floor: int = 1) -> DataFrame:
    """The strata with n and quota: a floor each, the rest in proportion, what is left to the largest remainders.

    Strata are few; their counts are made before the shuffle.
    """
    counts = rows.groupBy(*strata).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    counts = counts.withColumn("_base", F.least(F.lit(floor), F.col("n"))).withColumn("_left", F.lit(total) - F.sum("_base").over(whole))
    counts = counts.withColumn("_share", F.greatest(F.col("_left"), F.lit(0)) * (F.col("n") - F.col("_base")) / F.greatest(F.sum(F.col("n") - F.col("_base")).over(whole), F.lit(1)))
    counts = counts.withColumn("_down", F.floor("_share")).withColumn("_rest", F.greatest(F.col("_left"), F.lit(0)) - F.sum("_down").over(whole))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("_share") - F.col("_down"), 9)), *strata))
    return counts.withColumn("_more", F.when(rank <= F.col("_rest"), 1).otherwise(0)).select(*strata, "n", F.least("n", F.col("_base") + F.col("_down") + F.col("_more")).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, strata: list[str], total: int, key: str, seed: str = "seed", floor: int = 1) -> DataFrame:
    """Rows of each stratum up to its quota, those first by a seeded hash of the key.

    Rows are counted by the hash's first four digits, before the shuffle; the counts tell in which of these slices
    a quota ends. Slices below it are taken whole, and only that one is ranked, so no stratum is ranked as a whole
    and none falls short.
    """
    plan = quotas(rows, strata, total, floor)
    hashed = rows.select(key, *strata, F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))).alias("_h")).withColumn("_slice", F.substring("_h", 1, 4))
    counts = hashed.groupBy(*strata, "_slice").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*strata).orderBy("_slice")) - F.col("_n"))  # at most 65,536 slices a stratum
    cut = counts.join(plan.select(*strata, "quota"), strata).where("_before < quota").select(*strata, "_slice", (F.col("quota") - F.col("_before")).alias("_left"), "_n")
    near = hashed.join(cut, [*strata, "_slice"])
    rank = F.row_number().over(Window.partitionBy(*strata, "_slice").orderBy("_h", key))
    last = near.where("_left < _n").withColumn("_rank", rank).where("_rank <= _left")
    return near.where("_left >= _n").select(key, *strata).unionByName(last.select(key, *strata))


def manifest(rows: DataFrame, path: str, old: DataFrame | None = None) -> DataFrame:
    """doc_index and path: rows of an old manifest as they are, new ones after them by path. A null is a path like others.

    New paths are dealt by ranges and written once, each with its partition and its place there; a partition's rows
    are counted from what was written, and its offset is added. So counts and rows can't differ.
    """
    fresh = rows.select(path).distinct()
    start = 0
    if old is not None:
        old = load_manifest(old, path)
        fresh = fresh.join(old.select(F.col(path).alias("_known")), F.col(path).eqNullSafe(F.col("_known")), "left_anti")
        start = old.count()
    dealt = fresh.repartitionByRange(path).sortWithinPartitions(path)
    dealt = written(dealt.select(path, F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")), "manifest")
    sizes = {r["_p"]: r["n"] for r in dealt.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a partition
    offsets, at = [], start
    for p in sorted(sizes):
        offsets.append((p, at))
        at += sizes[p]
    known = rows.sparkSession.createDataFrame(offsets, "_p int, _at long")
    new = dealt.join(F.broadcast(known), "_p").select((F.col("_at") + F.col("_i")).alias("doc_index"), path)
    return old.unionByName(new) if old is not None else new


def load_manifest(rows: DataFrame, path: str) -> DataFrame:
    """doc_index and path of a manifest, written once; an error where its indexes have a gap or repeat."""
    rows = written(rows.select("doc_index", path), "old-manifest")
    if not contiguous(rows).first()["ok"]:
        raise ValueError("the manifest's indexes do not run from 0 without a gap")
    return rows


def contiguous(rows: DataFrame) -> DataFrame:
    """n, distinct and last index, and whether the manifest's indexes run from 0 without a gap."""
    return rows.agg(F.count("*").alias("n"), F.countDistinct("doc_index").alias("n_distinct"), F.max("doc_index").alias("last")).withColumn("ok", (F.col("n") == F.col("n_distinct")) & (F.coalesce("last", F.lit(-1)) + 1 == F.col("n")))


def cache_split(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Rows whose key the cache has, and those that it lacks."""
    known = cache.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, vector: str = "embedding", blank: tuple[str, ...] = ()) -> DataFrame:
    """For each key the row latest by an order, of equal ones a new one; vectors of several sizes are refused.

    Nulls of the columns ``blank`` are stored as empty strings.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    sizes = [r[0] for r in both.select(F.size(vector).alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors have several sizes")
    both = both.withColumns({c: F.coalesce(c, F.lit("")) for c in blank})
    others = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(order, "_new")).alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in others))


def unblanked(rows: DataFrame, *columns: str) -> DataFrame:
    """Empty strings of columns as nulls again."""
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def upload_error(name: Column, size: Column, most: int, suffixes: list[str]) -> Column:
    """A stable code for a file that can't be taken; null if it can."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE").when(size > most, "FILE_TOO_LARGE").when(~suffix.isin(suffixes), "UNSUPPORTED_TYPE")


def import_state(classification: Column, duplicate_of: Column) -> Column:
    """duplicate, classified or unclassified; UNKNOWN counts as unclassified."""
    return F.when(duplicate_of.isNotNull(), "duplicate").when(classification.isin("ASSIGNED", "PARTIAL", "FALLBACK"), "classified").otherwise("unclassified")


def progress(rows: DataFrame, task: str, state: str, done: list[str], failed: list[str]) -> DataFrame:
    """For each task: files, those done, those failed, and percent of both, one digit."""
    counts = rows.groupBy(task).agg(F.count("*").alias("total"), F.count_if(F.col(state).isin(done)).alias("done"), F.count_if(F.col(state).isin(failed)).alias("failed"))
    return counts.withColumn("percent", F.round((F.col("done") + F.col("failed")) * 100.0 / F.greatest("total", F.lit(1)), 1))


def profile(rows: DataFrame, by: str, size: Column, percents: tuple[int, ...] = (5, 25, 50, 75, 90, 99)) -> DataFrame:
    """Rows, bytes and percentiles of the size by source; a percentile is the sorted sizes' entry n * p // 100, from 0.

    Equal sizes are counted before the shuffle, so a source has a row for each size, not for each file.
    """
    sizes = rows.select(by, size.cast("long").alias("_size")).where("_size IS NOT NULL").groupBy(by, "_size").agg(F.count("*").alias("_n"))
    whole, upto = Window.partitionBy(by), Window.partitionBy(by).orderBy("_size")
    sizes = sizes.select(by, "_size", "_n", F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    at = lambda p: F.least(F.floor(F.col("_all") * p / 100), F.col("_all") - 1)
    return sizes.groupBy(by).agg(F.sum("_n").alias("n"), F.sum(F.col("_size") * F.col("_n")).alias("bytes"), *(F.min(F.when(F.col("_upto") > at(p), F.col("_size"))).alias(f"p{p}") for p in percents))


def compared(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """old, new and change of a value by key, 0 where a side lacks it."""
    a, b = old.select(key, F.col(value).alias("old")), new.select(key, F.col(value).alias("new"))
    rows = a.join(b, key, "full_outer").select(key, F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("new", F.lit(0)).alias("new"))
    return rows.withColumn("change", F.col("new") - F.col("old"))


def suffix_counts(rows: DataFrame, path: str) -> DataFrame:
    """Files by lower-case suffix, with its dot; empty for names without one."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return rows.groupBy(F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix")).agg(F.count("*").alias("n"))


def candidates(files: DataFrame, path: str, size: str, suffixes: list[str], least: int = 200) -> DataFrame:
    """Files with a wanted suffix and at least so many bytes, but none at the root."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return files.where(suffix.isin(suffixes) & (F.col(size) >= least) & F.contains(F.col(path), F.lit("/")))


def uniform_sample(rows: DataFrame, total: int, key: str, seed: str = "seed") -> DataFrame:
    """So many rows, those first by a seeded hash of the key: a bounded top, never a full sort."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(total)


def verified_files(files: DataFrame, path: str, content: str, digest: str, suffixes: list[str], most: int) -> Column:
    """Why a file of a manifest can't be taken: its path, type, size or digest; null if it can."""
    suffix, size = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.coalesce(F.octet_length(content), F.lit(0))
    unsafe = F.startswith(F.col(path), F.lit("/")) | F.array_contains(F.split(path, "/"), "..")
    return F.when(unsafe, "UNSAFE_PATH").when(~suffix.isin(suffixes), "UNSUPPORTED_TYPE").when(size == 0, "EMPTY_FILE").when(size > most, "FILE_TOO_LARGE").when(F.sha2(content, 256) != F.col(digest), "HASH_MISMATCH")
