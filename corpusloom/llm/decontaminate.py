"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are those of A-Z lower-cased texts. Each run of K words is hashed; the least hash of each SPAN - K + 1 runs
in a row is the fingerprint of that window of SPAN words. Windows in a row with one fingerprint are one row, about
two for seven words; these rows are joined with the items' fingerprints. The least of a window depends on its words
alone, so a window that a document shares with an item has the same fingerprint in both: none is missed. Where
fingerprints meet, the hit is extended: each window of the row is compared by the SHA-256 of its words, so equal
hashes of different words are no hit.

Items of fewer than SPAN words, but not none, are one window, whose fingerprint is the hash of all its words. All
lengths are looked for in one pass over the documents, which aren't shuffled: fingerprints and windows have rows of
fixed size, are broadcast up to a proven bound, and joined by a shuffle beyond it. Windows with the same items share
a class, and documents with the same classes share one count and digest of items, so a passage that is common in
items and documents alike isn't multiplied.

Nulls and empty texts have no words; a null item_id is an item, which counts, without a name in the digest. Rows that
repeat a doc_id with the same text give as many equal rows; with other texts each row has its own result. Very long
texts are taken whole. Empty tables: no document, no row; no item, no hit. Other columns of docs stay in clean(),
whatever their names, and aren't carried elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written

SPAN, K = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what isn't in [\x00-\x2F\x3A-\x60\x7B-\x7F].
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words. lower() does the same as A-Z to a-z where a text is ASCII, and is much faster."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def hashes(w: Column) -> Column:
    """A hash for each word."""
    return F.transform(w, lambda x: F.xxhash64(x))


def _rest(a: str, skip: int) -> Column:
    return F.slice(F.col(a), skip + 1, F.greatest(F.size(a) - skip, F.lit(0)))


def _joined(a: str, b: str, skip: int) -> Column:
    """Hashes of runs: of a, and of b so many places on."""
    return F.zip_with(F.col(a), _rest(b, skip), lambda x, y: F.xxhash64(x, y))


def _least(a: str, b: str, skip: int) -> Column:
    return F.zip_with(F.col(a), _rest(b, skip), lambda x, y: F.least(x, y))


def _range(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _part(a: str, first: Column, last: Column) -> Column:
    """Elements of an array; slice() in a lambda would go through all of it."""
    return F.transform(F.sequence(first, last), lambda k: F.get(a, k))


def _row(f: Column, at: Column, length: Column, part: Column) -> Column:
    return F.struct(f.alias("f"), at.cast("int").alias("at"), length.cast("int").alias("length"), part.alias("part"))


def _runs(length: int) -> Column:
    """An entry for each window of a length, from columns w, h and run."""
    return F.transform(_range(F.size("h") - (length - 1)), lambda i: _row(F.get("run", i), i, F.lit(length), _part("w", i, i + (length - 1))))


def fingerprints(rows: DataFrame, keys: list[str], short: list[int]) -> DataFrame:
    """keys and ``r``, an array of (f, at, length, part), from columns w (words) and h (their hashes).

    Each entry stands for the windows of ``length`` words in ``part``, whose first word is ``at``; f is what they
    have in common. Lengths below SPAN have an entry for each window. Each step uses its arrays at least twice, so
    the optimizer computes each once; r must be taken apart by an ``_outer`` generator, as for others the optimizer
    makes a filter of what they take apart and computes it anew below all steps.
    """
    if (SPAN, K) != (10, 5):
        raise ValueError("the steps are those of windows of 10 and runs of 5")
    n = F.greatest(F.size("h") - (SPAN - 1), F.lit(0))
    rows = rows.select(*keys, "w", "h", _joined("h", "h", 1).alias("h2"))
    rows = rows.select(*keys, "w", "h", _joined("h2", "h2", 2).alias("h4"))
    rows = rows.select(*keys, "w", "h", _joined("h4", "h", 4).alias("g"))
    rows = rows.select(*keys, "w", "h", _least("g", "g", 1).alias("m2"))
    rows = rows.select(*keys, "w", "h", "m2", _least("m2", "m2", 2).alias("m4"))
    rows = rows.select(*keys, "w", "h", n.alias("n"), F.slice(_least("m4", "m2", 4), F.lit(1), n).alias("f"))
    first = F.filter(_range(F.col("n")), lambda i: (i == 0) | (F.get("f", i) != F.get("f", i - 1)))
    rows = rows.select(*keys, "w", "h", "n", "f", first.alias("i"))
    after = F.concat(_rest("i", 1), F.slice(F.array("n"), F.lit(1), F.least(F.size("i"), F.lit(1))))
    found = F.zip_with("i", after, lambda a, b: _row(F.get("f", a), a, F.lit(SPAN), _part("w", a, b + (SPAN - 2))))
    rows = rows.select(*keys, "w", "h", found.alias("r"))
    for length in short:
        rows = rows.select(*keys, "w", "h", "r", F.col("h").alias("run"))
        for i in range(1, length):
            rows = rows.select(*keys, "w", "h", "r", _joined("run", "h", i).alias("run"))
        rows = rows.select(*keys, "w", "h", F.concat("r", _runs(length)).alias("r"))
    return rows.select(*keys, "r")


def _windows(length: Column, at: Column, part: Column) -> Column:
    """(at, key) of each window in a part."""
    return F.transform(_range(F.size(part) - length + 1), lambda k: F.struct((at + k).alias("at"), F.unhex(F.sha2(F.array_join(F.slice(part, k + 1, length), " "), 256)).alias("key")))


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """key, f, class and items (sorted; a struct of the name each) of each distinct window, written; and the lengths below SPAN."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    items = items.select("item", "w", hashes(F.col("w")).alias("h"), F.size("w").alias("size"))
    short = sorted(r["size"] for r in items.where((F.col("size") > 0) & (F.col("size") < SPAN)).select("size").distinct().collect())  # below SPAN
    rows = fingerprints(items, ["item", "size"], short).select("item", "size", F.inline_outer("r")).where((F.col("length") == SPAN) | (F.col("length") == F.col("size")))
    rows = rows.select("item", "f", F.inline(_windows(F.col("length"), F.col("at"), F.col("part"))))
    rows = rows.groupBy("key", "f").agg(F.array_sort(F.collect_set(F.struct("item"))).alias("items"))
    return written(rows.withColumn("class", F.unhex(F.sha2(F.to_json("items"), 256))), "item-windows"), short


def hits(docs: DataFrame, windows: DataFrame, short: list[int]) -> DataFrame:
    """doc_id, th (hash of the text), n_words, copies, n_hit and classes (sorted) of each distinct row of docs, written."""
    keys = ["doc_id", "th", "n_words"]
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "th", F.size("w").alias("n_words"), "w", hashes(F.col("w")).alias("h"))
    # one entry a row of docs that no window has; its f and key aren't null, as nulls would meet in one task of a join
    own = _row(F.xxhash64("doc_id", "th"), F.lit(-1), F.lit(0), F.array().cast("array<string>"))
    rows = fingerprints(rows, keys, short).select(*keys, F.explode_outer(F.concat(F.array(own), F.col("r"))).alias("r"))
    known = small(written(windows.select("f").distinct(), "fingerprints")).withColumn("known", F.lit(True))
    rows = rows.select(*keys, "r", F.col("r.f").alias("f")).join(known, "f", "left").where("known OR r.at < 0").select(*keys, "r.at", "r.length", "r.part")
    own = F.array(F.struct(F.lit(-1).alias("at"), F.unhex(F.sha2(F.concat_ws("\n", F.lit(""), F.col("th").cast("string")), 256)).alias("key")))
    rows = rows.select(*keys, "length", F.explode_outer(F.when(F.col("at") < 0, own).otherwise(_windows(F.col("length"), F.col("at"), F.col("part")))).alias("x")).select(*keys, "length", "x.at", "x.key")
    rows = rows.join(small(written(windows.select("key", "class"), "windows")), "key", "left").where("class IS NOT NULL OR at < 0")
    place = F.when(F.col("at") >= 0, F.struct("at", "length"))
    rows = rows.groupBy(*keys).agg(F.collect_set(place).alias("places"), F.collect_set("class").alias("classes"), F.sum((F.col("at") < 0).cast("int")).alias("copies"))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["length"] - 1))))
    return written(rows.select(*keys, "copies", F.size(covered).alias("n_hit"), F.array_sort("classes").alias("classes")), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    windows, short = item_windows(benchmark)
    found = hits(docs, windows, short)
    sets = found.where("n_hit > 0").select("classes").distinct()
    items = windows.select("class", "items").dropDuplicates(["class"])
    named = sets.select("classes", F.explode("classes").alias("class")).join(items, "class").select("classes", F.explode("items").alias("one"))
    named = named.groupBy("classes").agg(F.array_sort(F.collect_set("one")).alias("items"))
    named = written(named.select("classes", F.size("items").alias("n_items"), F.sha2(F.array_join("items.item", ","), 256).alias("sha")), "item-sets")
    rows = found.join(small(named), "classes", "left")
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    found = hits(docs, *item_windows(benchmark)).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    found = small(written(found, "contaminated"))
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_th"])
    return docs.join(found, same, "left_anti")


#: The contract in DuckDB's SQL: windows as strings, compared exactly.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
