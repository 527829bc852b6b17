"""Retrieval quality: first hits, hit rates and mean reciprocal rank, overall and by category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(hits: DataFrame, truth: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """The queries with the rank of their first relevant hit, null for none."""
    found = hits.join(truth.select("query_id", key), ["query_id", key], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.join(found, "query_id", "left")


def quality(ranked: DataFrame, category: str) -> DataFrame:
    """n, hit rates at 1, 3 and 5 and mean reciprocal rank, for each category and (null) for all, in one pass."""
    hit = {f"hit_{k}": F.round(F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int")), 6).alias(f"hit_{k}") for k in (1, 3, 5)}
    return ranked.rollup(category).agg(F.count("*").alias("n"), *hit.values(), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


def integrity(queries: DataFrame, documents: DataFrame, key: str, text: str, category: str, expected: str, known: list) -> DataFrame:
    """problem and n: repeated keys, repeated texts, unknown categories, and expected documents that aren't there.

    Every problem has a row, with 0 where it doesn't occur. ``documents`` has the column ``expected``.
    """
    one = queries.agg(
        (F.count(key) - F.count_distinct(key)).alias("repeated_key"),
        (F.count(text) - F.count_distinct(text)).alias("repeated_text"),
        F.count_if(~F.coalesce(F.col(category).isin(known), F.lit(False))).alias("unknown_category"),
    )
    lost = queries.join(documents.select(expected), expected, "left_anti").agg(F.count("*").alias("missing_document"))
    wide = one.join(lost)  # one row each
    return wide.select(F.explode(F.create_map(*(x for c in wide.columns for x in (F.lit(c), F.col(c))))).alias("problem", "n"))


def problems(queries: DataFrame, documents: DataFrame, categories: list[str], difficulties: list[str]) -> DataFrame:
    """id, problem and what of everything that is wrong with a set of evaluation queries, a row each.

    queries: id, query, category, difficulty, expected_document_id, expected_source_path, expected_heading,
    expected_evidence (array) and acceptable_documents (array of document_id, heading). documents: document_id,
    source_path and content. An id or query that comes n times has n rows. Documents, headings and pieces of evidence are
    looked up by equal joins; a text is read once for all that is expected of it.
    """
    asked = queries.select("id", "query", "category", "difficulty", "expected_document_id", "expected_source_path", "expected_heading", "expected_evidence", "acceptable_documents")
    out = []
    for c, name in (("id", "repeated id"), ("query", "repeated query")):
        again = asked.groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(c).alias("_again"))
        out.append(asked.join(again, F.col(c).eqNullSafe(F.col("_again"))).select("id", F.lit(name).alias("problem"), F.col(c).alias("what")))
    for c, known in (("category", categories), ("difficulty", difficulties)):
        out.append(asked.where(~F.coalesce(F.col(c).isin(known), F.lit(False))).select("id", F.lit(f"unknown {c}").alias("problem"), F.col(c).alias("what")))
    expected = asked.select("id", F.lit("document").alias("kind"), F.col("expected_document_id").alias("document_id"), F.array(F.struct(F.lit("heading").alias("kind"), F.col("expected_heading").alias("text"))).alias("own"), F.transform(F.coalesce("expected_evidence", F.array().cast("array<string>")), lambda x: F.struct(F.lit("evidence").alias("kind"), x.alias("text"))).alias("more"), F.col("expected_source_path").alias("path"))
    other = asked.select("id", F.inline("acceptable_documents")).select("id", F.lit("acceptable document").alias("kind"), "document_id", F.array(F.struct(F.lit("acceptable heading").alias("kind"), F.col("heading").alias("text"))).alias("own"), F.array().cast("array<struct<kind:string,text:string>>").alias("more"), F.lit(None).cast("string").alias("path"))
    wanted = expected.unionByName(other).select("id", "kind", "document_id", F.concat("own", "more").alias("texts"), "path")
    there = documents.select("document_id", F.col("source_path").alias("_path"), F.coalesce("content", F.lit("")).alias("_content"), F.lit(True).alias("_there"))
    met = wanted.join(there, "document_id", "left")
    out.append(met.where("_there IS NULL").select("id", F.concat(F.lit("missing "), "kind").alias("problem"), F.col("document_id").alias("what")))
    out.append(met.where("_there AND kind = 'document' AND NOT (path <=> _path)").select("id", F.lit("other source path").alias("problem"), F.col("path").alias("what")))
    lacking = met.where("_there").select("id", F.inline(F.filter("texts", lambda x: ~F.coalesce(F.contains(F.col("_content"), x["text"]), F.lit(False)))))
    out.append(lacking.select("id", F.concat(F.col("kind"), F.lit(" not in document")).alias("problem"), F.col("text").alias("what")))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.distinct()


def source_manifest(queries: DataFrame, files: DataFrame) -> DataFrame:
    """source_path, content_hash, query_ids, expected_headings (both sorted) and expected_evidence (by query id) of each file that queries expect.

    files: source_path and content (bytes). A path that is blank, absolute or leads upwards, and one without a file, is refused.
    """
    asked = queries.select(F.trim(F.coalesce("expected_source_path", F.lit(""))).alias("source_path"), F.col("id").cast("string").alias("id"), "expected_heading", "expected_evidence")
    unsafe = (F.col("source_path") == "") | F.startswith("source_path", F.lit("/")) | F.array_contains(F.split("source_path", "/"), "..")
    bad = [r["id"] for r in asked.where(unsafe).select("id").limit(20).collect()]
    if bad:
        raise ValueError(f"queries whose source path can't be taken: {bad}")
    hashed = files.select("source_path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"))
    lost = [r["source_path"] for r in asked.select("source_path").distinct().join(hashed, "source_path", "left_anti").limit(20).collect()]
    if lost:
        raise ValueError(f"there is no file for {lost}")
    evidence = F.when(F.size("expected_evidence") > 0, F.struct("id", "expected_evidence"))
    rows = asked.groupBy("source_path").agg(F.array_sort(F.collect_list("id")).alias("query_ids"), F.array_sort(F.collect_set(F.nullif("expected_heading", F.lit("")))).alias("expected_headings"), F.map_from_entries(F.array_sort(F.collect_list(evidence))).alias("expected_evidence"))
    return rows.join(hashed, "source_path").select("source_path", "content_hash", "query_ids", "expected_headings", "expected_evidence")
