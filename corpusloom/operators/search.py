"""Keyword and vector search, the confidence gate and the joined context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences, query_tokens


def keyword_score(heading: Column, counts: Column, terms: list[str]) -> Column:
    """Coverage of the terms, their number, and whether the lower-case heading has one; at most 1, four digits, halves to the even one."""
    total, matched = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c), F.size(F.filter(counts, lambda c: c > 0))
    in_heading = F.lit(False)
    for t in terms:
        in_heading = in_heading | F.contains(heading, F.lit(t))
    score = F.lit(0.6) * matched / F.lit(len(terms)) + F.lit(0.2) * F.least(total / F.lit(5.0), F.lit(2.0)) + F.when(in_heading, 0.15).otherwise(0.0)
    return F.when(total > 0, F.bround(F.least(score, F.lit(1.0)), 4)).otherwise(0.0)


def keyword_search(chunks: DataFrame, query: str, k: int, key: str = "doc_id", heading: str = "heading", content: str = "content") -> DataFrame:
    """The k best rows with a score above 0, rank 1 first, ties by key: a bounded top-k, never a full sort."""
    terms = query_tokens(query)
    if not terms:
        return chunks.select(key).withColumns({"score": F.lit(0.0), "rank": F.lit(0)}).limit(0)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    # text, counts and score are steps of their own, each used more than once after, so each is computed once
    rows = chunks.select(key, low(heading).alias("_h"), F.concat(low(heading), F.lit(" "), low(content)).alias("_t"))
    rows = rows.select(key, "_h", F.array(*(occurrences(F.col("_t"), t) for t in terms)).alias("_c"))
    best = rows.select(key, keyword_score(F.col("_h"), F.col("_c"), terms).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def confident(hits: DataFrame, queries: DataFrame, most: float = 0.5) -> DataFrame:
    """For each query whether its nearest hit is nearer than a distance; without a hit it isn't, and the distance is null."""
    nearest = hits.groupBy("query_id").agg(F.min(1 - F.col("cos")).alias("_d"))
    return queries.select("query_id").join(nearest, "query_id", "left").select("query_id", F.coalesce(F.col("_d") < most, F.lit(False)).alias("confident"), F.round("_d", 6).alias("distance"))


def context(hits: DataFrame, texts: DataFrame, key: str, text: str, separator: str = "\n\n---\n\n") -> DataFrame:
    """For each query the texts of its hits, by rank, joined. Hits are few for each query."""
    rows = hits.join(texts.select(key, text), key)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), separator).alias("context"))
