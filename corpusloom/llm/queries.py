"""The queries of this package, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, bpe, decontaminate, divergence, licences, lines, near, packing, pages, quality, rules, thresholds, treaps


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_from_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by way of ARC into WARC archives and back."""
    return archives.round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.main_texts(_read(spark, sf_dir, "pages"))


def op3_licence_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return licences.licence_labels(_read(spark, sf_dir, "documents"))


def op4_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return bpe.token_counts(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048."""
    return packing.packed(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the lines that a line before resembles, and the text without them."""
    docs, text = _read(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = lines.without_lines(docs.select("doc_id", "text", (breaks + 1).cast("long").alias("n_lines")))
    return rows.select("doc_id", "n_lines", F.size(F.coalesce("removed", F.array().cast("array<int>"))).cast("long").alias("n_removed"), "removed", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars_kept"), F.sha1(F.coalesce("text", F.lit(""))).alias("text_sha1"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and the number of links of every document."""
    return near.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op9_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, and the verdict of the current policy."""
    rows = rules.verdicts(rules.ledger(_read(spark, sf_dir, "documents")))
    base = ~rules.passes("failed", rules.BASE_MASK)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), rules.passes("failed", rules.POLICIES[rules.CURRENT]).alias("kept"), "failed", *(f"kept_v{v}" for v in rules.POLICIES))


def op11_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the greatest inner product with every 20th vector."""
    return thresholds.top_products(_read(spark, sf_dir, "embeddings"))


def op12_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return treaps.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_group_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language diverge, and their most telling terms."""
    return divergence.divergences(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    return {f.__name__: f for f in (op1_warc_from_arc, op2_host_suffix_array, op3_licence_templates, op4_piece_tokens, op5_first_fit_packing, op6_winnowing, op7_line_join, op8_ngram_join, op9_subword_quality, op10_rule_ledger, op11_uniform_threshold, op12_inverted_treaps, op13_group_tiles)}


#: WARC digests are the base32 of SHA-1: 8 times 5 hexadecimal digits make 4 letters.
_OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top, count(*) AS n FROM p GROUP BY d),
q AS (SELECT page_id, h, top, list_transform(range(0, 8), lambda k: CAST('0x' || substr(p.d, 1 + 5 * CAST(k AS INT), 5) AS INTEGER)) AS v FROM p JOIN m ON p.d = m.d)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((x >> 15) & 31 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((x >> 10) & 31 AS INT), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((x >> 5) & 31 AS INT), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(x & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to
FROM q
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the queries' names."""
    return {"op1_warc_from_arc": _OP1_SQL, "op6_winnowing": decontaminate.SQL, "op11_uniform_threshold": thresholds.SQL, "op12_inverted_treaps": treaps.SQL, "op13_group_tiles": divergence.SQL}
