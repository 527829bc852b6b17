"""Conversation turns and memories: recent turns, context frames, hydration, decisions on duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import top_k_within
from ..session import written


def recent_turns(turns: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n turns of each conversation.

    The rank's bound is applied before the shuffle too, so of a very long conversation each task sends n rows.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return turns.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def numbered(turns: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The turns with ``_n``, their place in their conversation from 0, written.

    Turns are dealt by ranges of conversation and order, so a long conversation spreads over tasks; a turn's place is the
    one in its part plus what earlier parts have of the conversation. Only counts of parts are brought together.
    """
    dealt = turns.repartitionByRange(by, order).sortWithinPartitions(by, order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(dealt.select("*", F.spark_partition_id().alias("_p"), at.alias("_i")), "turns")
    parts = dealt.groupBy(by, "_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_first"))
    before = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = written(parts.select(F.col(by).alias("_by"), "_p", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")), "parts")
    rows = dealt.join(parts.withColumnRenamed("_p", "_q"), dealt[by].eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_q")))
    return rows.select(*turns.columns, (F.col("_before") + F.col("_i") - F.col("_first")).alias("_n"))


#: Turns of a conversation that one task orders.
STRETCH = 10_000


def context_frame(turns: DataFrame, n: int, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Each turn with the n turns before it, oldest first, as "role: text" lines.

    A conversation is cut into stretches of bounded size, each with a copy of the n turns before it, so no conversation is one
    task's work. Turns of equal order come in the order of their stretch.
    """
    stretch = max(STRETCH, n)
    rows = numbered(turns.select(by, order, "role", text), by, order).withColumn("_s", F.floor(F.col("_n") / stretch))
    ahead = rows.where(F.col("_n") % stretch >= stretch - n).withColumn("_s", F.col("_s") + 1)
    both = rows.withColumn("_own", F.lit(True)).unionByName(ahead.withColumn("_own", F.lit(False)))
    lines = F.collect_list(F.concat_ws(": ", "role", text)).over(Window.partitionBy(by, "_s").orderBy("_n").rowsBetween(-n, -1))
    framed = both.select(by, order, "_own", lines.alias("_l")).where("_own")
    return framed.select(by, order, F.array_join("_l", "\n").alias("context"), F.size("_l").alias("n_context"))


def hydrate(memories: DataFrame, turns: DataFrame, source: list[str]) -> DataFrame:
    """Memories with the role and text of their source turn, null where it is missing."""
    return memories.join(turns.select(*source, "role", F.col("text").alias("source_text")), source, "left")


def decision(similarity: Column, gate: float = 0.90, duplicate: float = 0.98) -> Column:
    """insert below the gate, skip for duplicates, update between. The judge is a rule in place of a language model."""
    return F.when(F.coalesce(similarity < gate, F.lit(True)), "insert").when(similarity >= duplicate, "skip").otherwise("update")


def sim01(cos: Column) -> Column:
    """Cosine similarity on the scale from 0 to 1."""
    return (1 + cos) / 2


def recall(vectors: DataFrame, queries: DataFrame, memories: DataFrame, k: int, scope: str = "scope", key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """query_id, key, cos and rank of each query's k nearest active memories of its own scope (a user, a project).

    The scope is filtered before the search; status comes from the table of memories, which is the truth: hits that it
    lacks or that aren't active go after the ranking, as the index may lag behind it. queries: query_id, scope, asked.
    """
    best = top_k_within(vectors, queries, k, scope, key, vector, True, digits)
    return best.join(memories.where("status = 'active'").select(key), key).select("query_id", key, "cos", "rank")


def applied(memories: DataFrame, decisions: DataFrame, key: str = "vec_id") -> DataFrame:
    """The memories after decisions (key, nearest, decision): skipped ones aren't there, updates deprecate what they replace."""
    new = decisions.where("decision <> 'skip'").select(key, F.lit("active").alias("status"))
    replaced = decisions.where("decision = 'update'").select(F.col("nearest").alias(key)).distinct().withColumn("_old", F.lit(True))
    kept = memories.join(decisions.select(key), key, "left_anti").join(replaced, key, "left")
    return kept.select(key, F.when(F.col("_old"), "deprecated").otherwise(F.col("status")).alias("status")).unionByName(new)


def prompt(hits: DataFrame, memories: DataFrame, turns: DataFrame, n: int, key: str = "vec_id", by: str = "conv_id", order: str = "turn") -> DataFrame:
    """For each conversation its recalled memories, by rank, and its last n turns, oldest first, as one text. hits: conversation as query_id."""
    known = hits.join(memories.select(key, F.col("text").alias("_m")), key).groupBy("query_id")
    known = known.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_m"))), lambda x: F.concat(F.lit("- "), x["_m"])), "\n").alias("_known"))
    said = recent_turns(turns, n, by, order).groupBy(by)
    said = said.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "text"))), lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("_said"))
    return said.join(known, said[by] == known["query_id"], "left").select(by, F.concat_ws("\n\n", F.coalesce("_known", F.lit("")), "_said").alias("prompt"))
