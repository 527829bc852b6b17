"""Turns of chats with a memory: recent turns, a rewritten question, recalled and hydrated memories, and one prompt. Many chats at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import memory, store

#: Turns before a question that are looked at, and memories that are recalled.
RECENT, RECALLED = 6, 5


def recent_before(turns: DataFrame, asked: DataFrame, n: int = RECENT, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """by, order (of the question), and recent: role and text of the n turns before each question, oldest first.

    Only conversations with a question are read, and each task sends n turns a question at most.
    """
    rows = turns.select(by, F.col(order).alias("_at"), "role", "text").join(asked.select(by, order), by).where(F.col("_at") < F.col(order))
    rank = F.row_number().over(Window.partitionBy(by, order).orderBy(F.desc("_at")))
    last = rows.withColumn("_r", rank).where(F.col("_r") <= n)
    held = last.groupBy(by, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("recent"))
    return asked.select(by, order).join(held, [by, order], "left").select(by, order, F.coalesce("recent", F.array().cast("array<struct<role:string,text:string>>")).alias("recent"))


def with_subject(asked: DataFrame, least: int = 4) -> DataFrame:
    """A rule in place of a model: a question of few words has the last question before it put in front."""
    before = F.filter("recent", lambda x: x["role"] == "user")
    short = (F.size(F.split(F.trim("text"), r"\s+")) < least) & (F.size(before) > 0)
    return asked.withColumn("query", F.when(short, F.concat_ws(" ", F.element_at(F.when(F.size(before) > 0, before), -1)["text"], "text")).otherwise(F.col("text")))


def answered(asked: DataFrame, turns: DataFrame, memories: DataFrame, vectors: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame], rewrite: Callable[[DataFrame], DataFrame] = with_subject, n: int = RECENT, k: int = RECALLED, by: str = "conv_id", order: str = "turn", key: str = "vec_id") -> DataFrame:
    """by, order, query, n_recent, memories (their keys, best first) and prompt for each question.

    asked: by, order, scope, text (one question a conversation and place). memories: key, text, status, and by and order of
    their source turn as source_conv and source_turn. vectors: scope, key, embedding. rewrite: adds query to asked with
    recent. encode: (rows, key, text) to key and embedding. Memories of the question's scope alone are searched; those that
    aren't active, as the table of memories has it, go. A memory's fact is its source turn, where that is there.
    """
    asked = asked.select(by, order, "scope", "text").withColumn("query_id", F.xxhash64(by, order))
    known = written(rewrite(asked.join(recent_before(turns, asked, n, by, order), [by, order])).select("query_id", by, order, "scope", "text", "recent", "query"), "asked")
    made = encode(known.select("query_id", "query"), "query_id", "query").select("query_id", F.col("embedding").alias("asked"))
    hits = memory.recall(vectors, known.select("query_id", "scope").join(made, "query_id"), memories, k, "scope", key)
    sources = turns.select(F.col(by).alias("source_conv"), F.col(order).alias("source_turn"), "role", "text")
    told = memory.hydrate(hits.join(memories.select(key, F.col("text").alias("_m"), "source_conv", "source_turn"), key), sources, ["source_conv", "source_turn"])
    line = F.concat(F.lit("- "), F.col("_m"), F.when(F.col("source_text").isNotNull(), F.concat(F.lit(" (source: "), "role", F.lit(": "), "source_text", F.lit(")"))).otherwise(""))
    held = told.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k"), line.alias("l")))).alias("_h"))
    rows = known.join(held, "query_id", "left")
    lines = F.array_join(F.transform("_h", lambda x: x["l"]), "\n")
    said = F.array_join(F.transform("recent", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n")
    prompt = F.concat_ws("\n\n", F.when(F.size("_h") > 0, F.concat(F.lit("Known:\n"), lines)), F.when(F.size("recent") > 0, F.concat(F.lit("Recent:\n"), said)), F.concat(F.lit("Question: "), F.col("text")))
    kind = memories.schema[key].dataType.simpleString()
    return rows.select(by, order, "query", F.size("recent").alias("n_recent"), F.coalesce(F.transform("_h", lambda x: x["k"]), F.array().cast(f"array<{kind}>")).alias("memories"), prompt.alias("prompt"))


def remembered(memories: DataFrame, extracted: DataFrame) -> DataFrame:
    """The memories (key, scope, content, source_conv, source_turn, created_at) and those that were extracted and are to be stored.

    extracted: should_store and the columns but key. A key comes from scope, content and source, so an extraction that runs
    again adds nothing; blank contents aren't stored.
    """
    content = F.trim(F.coalesce("content", F.lit("")))
    rows = extracted.where(F.coalesce("should_store", F.lit(False)) & (content != "")).withColumn("content", content)
    name = F.concat(F.lit("mem_"), F.substring(F.sha2(F.to_json(F.struct("scope", "content", "source_conv", "source_turn")), 256), 1, 12))
    return store.insert_or_ignore(memories, rows.select(name.alias("key"), *(c for c in memories.columns if c != "key")), "key", "created_at")
