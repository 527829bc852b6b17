"""Many patterns at once: an automaton finds all of them in one pass over each text, whatever their number.

Patterns go to the tasks in blocks of bounded number and size, an automaton each; texts are read once a block. Matching is by
characters, without overlaps being dropped. Nulls and empty texts have no match, null and empty patterns match nothing, and a
pattern that comes twice is found under both names.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Patterns of a block and their characters, at most.
PATTERNS, CHARACTERS = 200_000, 8_000_000


def _blocks(patterns: DataFrame, pattern: str) -> Iterator[list[tuple[int, str]]]:
    """The patterns with their numbers, in blocks."""
    held, size = [], 0
    for r in patterns.select("_p", pattern).orderBy("_p").toLocalIterator():
        if held and (len(held) >= PATTERNS or size + len(r[1]) > CHARACTERS):
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def found(rows: DataFrame, patterns: DataFrame, key: str, text: Column, name: str = "name", pattern: str = "pattern") -> DataFrame:
    """key, name, n and first (from 0): how often each pattern stands in each row's text, overlaps too, and where first.

    patterns: name and pattern. Rows that repeat a key are rows of their own.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    numbered = written(patterns.where(F.length(pattern) > 0).select(F.col(name).alias("name"), F.col(pattern).alias("pattern"), F.xxhash64(pattern).alias("_p")), "patterns")
    each = numbered.dropDuplicates(["pattern"])
    out = spark.createDataFrame([], f"{key} {kind}, pattern string, n long, first long")
    for block in _blocks(each, "pattern"):
        sent = spark.sparkContext.broadcast([p for _, p in block])  # at most PATTERNS of at most CHARACTERS

        def run(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, automaton = sent.value, ahocorasick.Automaton()
            for i, p in enumerate(known):
                automaton.add_word(p, i)
            automaton.make_automaton()
            sizes = np.array([len(p) for p in known])
            for part in parts:
                at, which, count, where = [], [], [], []
                for i, x in enumerate(part.column(1).to_pylist()):
                    hits = np.array(list(automaton.iter(x)) if x else [], np.int64).reshape(-1, 2)
                    if len(hits):
                        own, first, n = np.unique(hits[:, 1], return_index=True, return_counts=True)
                        at.append(np.full(len(own), i))
                        which.append(own)
                        count.append(n)
                        where.append(hits[first, 0] + 1 - sizes[own])
                if at:
                    columns = [np.concatenate(x) for x in (at, which, count, where)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(columns[0])), pa.array([known[k] for k in columns[1]], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=[key, "pattern", "n", "first"])

        out = out.unionByName(rows.select(F.col(key), text.alias("_t")).mapInArrow(run, f"{key} {kind}, pattern string, n long, first long"))
    return out.join(numbered.select("pattern", "name"), "pattern").select(key, "name", "n", "first")


def tagged(rows: DataFrame, rules: DataFrame, defaults: list[str], key: str, path: str) -> DataFrame:
    """key and tags: the default tags, then those of rules whose keyword the path has in any case, each once, in the rules' order.

    rules: place, keyword and tag; any number of them. What functions.text.tagged gives for a few. key must be unique.
    """
    hits = found(rows, rules.select(F.struct("place", "tag").alias("name"), F.lower("keyword").alias("pattern")), key, F.lower(path))
    tags = hits.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("name")), lambda x: x["tag"]).alias("_t"))  # at most a row's rules
    none = F.array().cast("array<string>")
    return rows.select(key).join(tags, key, "left").select(key, F.array_distinct(F.concat(F.array(*map(F.lit, defaults)) if defaults else none, F.coalesce("_t", none))).alias("tags"))
