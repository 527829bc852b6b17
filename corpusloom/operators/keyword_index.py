"""Keyword search by postings of character runs: the answers of keyword_search without a look at most texts.

Rows are dealt into blocks as they are read. Terms are Latin letters and digits, or one or two CJK characters; so the runs
that count are three of the former, and one or two of the latter. For each run that a block has, a row tells how often
a text of the block has it at most, and which texts have it how often. A term stands in a text at most as often as the
rarest of its runs, which bounds a block's best score, and a text's; terms of one or two Latin letters have no run and
bound nothing. A search reads the runs of its terms alone; it scores texts of the most promising blocks, which gives the score that others must reach, and then looks
only at texts whose bound does. Their terms are counted exactly, as keyword_search does.

Postings are sorted by run and block, so a search's filter prunes files and row groups. Nulls are empty texts. Rows that repeat
a key are rows of their own. An empty table has an index without rows, and a query without terms no hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences, query_tokens
from ..session import fresh_path, written
from .search import keyword_score

#: Texts of a block, characters that runs are counted in at a time, and blocks that are scored first.
BLOCK_TEXTS, CHARACTERS, FIRST = 256, 1 << 20, 16
#: Blocks that a filter names one by one; more are joined.
NAMED = 500


@dataclass(frozen=True)
class Index:
    """texts: block, place, key, h and t (lower case); runs: run, block, most, places and counts; the key's name."""

    texts: DataFrame
    runs: DataFrame
    key: str


#: Of each ASCII character that is a letter or digit, its number from 1.
_LATIN = np.zeros(128, np.uint8)
_LATIN[ord("a") : ord("z") + 1] = np.arange(1, 27)
_LATIN[ord("0") : ord("9") + 1] = np.arange(27, 37)
#: The first and the number of CJK characters, and what tells their codes from those of Latin runs.
_CJK, _MANY, _ONE, _TWO = 0x4E00, 0x5200, 1 << 20, 1 << 40


def run_codes(term: str) -> list[int]:
    """The runs of a term; none of one or two Latin letters."""
    codes = [ord(c) for c in term]
    if codes and all(_CJK <= c < _CJK + _MANY for c in codes):
        return [_ONE + codes[0] - _CJK] if len(codes) == 1 else sorted({_TWO + (a - _CJK << 16) + b - _CJK for a, b in zip(codes, codes[1:], strict=False)})
    own = [int(_LATIN[c]) for c in codes]
    return sorted({(a << 12) + (b << 6) + c for a, b, c in zip(own, own[1:], own[2:], strict=False)})


def runs_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """run, text and count of each run of the texts, by run and text."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    own = np.zeros(1, np.uint32)  # stands between two texts
    code = np.concatenate([x for c in codes for x in (c, own)]) if codes else own
    owner = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes]) if codes else np.zeros(1, np.int64)
    latin = np.where(code < 128, _LATIN[np.minimum(code, 127)], 0).astype(np.int64)
    at = np.flatnonzero((latin[:-2] > 0) & (latin[1:-1] > 0) & (latin[2:] > 0))
    found = [((latin[at] << 12) + (latin[at + 1] << 6) + latin[at + 2], owner[at])]
    near = (code >= _CJK) & (code < _CJK + _MANY)
    if near.any():
        cjk = code.astype(np.int64) - _CJK
        one = np.flatnonzero(near)
        two = np.flatnonzero(near[:-1] & near[1:])
        found += [(_ONE + cjk[one], owner[one]), (_TWO + (cjk[two] << 16) + cjk[two + 1], owner[two])]
    run, text = (np.concatenate(x) for x in zip(*found, strict=True))
    width = max(1, len(texts))
    pairs, count = np.unique(run * width + text, return_counts=True)
    return pairs // width, pairs % width, count


def build(rows: DataFrame, key: str = "doc_id", heading: str = "heading", content: str = "content") -> Index:
    """The index of all rows, in the shared folder."""
    spark = rows.sparkSession
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select(F.spark_partition_id().cast("long").alias("p"), place.alias("i"), F.col(key).alias("key"), low(heading).alias("h"), low(content).alias("c"))
    block = (F.col("p") * (1 << 33) + F.floor(F.col("i") / BLOCK_TEXTS)).cast("long")
    texts = written(rows.select(block.alias("block"), (F.col("i") % BLOCK_TEXTS).cast("int").alias("place"), "key", "h", F.concat("h", F.lit(" "), "c").alias("t")), "texts")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            blocks, places = part.column(0).to_numpy(), part.column(1).to_numpy()
            ends = (np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist()
            for a, b in zip([0, *ends], [*ends, part.num_rows], strict=True):
                own = part.column(2).slice(a, b - a).to_pylist()
                at = 0
                while at < len(own):  # a block in pieces, if its texts are long
                    end, size = at, 0
                    while end < len(own) and (end == at or size + len(own[end]) <= CHARACTERS):
                        size += len(own[end])
                        end += 1
                    yield from posted(int(blocks[a]), places[a + at : a + end], *runs_of(own[at:end]))
                    at = end

    def posted(block: int, places: np.ndarray, run: np.ndarray, text: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(run):
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            ends = pa.array(np.append(first, len(run)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (places[text], count)]
            most = np.maximum.reduceat(count, first)
            yield pa.RecordBatch.from_arrays([pa.array(run[first]), pa.array(np.full(len(first), block)), pa.array(most, pa.int32()), *lists], names=["run", "block", "most", "places", "counts"])

    runs = texts.select("block", "place", "t").mapInArrow(run, "run long, block long, most int, places array<int>, counts array<int>")
    path = fresh_path(spark, "runs")
    runs.repartitionByRange("run", "block").sortWithinPartitions("run", "block").write.option("parquet.block.size", str(8 << 20)).parquet(path)
    return Index(texts, spark.read.schema(runs.schema).parquet(path), key)


def _bound(matched: Column, total: Column, n_terms: int) -> Column:
    """What a score is at most, with so many terms matched so often: a heading may have one."""
    return F.bround(F.least(F.lit(0.6) * matched / F.lit(n_terms) + F.lit(0.2) * F.least(total / F.lit(5.0), F.lit(2.0)) + F.lit(0.15), F.lit(1.0)), 4)


def _terms(index: Index, terms: list[str]) -> DataFrame:
    """run, term, n_runs of the term, and how often the query has the term."""
    rows = [(code, t, len(run_codes(t)), terms.count(t)) for t in sorted({t for t in terms if run_codes(t)}) for code in run_codes(t)]
    return index.runs.sparkSession.createDataFrame(rows, "run long, term string, n_runs int, times int")


def _postings(index: Index, terms: list[str]) -> DataFrame:
    """The postings of the terms' runs, with their terms."""
    codes = sorted({c for t in terms for c in run_codes(t)})
    return index.runs.where(F.col("run").isin(codes)).join(F.broadcast(_terms(index, terms)), "run")  # a query's terms are few


def _inside(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of some blocks; few blocks are named in the filter, which prunes files."""
    few = [r["block"] for r in blocks.select("block").limit(NAMED + 1).collect()]
    return rows.where(F.col("block").isin(few)) if len(few) <= NAMED else rows.join(blocks.select("block"), "block", "left_semi")


def _summed(rows: DataFrame, every: DataFrame, by: list[str], terms: list[str]) -> DataFrame:
    """The bounds of what has the terms of rows (``by``, most, times). Terms without a run may stand in everything, often."""
    loose = sum(not run_codes(t) for t in terms)
    sums = rows.groupBy(*by).agg(F.sum("times").alias("_m"), F.sum(F.col("most") * F.col("times")).alias("_t"))
    if loose:
        sums = every.join(sums, by, "left").select(*by, (F.coalesce("_m", F.lit(0)) + loose).alias("_m"), F.lit(1e9).alias("_t"))
    return sums.select(*by, _bound(F.col("_m"), F.col("_t"), len(terms)).alias("bound"))


def block_bounds(index: Index, terms: list[str]) -> DataFrame:
    """block and bound of the blocks in which a text may have a term."""
    # of pieces of a block the greatest counts
    rows = _postings(index, terms).groupBy("block", "term", "run").agg(F.max("most").alias("most"), F.first("n_runs").alias("n_runs"), F.first("times").alias("times"))
    rows = rows.groupBy("block", "term").agg(F.min("most").alias("most"), F.count("*").alias("n"), F.first("n_runs").alias("n_runs"), F.first("times").alias("times")).where("n = n_runs")
    return _summed(rows, index.texts.select("block").distinct(), ["block"], terms)


def text_bounds(index: Index, terms: list[str], blocks: DataFrame) -> DataFrame:
    """block, place and bound of the texts of some blocks that may have a term."""
    rows = _inside(_postings(index, terms), blocks).select("block", "term", "n_runs", "times", F.inline(F.arrays_zip("places", "counts"))).withColumnRenamed("places", "place")
    rows = rows.groupBy("block", "place", "term").agg(F.min("counts").alias("most"), F.count("*").alias("n"), F.first("n_runs").alias("n_runs"), F.first("times").alias("times")).where("n = n_runs")
    return _summed(rows, _inside(index.texts, blocks).select("block", "place"), ["block", "place"], terms)


def _scored(index: Index, terms: list[str], wanted: DataFrame) -> DataFrame:
    """key and score of some texts (block, place), exactly."""
    rows = _inside(index.texts, wanted.select("block").distinct()).join(wanted.select("block", "place"), ["block", "place"], "left_semi")
    rows = rows.select("block", "key", "h", F.array(*(occurrences(F.col("t"), t) for t in terms)).alias("_c"))
    return rows.select("block", "key", keyword_score(F.col("h"), F.col("_c"), terms).alias("score"))


def search(index: Index, query: str, k: int, cost: dict | None = None) -> DataFrame:
    """key, score and rank of the k best rows with a score above 0, ties by key: what keyword_search gives.

    ``cost`` receives the numbers of blocks, and of texts and their characters: in all, and looked at.
    """
    terms = query_tokens(query)
    if not terms:
        return index.texts.limit(0).select(F.col("key").alias(index.key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    bounds = written(block_bounds(index, terms), "bounds")
    first = bounds.orderBy(F.desc("bound"), "block").limit(max(FIRST, -(-k // BLOCK_TEXTS)))
    wanted = written(text_bounds(index, terms, first), "first")
    tried = written(_scored(index, terms, wanted).where("score > 0").orderBy(F.desc("score"), "key").limit(k), "tried")
    last = tried.orderBy("score", F.desc("key")).first() if tried.count() == k else None
    if last:
        # a block whose best would tie comes too late if all its keys do
        keys = index.texts.groupBy("block").agg(F.min("key").alias("first")) if bounds.where(F.col("bound") == last["score"]).limit(1).count() else None
        open_ = bounds.where(F.col("bound") > last["score"])
        if keys is not None:
            open_ = open_.unionByName(bounds.where(F.col("bound") == last["score"]).join(keys.where(F.col("first") <= last["key"]), "block").select("block", "bound"))
        open_ = written(open_, "open")
        wanted = written(text_bounds(index, terms, open_).where(F.col("bound") >= last["score"]), "wanted")
    else:
        wanted = written(text_bounds(index, terms, bounds), "wanted")
    best = _scored(index, terms, wanted)
    if cost is not None:
        looked = _inside(index.texts, wanted.select("block").distinct()).join(wanted, ["block", "place"], "left_semi")
        sums = [F.count("*"), F.sum(F.length("t"))]
        cost["texts"], cost["characters"] = index.texts.agg(*sums).first()
        cost["texts_read"], cost["characters_read"] = (x or 0 for x in looked.agg(*sums).first())
        cost["blocks"], cost["blocks_open"] = index.texts.select("block").distinct().count(), wanted.select("block").distinct().count()
    best = best.where("score > 0").orderBy(F.desc("score"), "key").limit(k).select(F.col("key").alias(index.key), "score")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), index.key)))
