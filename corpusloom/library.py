"""What a user of a document collection asks of it, as functions that return tables; and registries of what answers.

A Library names the tables. Retrievers, encoders and counters are looked up by name and may be added; chunks() is a table
function for SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import encoders, vectors
from .operators import chunking, corpus, keyword_index, search

#: Rows of a page, at most; hits of an answer without a wish; the greatest distance at which a hit is answered from.
PAGE, TOP, GATE = 100, 5, 0.5


@dataclass(frozen=True)
class Library:
    """documents: document_id, title, author, created_at, tags, source_path, content. chunks: chunk_id, document_id, title, heading, content, source_path, embedding.

    encoder: the name of what made the embeddings. index: a keyword index of the chunks, where there is one.
    """

    documents: DataFrame
    chunks: DataFrame
    encoder: str = "hash-128"
    index: keyword_index.Index | None = None


_SUMMARY = ("document_id", "title", "author", "created_at", "tags", "source_path")
_HIT = ("chunk_id", "document_id", "title", "heading", "content", "source_path")


def list_documents(library: Library, keyword: str | None = None, tag: str | None = None, number: int = 1, size: int = PAGE) -> tuple[DataFrame, int]:
    """A page of summaries by document_id, and how many documents there are in all; texts aren't read."""
    rows = library.documents.select(*_SUMMARY)
    rows = corpus.title_contains(rows, keyword) if keyword else rows
    rows = corpus.has_tag(rows, tag) if tag else rows
    return corpus.page(rows, ["document_id"], number, size, PAGE), rows.count()


def get_document(library: Library, document_id: str) -> DataFrame:
    """The document, or no row."""
    return library.documents.where(F.col("document_id") == document_id).select(*_SUMMARY, "content")


def by_keyword(library: Library, query: str, k: int) -> DataFrame:
    """chunk_id, score and rank by the query's terms; with the library's index where it has one."""
    if library.index:
        return keyword_index.search(library.index, query, k)
    return search.keyword_search(library.chunks, query, k, "chunk_id")


def by_vector(library: Library, query: str, k: int) -> DataFrame:
    """chunk_id, score (cosine) and rank by the query's encoding. Chunks are named by numbers on the way, ties go to the smaller hash."""
    spark = library.chunks.sparkSession
    asked = encoders.encoder(library.encoder)(spark.createDataFrame([(0, query)], "query_id long, text string"), "query_id", "text").withColumnRenamed("embedding", "asked")
    rows = library.chunks.select("chunk_id", F.xxhash64("chunk_id").alias("id"), "embedding")
    hits = vectors.top_k(rows, asked, k, "id")
    return hits.join(rows.select("id", "chunk_id"), "id").select("chunk_id", F.col("cos").alias("score"), "rank")


#: Retrievers by name: (library, query, k) to chunk_id, score and rank.
RETRIEVERS: dict[str, Callable[[Library, str, int], DataFrame]] = {"keyword": by_keyword, "vector": by_vector}


def retrieve(library: Library, query: str, k: int = TOP, retriever: str = "keyword") -> DataFrame:
    """rank, score and what a hit is, of the k best chunks."""
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever}; there are {sorted(RETRIEVERS)}")
    if k < 1:
        raise ValueError("at least one hit must be asked for")
    hits = RETRIEVERS[retriever](library, query, k)
    return library.chunks.select(*_HIT).join(F.broadcast(hits), "chunk_id").select("rank", "score", *_HIT)  # k rows


def query_documents(library: Library, query: str, k: int = TOP) -> DataFrame:
    """The chunks that have the query's terms, best first by rank."""
    return retrieve(library, query, k)


def search_knowledge(library: Library, query: str, k: int = TOP) -> DataFrame:
    """The chunks nearest to the query, with distance and score of four digits."""
    hits = retrieve(library, query, k, "vector")
    return hits.withColumn("distance", F.round(1 - F.col("score"), 4)).withColumn("score", F.round(1 - F.round(1 - F.col("score"), 4), 4))


def ask(library: Library, query: str, k: int = TOP, most: float = GATE) -> DataFrame:
    """confident, distance, context (the hits' texts by rank; empty if none is near enough) and sources: all that an answer is written from."""
    hits = search_knowledge(library, query, k)
    held = F.array_sort(F.collect_list(F.struct("rank", "content", "source_path")))
    rows = hits.agg(F.min("distance").alias("distance"), held.alias("h"))
    near = F.coalesce(F.col("distance") < most, F.lit(False))
    none = F.array().cast("array<string>")
    return rows.select(near.alias("confident"), "distance", F.when(near, F.array_join(F.transform("h", lambda x: x["content"]), "\n\n---\n\n")).otherwise("").alias("context"), F.when(near, F.array_distinct(F.transform("h", lambda x: x["source_path"]))).otherwise(none).alias("sources"))


def browse(classified: DataFrame, path: str = "", key: str = "doc_id", number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of the rows at or below a node, given by the path that classification wrote; all rows without one."""
    rows = classified.where((F.col("path") == path) | F.startswith("path", F.lit(f"{path} > "))) if path else classified
    return corpus.page(rows.select(key, "status", "path"), [key], number, size, PAGE)


def categories(classified: DataFrame, path: str = "") -> DataFrame:
    """name and n of the nodes right below a path that have rows at or below them; rows that stay at the path have a null name."""
    depth = len(path.split(" > ")) if path else 0
    rows = classified.where((F.col("path") == path) | F.startswith("path", F.lit(f"{path} > "))) if path else classified
    return rows.groupBy(F.get(F.split("path", " > "), F.lit(depth)).alias("name")).agg(F.count("*").alias("n")).select(F.nullif("name", F.lit("")).alias("name"), "n")


def register(spark: SparkSession) -> None:
    """Makes chunks(TABLE(...), counter) known to SQL. The table has an identity and a text, in this order."""
    kind = f"doc string, {chunking.RICH}"

    class Chunks:
        def eval(self, table: pa.RecordBatch, counter: pa.Array) -> Iterator[pa.Table]:
            size = chunking.COUNTERS[counter[0].as_py()]
            rows: list[list] = [[] for _ in range(9)]
            for doc, body in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
                for i, c in enumerate(chunking.rich_chunks(body or "", size)):
                    name, digest = chunking.identity(str(doc), i, c["heading_path"], c["content"])
                    for column, x in zip(rows, (str(doc), name, i, c["heading_path"], c["start"], c["end"], c["token_count"], digest, c["content"]), strict=True):
                        column.append(x)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.table([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in kind.split(", ")])

    spark.udtf.register("chunks", F.arrow_udtf(Chunks, returnType=kind))
