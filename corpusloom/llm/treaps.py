"""Ranked search by inverted treaps: each term's postings as a tree in the order of doc_id and the heap order of impact.

Documents become shards where they are read, of bounded documents and postings; a shard has its postings by term and
document, and no term's list is ever in one place. A search makes the treaps of a shard and goes down those of an
item's terms together: a range of documents has the subtree of each term in it, whose roots hold the range's greatest
impacts. A range whose summed roots can't reach the k-th score so far is dropped with all its subtrees; else the
document of the greatest root is scored exactly, and parts the range in two. Ranges of a level, of several items, go in one step.
What a task finds in its shards is kept to k rows an item, and only these are ranked together.

Nulls: a null text has no terms, and neither counts as a document nor is found; an item without terms finds nothing; a null
doc_id is found, after others of the score. Rows are documents and items, whether they repeat an id or not. Texts of any
length are taken whole; other columns aren't read. Without documents or items there is no row. Terms are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Words, chunks, fresh_path, text_bytes, tidy, written

#: Rows that are returned for an item, at most.
TOP = 50
#: Documents and postings of a shard, about; a longer document is a shard of its own.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 19
#: Terms that are sent to the tasks that read, so that others aren't indexed; with more, all are.
SENT_TERMS = 1_000_000
#: Pairs of item and term that are sent to all tasks; more meet the shards in blocks of items.
SENT_PAIRS, BLOCK_PAIRS = 1_000_000, 8192
#: Pairs of item and term that go down the treaps together.
TOGETHER = 1024

SHARD = "shard string, ids binary, lost binary, sizes binary, terms array<long>, dfs array<long>, owners binary, tfs binary, docs long, words long"
SHARD_NAMES = [x.split()[0] for x in SHARD.split(", ")]
HIT = "row long, doc_id long, score long"


def term_counts(texts: list[bytes], asked: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of each text; and text, term and occurrences of each term of a text, of those asked for (sorted)."""
    w = Words(texts)
    hashes, owner = w.hashes, w.owner
    if asked is not None:
        at = np.searchsorted(asked, hashes)
        known = np.zeros(len(hashes), bool) if not len(asked) else asked[np.minimum(at, len(asked) - 1)] == hashes
        hashes, owner = hashes[known], owner[known]
    order = np.argsort(hashes, kind="stable")  # of equal hashes, texts stay in order
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    return w.counts, o[first], h[first], np.diff(first, append=len(h))


class Shard:
    """Documents that are gathered for a shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, ids: list[int | None], sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.parts.append((owner + len(self.ids), term, tf))
        self.ids += ids
        self.sizes.append(sizes)
        self.held += len(owner)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.held >= SHARD_POSTINGS

    def row(self, name: str) -> pa.RecordBatch:
        """The documents with words, by id, nulls last; their postings by term and document."""
        sizes = np.concatenate(self.sizes).astype(np.int64)
        lost = np.array([x is None for x in self.ids], bool)
        ids = np.array([x or 0 for x in self.ids], np.int64)
        order = np.lexsort((ids, lost))
        order = order[sizes[order] > 0]
        place = np.full(len(ids), -1, np.int64)
        place[order] = np.arange(len(order))
        owner, term, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        owner = place[owner]
        by = np.lexsort((owner, term))
        owner, term, tf = owner[by], term[by], tf[by]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        longs = lambda x: pa.array([x.astype(np.int64)], pa.list_(pa.int64()))
        columns = [blob(ids[order], np.int64), blob(lost[order], np.uint8), blob(sizes[order], np.int64), longs(term[first].view(np.int64)), longs(np.diff(first, append=len(term))), blob(owner, np.int32), blob(tf, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array([name]), *columns, pa.array([len(order)], pa.int64()), pa.array([int(sizes.sum())], pa.int64())], names=SHARD_NAMES)


@dataclass(frozen=True)
class Index:
    """The shards, a written table; the documents with a term and the words of all; the documents of each term (term, df)."""

    shards: DataFrame
    n_docs: int
    n_words: int
    terms: DataFrame


def items_of(benchmark: DataFrame) -> DataFrame:
    """row (a number of its own), item_id and terms (distinct hashes) of each item, written."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, out = text_bytes(part.column(2)), []
            for a, b in chunks(texts):
                _, owner, term, _ = term_counts(texts[a:b], None)
                by = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[by], np.arange(b - a + 1))
                terms = term[by].view(np.int64)
                out += [terms[ends[k] : ends[k + 1]] for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.int64()))], names=["row", "item_id", "terms"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = written(benchmark.select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "items")
    return written(rows.mapInArrow(run, f"row long, item_id {kind}, terms array<long>"), "item-terms")


def build(docs: DataFrame, asked: DataFrame | None = None) -> Index:
    """The index of all documents; given terms that will be asked for (a column term), of these, if they are few enough to be sent."""
    spark = docs.sparkSession
    sent = None
    if asked is not None:
        few = asked.select("term").distinct().limit(SENT_TERMS + 1).toArrow().column(0).to_numpy()
        if len(few) <= SENT_TERMS:
            sent = spark.sparkContext.broadcast(np.sort(few.astype(np.int64).view(np.uint64)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        shard, terms = Shard(), sent.value if sent else None
        for part in parts:
            ids, texts = part.column(0).to_pylist(), text_bytes(part.column(1))
            for a, b in chunks(texts):
                shard.add(ids[a:b], *term_counts(texts[a:b], terms))
                if shard.full():
                    yield shard.row(uuid.uuid4().hex)
                    shard = Shard()
        if shard.ids:
            yield shard.row(uuid.uuid4().hex)

    path = fresh_path(spark, "shards")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), SHARD)
    rows.write.option("parquet.block.size", str(32 << 20)).option("parquet.block.size.row.check.min", "4").parquet(path)  # rows are large
    shards = spark.read.schema(rows.schema).parquet(path)
    size = shards.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    dfs = shards.select(F.inline(F.arrays_zip("terms", "dfs"))).groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    return Index(shards, size["docs"] or 0, size["words"] or 0, dfs)


class Treaps:
    """The treaps of a shard's terms. Node k is posting k; -1 is none.

    A node is above those of less impact, and of equal impact above those after it. Its neighbours of that kind to
    both sides, in its term, are found by jumping over lesser ones; the lower of the two is its parent.
    """

    def __init__(self, shard: dict, n_docs: int, n_words: int):
        self.ids, self.lost = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["lost"], np.uint8)
        sizes = np.frombuffer(shard["sizes"], np.int64)
        if len(sizes) and 50 * int(sizes.max()) * n_docs >= 1 << 63:
            long = np.array([50 + 50 * int(x) * n_docs // n_words for x in sizes], np.int64)
        else:
            long = 50 + 50 * sizes * n_docs // max(n_words, 1)
        self.terms = shard["terms"].view(np.uint64)
        counts = shard["dfs"]
        self.doc, tf = np.frombuffer(shard["owners"], np.int32).astype(np.int64), np.frombuffer(shard["tfs"], np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * long[self.doc])
        self.term = np.repeat(np.arange(len(counts)), counts)
        self.width = max(1, len(self.ids))
        self.key = self.term * self.width + self.doc
        self.left, self.right, self.root = self._linked(np.concatenate([[0], np.cumsum(counts)]))

    def _linked(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, impact = len(self.doc), self.impact
        at = np.arange(n)
        before, after = at - 1, at + 1
        before[ends[:-1]] = -1
        after[ends[1:] - 1] = -1
        for near, passed in ((before, np.less), (after, np.less_equal)):
            open_ = np.flatnonzero(near >= 0)
            while len(open_):
                open_ = open_[passed(impact[near[open_]], impact[open_])]
                near[open_] = near[near[open_]]
                open_ = open_[near[open_] >= 0]
        both = (before >= 0) & (after >= 0)
        # the lower of two: of equal impact the later one
        from_left = (before >= 0) & ~(both & (impact[before] >= impact[after]))
        from_right = (after >= 0) & ~from_left
        left, right, root = np.full(n, -1), np.full(n, -1), np.full(len(ends) - 1, -1)
        right[before[from_left]] = at[from_left]
        left[after[from_right]] = at[from_right]
        top = np.flatnonzero((before < 0) & (after < 0))
        root[self.term[top]] = top
        return left, right, root

    def within(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The root of what each node's subtree has between two documents, and which have any: the first node on the way down that is between."""
        node, open_ = node.copy(), np.arange(len(node))
        while len(open_):
            doc = self.doc[node[open_]]
            late = doc >= high[open_]
            aside = late | (doc <= low[open_])
            open_, late = open_[aside], late[aside]
            node[open_] = np.where(late, self.left[node[open_]], self.right[node[open_]])
            open_ = open_[node[open_] >= 0]
        stay = np.flatnonzero(node >= 0)
        return node[stay], stay

    def find(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The impact of terms in documents, 0 where they aren't."""
        wanted = term * self.width + doc
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.impact[at], 0)


class Best:
    """The best k rows of each item so far, and the score that a row must reach to be among them."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.item, self.lost, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(4))
        self.needed = np.ones(n_items, np.int64)  # scores are above 0

    def add(self, item: np.ndarray, lost: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.needed[item]
        if not good.any():
            return
        item, lost, doc, score = (np.concatenate([own, x[good]]) for own, x in ((self.item, item), (self.lost, lost), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, lost, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        self.item, self.lost, self.doc, self.score = item[rank < self.k], lost[order], doc[order], score[order]
        last = rank == self.k - 1
        self.needed[item[last]] = np.maximum(self.needed[item[last]], self.score[np.flatnonzero(rank[rank < self.k] == self.k - 1)])


def descend(treaps: Treaps, item: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Adds the best documents of a shard for items; item (ascending), term (of the shard) and weight of each pair. Returns the documents that were scored."""
    if not len(item):
        return 0
    new, scored = np.concatenate([[True], item[1:] != item[:-1]]), 0
    # each range has an item and bounds that are outside of it; each node is the root of a term's postings in its owner's range
    ranges, owner, node = item[new], np.cumsum(new) - 1, treaps.root[term]
    low, high = np.full(len(ranges), -1), np.full(len(ranges), treaps.width)
    while len(node):
        starts = np.searchsorted(owner, np.arange(len(ranges)))
        most = weight * treaps.impact[node]
        can = np.add.reduceat(most, starts) >= best.needed[ranges]
        if not can.all():
            stay = can[owner]
            ranges, low, high, node, weight, most = ranges[can], low[can], high[can], node[stay], weight[stay], most[stay]
            owner = (np.cumsum(can) - 1)[owner[stay]]
            if not len(node):
                break
            starts = np.searchsorted(owner, np.arange(len(ranges)))
        # the document of the greatest root
        top = np.flatnonzero(most == np.maximum.reduceat(most, starts)[owner])
        of = owner[top]
        pivot = treaps.doc[node[top[np.concatenate([[True], of[1:] != of[:-1]])]]]
        score = np.add.reduceat(weight * treaps.find(treaps.term[node], pivot[owner]), starts)
        best.add(ranges, treaps.lost[pivot].astype(np.int64), treaps.ids[pivot], score)
        scored += len(pivot)
        # the ranges before and after it, without those that no term has a posting in
        low, high = np.concatenate([low, pivot]), np.concatenate([pivot, high])
        owner = np.concatenate([owner, owner + len(ranges)])
        node, stay = treaps.within(np.concatenate([node, node]), low[owner], high[owner])
        owner, weight = owner[stay], np.concatenate([weight, weight])[stay]
        filled = np.zeros(len(low), bool)
        filled[owner] = True
        ranges, low, high = np.concatenate([ranges, ranges])[filled], low[filled], high[filled]
        owner = (np.cumsum(filled) - 1)[owner]
    return scored


@dataclass
class Asked:
    """Items as arrays: their rows, and the pairs of item (ascending), term and weight."""

    rows: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, lists: pa.Array) -> Asked:
        flat = lists.flatten()
        counts = np.asarray(lists.value_lengths(), np.int64)
        return Asked(rows, np.repeat(np.arange(len(rows)), counts), flat.field(0).to_numpy().astype(np.int64).view(np.uint64), flat.field(1).to_numpy())

    def search(self, treaps: Treaps, best: Best) -> None:
        """Goes down a shard's treaps with some items at a time."""
        if not len(treaps.terms):
            return
        at = np.minimum(np.searchsorted(treaps.terms, self.term), len(treaps.terms) - 1)
        known = treaps.terms[at] == self.term
        item, at, weight = self.item[known], at[known], self.weight[known]
        a = 0
        while a < len(item):
            b = int(np.searchsorted(item, item[min(a + TOGETHER, len(item)) - 1], "right"))
            descend(treaps, item[a:b], at[a:b], weight[a:b], best)
            a = b

    def hits(self, best: Best) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.rows[best.item], pa.int64()), pa.array(best.doc, mask=best.lost.astype(bool)), pa.array(best.score, pa.int64())], names=["row", "doc_id", "score"])


def _shards(part: pa.RecordBatch) -> Iterator[dict]:
    """The shards of a batch, in the order of SHARD's columns."""
    for i in range(part.num_rows):
        row = {n: part.column(k).slice(i, 1) for k, n in enumerate(SHARD_NAMES) if n in ("ids", "lost", "sizes", "owners", "tfs", "terms", "dfs")}
        yield {n: x.flatten().to_numpy() if n in ("terms", "dfs") else x[0].as_buffer() for n, x in row.items()}


def _sent(index: Index, items: DataFrame, k: int) -> DataFrame:
    n_docs, n_words = index.n_docs, index.n_words
    table = items.orderBy("row").toArrow().combine_chunks()  # at most SENT_PAIRS pairs
    column = table.column("terms").combine_chunks()
    asked = index.shards.sparkSession.sparkContext.broadcast(Asked.of(table.column("row").to_numpy(), column)) if table.num_rows else None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if asked is None:
            return
        own = asked.value
        best = Best(len(own.rows), k)
        for part in parts:
            for shard in _shards(part):
                own.search(Treaps(shard, n_docs, n_words), best)
        yield from own.hits(best)

    return index.shards.mapInArrow(tidy(run), HIT)


def _dealt(index: Index, items: DataFrame, n_pairs: int, k: int) -> DataFrame:
    """Blocks of items are sent to each shard, where they come after it."""
    n_docs, n_words = index.n_docs, index.n_words
    blocks = items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(-(-n_pairs // BLOCK_PAIRS))))
    blocks = written(blocks.groupBy("block").agg(F.collect_list("row").alias("rows"), F.collect_list("terms").alias("lists")), "item-blocks")
    names = index.shards.select("shard")
    sent = names.withColumn("_n", F.lit(1)).join(blocks.withColumn("_n", F.lit(1)), "_n").drop("_n", "block").withColumn("side", F.lit(1))
    both = index.shards.withColumn("side", F.lit(0)).unionByName(sent, allowMissingColumns=True).select(*SHARD_NAMES, "rows", "lists", "side")
    dealt = both.repartition("shard").sortWithinPartitions("shard", "side")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        treaps = None
        for part in parts:
            for i in range(part.num_rows):
                row = part.slice(i, 1)
                if row.column(len(SHARD_NAMES) + 2)[0].as_py() == 0:
                    treaps = Treaps(next(_shards(row)), n_docs, n_words)
                    continue
                rows, lists = (row.column(len(SHARD_NAMES) + c).flatten() for c in (0, 1))
                own = Asked.of(rows.to_numpy(), lists)
                best = Best(len(own.rows), k)
                own.search(treaps, best)
                yield from own.hits(best)

    return dealt.mapInArrow(tidy(run), HIT)


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, equal scores by doc_id.

    items: row, item_id, terms, from items_of. A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact in a
    document (10^9 tf) div (1000 tf + 20 m), where m is 50 + ((50 n N) div L); a score sums their products.
    """
    pairs = items.select("row", F.explode("terms").alias("term")).join(index.terms, "term")
    weight = F.floor(1000 * F.log((2.0 * F.lit(float(index.n_docs)) + 2.0) / (2.0 * F.col("df").cast("double") + 1.0))).cast("long")
    pairs = pairs.select("row", F.struct("term", weight.alias("weight")).alias("pair")).where("pair.weight > 0")
    weighted = written(pairs.groupBy("row").agg(F.collect_list("pair").alias("terms")), "weighted")
    n_pairs = weighted.agg(F.sum(F.size("terms"))).first()[0] or 0
    run: Callable[[], DataFrame] = (lambda: _sent(index, weighted, k)) if n_pairs <= SENT_PAIRS else (lambda: _dealt(index, weighted, n_pairs, k))
    hits = written(run(), "hits")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(items.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each benchmark item; see search."""
    items = items_of(benchmark)
    return search(build(docs, items.select(F.explode("terms").alias("term"))), items, k)


#: The contract in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
t AS (SELECT r, unnest(w) AS term FROM d),
p AS (SELECT r, term, count(*) AS tf FROM t GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
q AS (SELECT i, item_id, term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS weight FROM b JOIN f USING (term), s),
h AS (SELECT i, item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w) * n_docs) // n_words)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN d USING (r), s GROUP BY i, item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM h JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 50
"""
