"""Divergence of the sources of a language by their words, as tiles of group blocks over chunks of the vocabulary.

Documents are counted where they are read, by language, source and term. The terms that a language keeps are dealt
into chunks by their hash and numbered there, so a group (a language's source) has a packed vector of counts for each
chunk. Groups are dealt into blocks; a packed vector is replicated to each tile, a pair of blocks, that its block is
part of. A tile goes through the chunks one by one, makes shares of the counts, and adds the divergences of all
its pairs; it holds one chunk of the groups of two blocks. All numbers are integers, and exact.

Nulls: a null text, language or source is empty. Rows are documents, whether they repeat a doc_id or not. Texts of any
length are taken whole; other columns aren't read. A language without kept terms gives its pairs the value 0, a source
that is alone in its language has no pair, and an empty table no row. Ties are ranked by the UTF-8 of the item.
Terms are told apart in a chunk of texts by 64-bit hashes, beyond by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import FOLD, Words, chunks, small, text_bytes, tidy, written

#: A term of the lower-cased text: a-z and all bytes of non-ASCII characters. 0: a separator.
LETTERS = FOLD.copy()
LETTERS[48:58] = 0

#: Documents that a kept term is in, at least; the scale of shares; ranks of terms that are returned.
LEAST_DOCS, SCALE, TERMS = 3, 1_000_000_000, 200
#: Counts of a task that are added up before they are sent; terms of a chunk and groups of a block, on average.
HELD, CHUNK_TERMS, BLOCK_GROUPS = 2_000_000, 8192, 8
#: Counts below this can be scaled within 64 bits.
FITS = (1 << 63) // SCALE - 1


class Counts:
    """Counts of terms by group, and the documents that hold them, of the texts of a task."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.buffers: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = self.base = 0

    def add(self, texts: list[bytes], owners: np.ndarray) -> None:
        """Texts, and the numbers of their groups."""
        w = Words(texts, LETTERS)
        order = np.argsort(w.hashes, kind="stable")  # of equal hashes, texts stay in order
        if not len(order):
            return
        h, o = w.hashes[order], w.owner[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
        one = order[first]
        self.parts.append((owners[o[first]], h[first], np.diff(first, append=len(h)), w.starts[one] + self.base, (w.ends - w.starts)[one]))
        self.buffers.append(w.folded)
        self.base += len(w.folded)
        self.held += len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """lang, source, term, n and docs of what was added."""
        if self.parts:
            owner, h, n, start, size = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            order = np.lexsort((owner, h))
            owner, h = owner[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
            totals, docs = np.add.reduceat(n[order], first), np.diff(first, append=len(h))
            one, owner, buffer = order[first], owner[first], np.concatenate(self.buffers)
            langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
            self.clear()
            for a in range(0, len(first), 200_000):
                some = slice(a, a + 200_000)
                sizes = size[one[some]]
                ends = np.cumsum(sizes)
                at = np.arange(ends[-1]) + np.repeat(start[one[some]] - (ends - sizes), sizes)
                terms = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(buffer[at])])
                own = pa.array(owner[some])
                yield pa.RecordBatch.from_arrays([langs.take(own), sources.take(own), terms, pa.array(totals[some], pa.int64()), pa.array(docs[some], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _named(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it) of all terms."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for part in parts:
            pairs = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            owners = np.array([counts.groups.setdefault(g, len(counts.groups)) for g in pairs], np.int32)
            texts = text_bytes(part.column(2))
            for a, b in chunks(texts):
                counts.add(texts[a:b], owners[a:b])
                if counts.held >= HELD:
                    yield from counts.flush()
        yield from counts.flush()

    rows = docs.select(*_named(docs), "text").mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / total) of two columns of longs, exactly."""
    wide = f"(CAST({n} + 1 AS DECIMAL(19, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) DIV CAST({total} AS DECIMAL(19, 0))"
    return F.expr(f"1 + CASE WHEN {n} < {FITS} THEN ({n} + 1) * {SCALE}L DIV {total} ELSE {wide} END")


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """The same of an array."""
    if n.size == 0 or int(n.max()) < FITS:
        return 1 + (n + 1) * SCALE // total
    # the scale in three steps of a thousand, as in a long division: what is left is below the total
    out, rest = (n + 1) // total, (n + 1) % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return 1 + out


def vocabulary(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, total, chunk, pos, n_terms of the chunk), and their number and occurrences by language (lang, v, total)."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = written(kept, "kept-terms")
    langs = written(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total")), "languages")
    n_chunks = F.ceil(F.col("v") / CHUNK_TERMS)
    dealt = kept.join(small(langs), "lang").select("lang", "term", "total", F.pmod(F.xxhash64("term"), n_chunks).cast("int").alias("chunk"))
    of = Window.partitionBy("lang", "chunk")
    dealt = dealt.select("*", (F.row_number().over(of.orderBy("term")) - 1).alias("pos"), F.count("*").over(of).cast("int").alias("n_terms"))
    return written(dealt, "vocabulary"), langs


class Tile:
    """The pairs of two blocks of groups. Groups come first, then packed vectors, chunk by chunk."""

    def __init__(self, a: int, b: int, v: int):
        self.a, self.b, self.v, self.seen = a, b, v, 0
        self.names: dict[str, int] = {}
        self.blocks: list[int] = []
        self.totals: list[int] = []
        self.chunk = -1
        self.counts = np.zeros((0, 0), np.int64)
        self.sums: np.ndarray | None = None

    def group(self, source: str, block: int, total: int) -> None:
        self.names[source] = len(self.names)
        self.blocks.append(block)
        self.totals.append(total)

    def vector(self, source: str, chunk: int, n_terms: int, pos: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close()
            self.chunk, self.counts = chunk, np.zeros((len(self.names), n_terms), np.int64)
        self.counts[self.names[source], pos] = n

    def pairs(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each group, and those that it is compared with here."""
        blocks = np.array(self.blocks)
        for k, block in enumerate(self.blocks):
            others = np.flatnonzero(blocks == (self.b if block == self.a else self.a))
            others = others[others != k]
            if len(others):
                yield k, others

    def close(self) -> None:
        """Adds the divergences of the chunk at hand."""
        if self.sums is None:
            self.sums = np.zeros((len(self.names), len(self.names)), np.int64)
        if self.chunk >= 0:
            p = np.stack([shares(n, total + self.v) for n, total in zip(self.counts, self.totals, strict=True)])
            for k, others in self.pairs():
                self.sums[k, others] += ((p[k] - p[others]) ** 2 // p[others]).sum(axis=1)
            self.seen += self.counts.shape[1]
        self.chunk = -1

    def values(self) -> Iterator[tuple[str, str, int]]:
        """source, other source and value of each pair. Terms of chunks that no group here has are absent from all."""
        self.close()
        names = list(self.names)
        rest = self.v - self.seen
        base = [int(shares(np.zeros(1, np.int64), t + self.v)[0]) if self.v else 1 for t in self.totals]
        for k, others in self.pairs():
            for j in others.tolist():
                yield names[k], names[j], int(self.sums[k, j]) + rest * ((base[k] - base[j]) ** 2 // base[j])


def tiled(groups: DataFrame, packed: DataFrame) -> DataFrame:
    """lang, source, item and value of each pair of a language's groups.

    groups: lang, source, block, n_blocks, v, total. packed: lang, source, chunk, n_terms, counts (pos, n).
    """
    meta = groups.select("lang", "source", "block", "n_blocks", "v", "total", F.lit(-1).alias("chunk"), F.lit(0).alias("n_terms"), F.array().cast("array<struct<pos:int,n:long>>").alias("counts"))
    vectors = packed.join(small(groups), ["lang", "source"]).select(*meta.columns)
    rows = meta.unionByName(vectors).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tile = ["lang", "a", "b"]
    rows = rows.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "chunk", "source", "block", "v", "total", "n_terms", "counts")
    dealt = rows.repartition(*tile).sortWithinPartitions(*tile, "chunk")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, now = None, None

        def done(lang: str, tile: Tile) -> pa.RecordBatch:
            found = list(tile.values())
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), *(pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64())))], names=["lang", "source", "item", "value"])

        for part in parts:
            columns = [part.column(i).to_pylist() for i in range(9)]
            counts = part.column(9)
            for i, (lang, a, b, chunk, source, block, v, total, n_terms) in enumerate(zip(*columns, strict=True)):
                if (lang, a, b) != place:
                    if now:
                        yield done(place[0], now)
                    place, now = (lang, a, b), Tile(a, b, v)
                if chunk < 0:
                    now.group(source, block, total)
                else:
                    own = counts.slice(i, 1).flatten()
                    now.vector(source, chunk, n_terms, own.field(0).to_numpy(), own.field(1).to_numpy())
        if now:
            yield done(place[0], now)

    return dealt.mapInArrow(tidy(run), "lang string, source string, item string, value long")


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: pairs of a language's sources, and the terms that mark a source most.

    A group gives a kept term the share p = 1 + floor(SCALE * (n + 1) / (N + V)), n its occurrences there, N those of
    all V kept terms; a language does so too. f = floor((p - q)^2 / q). pair: f of each other source's q, over all
    kept terms. term: f of the language's q, for terms that the group has and whose p is above q, to rank TERMS.
    """
    counts = written(counted(docs), "counts")
    words, langs = vocabulary(counts)
    found = counts.select("lang", "source", "term", "n").join(words, ["lang", "term"])
    found = written(found.select("lang", "source", "term", "n", "total", "chunk", "pos", "n_terms"), "kept-counts")
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*_named(docs)).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    n_groups = written(groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_GROUPS).cast("int").alias("n_blocks")), "blocks")
    none = F.lit(0).cast("long")
    groups = groups.join(small(n_groups), "lang").select("lang", "source", F.coalesce("total", none).alias("total"), F.coalesce("v", none).alias("v"), F.coalesce("lang_total", none).alias("lang_total"), "n_blocks", F.pmod(F.xxhash64("source"), "n_blocks").cast("int").alias("block"))
    groups = written(groups, "groups")
    packed = found.groupBy("lang", "source", "chunk").agg(F.first("n_terms").alias("n_terms"), F.collect_list(F.struct("pos", "n")).alias("counts"))  # at most a chunk's terms
    pairs = written(tiled(groups, packed), "pairs").withColumn("part", F.lit("pair"))
    terms = found.join(small(groups.select("lang", "source", F.col("total").alias("n_all"), "v", "lang_total")), ["lang", "source"])
    terms = terms.select("lang", "source", "term", share("n", "(n_all + v)").alias("p"), share("total", "(lang_total + v)").alias("q")).where("p > q")
    terms = terms.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) DIV q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank")) for part, name in ((pairs, "pair"), (terms, "term"))]
    return rows[0].unionByName(rows[1].where(F.col("rank") <= TERMS))


#: The contract in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS lang_n, coalesce(own.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, source) own USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p, 1 + (1000000000 * (k.total + 1)) // (g.lang_n + g.v) AS q FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
 (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM term QUALIFY rank <= 200
"""
