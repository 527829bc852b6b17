"""Exact removal of similar lines: a set-similarity join with prefix, position and length filters.

A line is the set of its words. Lines with equal sets are one member, whose place is the first of them
(by doc_id, hash of the text, line number); the later ones go. Then a line goes if one before it has a
Jaccard similarity of at least the threshold. Words are ordered by rarity: by counts of a sketch of fixed
size, then by hash, which is one order for all lines, so the prefix filter loses nothing. Members meet in
the cells of their prefix words, and cells travel in buckets by hash, with many entries a row; common words'
groups are cut into blocks by the sketch's count. Length and
position bounds, and a bound from 128-bit parity maps, rule pairs out; what remains is tied into components
in which all pairs are verified exactly.

Nulls, empty texts and lines without a word are left alone. Lines of too few different words for the threshold
(less than four at 0.8) are similar to equal sets only. Rows that repeat a doc_id with the same text are one
document: they lose the same lines. Lines of any length are taken whole. Words are 64-bit hashes. Empty tables give
no row. Other columns of docs stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .links import by_cell, grouped, least_labels, verified
from .near import set_id
from .shared import FOLD, Words, chunks, mix, same_row, small, text_bytes, tidy, written

#: Counters of the sketch, and of each block that it travels in.
SKETCH, PAGE = 1 << 22, 1 << 16
LINE_BLOCK = 1024
#: Buckets of cells: how many at least, and the words of lines for which there is one more.
BUCKETS, BUCKET_WORDS = 1 << 10, 1 << 19
#: Entries that a task holds before they go out by bucket, entries of a row, and entries and pairs that are worked on together.
HELD, ROW, TOGETHER, PAIRS = 1 << 17, 128, 1 << 17, 1 << 21
#: Sets of lines that a task remembers, so that what it reads often goes out once.
RECENT = 1 << 18


class Lines:
    """The lines of some texts with their sets of words: text, number, and the range of ``token`` of each.

    A line's words are in the order of their logarithms in the sketch, if given, then of their values.
    """

    def __init__(self, texts: list[bytes], logs: np.ndarray | None = None):
        t = Words(texts, FOLD)
        breaks = np.flatnonzero(t.raw == 10)
        n = len(t.starts)
        line = np.cumsum(np.bincount(np.searchsorted(t.starts, breaks), minlength=n)[:n])  # over all texts
        base = np.searchsorted(breaks, t.begins[:-1])  # line breaks before each text
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (t.owner[1:] != t.owner[:-1])
        order = _order(np.cumsum(new) - 1, t.hashes, None if logs is None else logs[slot(t.hashes)])  # lines stay in place
        owner, token = t.owner, t.hashes[order]
        keep = new.copy()
        keep[1:] |= token[1:] != token[:-1]
        self.token, line, owner, new = token[keep], line[keep], owner[keep], new[keep]
        first = np.flatnonzero(new)
        self.first = np.concatenate([first, [len(line)]])
        self.text, self.number = owner[first], line[first] - base[owner[first]]
        self.sizes = np.diff(self.first)
        self.of_token = np.repeat(np.arange(len(first)), self.sizes)
        ids = self._sums(mix(self.token)), self._sums(mix(self.token ^ np.uint64(0x5851F42D4C957F2D))) + self.sizes.astype(np.uint64)
        self.ids = np.stack(ids, axis=1)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
            return total[self.first[1:]] - total[self.first[:-1]]

    def names(self) -> list[bytes]:
        """The sets' 128-bit names, equal to near.set_id of their words."""
        raw = self.ids.tobytes()
        return [raw[k : k + 16] for k in range(0, len(raw), 16)]

    def set(self, k: int) -> np.ndarray:
        """The words of a line."""
        return self.token[self.first[k] : self.first[k + 1]]


def _order(group: np.ndarray, value: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Order by group, then by ``first`` (below 256), then by value; one packed key, and all keys where it doesn't decide."""
    bits = max(1, int(group[-1] if len(group) else 0).bit_length())
    key = group.astype(np.uint64) << np.uint64(64 - bits)
    low = bits
    if first is not None:
        low += 8
        key |= first.astype(np.uint64) << np.uint64(64 - low)
    key |= value >> np.uint64(low)
    order = np.argsort(key)
    k, v = key[order], value[order]
    if ((k[1:] == k[:-1]) & (v[1:] < v[:-1])).any():
        return np.lexsort((value, group) if first is None else (value, first, group))
    return order


class _Fresh:
    """Which lines a task hasn't seen lately."""

    def __init__(self) -> None:
        self.seen: set[bytes] = set()

    def __call__(self, names: list[bytes]) -> np.ndarray:
        out = np.zeros(len(names), bool)
        for k, x in enumerate(names):
            if x not in self.seen:
                out[k] = True
                self.seen.add(x)
        if len(self.seen) > RECENT:
            self.seen.clear()
        return out


def slot(tokens: np.ndarray) -> np.ndarray:
    """The sketch's counter of each word."""
    return (tokens >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def _scanned(docs: DataFrame) -> DataFrame:
    """Two kinds of rows: lines (doc_id, th, number, id, name), and pages of the sketch (number, counts)."""
    kind = docs.schema["doc_id"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, counts, names = _Fresh(), np.zeros(SKETCH, np.uint32), ["doc_id", "th", "number", "id", "name", "counts"]
        doc_type, touched = None, False
        for part in parts:
            doc_type = part.column(0).type
            texts = text_bytes(part.column(2))
            for a, b in chunks(texts):
                lines = Lines(texts[a:b])
                ids = lines.names()
                if not ids:
                    continue
                new = fresh(ids)
                np.add.at(counts, slot(lines.token[new[lines.of_token]]), np.uint32(1))  # of the counters' type, or numpy takes a slow way
                touched = True
                at = pa.array(lines.text + a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(lines.number, pa.int32()), pa.array(ids, pa.binary()), pa.array(np.ascontiguousarray(lines.ids[:, 0]).view(np.int64)), pa.nulls(len(ids), pa.binary())],
                    names=names,
                )
        if touched:
            pages = counts.reshape(-1, PAGE)
            used = np.flatnonzero(pages.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(used), doc_type), pa.nulls(len(used), pa.int64()), pa.array(used, pa.int32()), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.int64()), pa.array([_packed(pages[p]) for p in used], pa.binary())],
                names=names,
            )

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    return rows.mapInArrow(tidy(run), f"doc_id {kind.simpleString()}, th long, number int, id binary, name long, counts binary")


def _packed(page: np.ndarray) -> bytes:
    """Places and counts of the counters that aren't 0."""
    at = np.flatnonzero(page)
    return at.astype(np.uint16).tobytes() + page[at].astype(np.uint32).tobytes()


def _sketch(pages: DataFrame) -> np.ndarray:
    """Rounded logarithms of the sums: SKETCH bytes, whatever the corpus. Sums are made by page, in tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in parts:
            for number, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page = held.setdefault(number, np.zeros(PAGE, np.int64))
                n = len(data) // 6
                page[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.uint32, n, 2 * n)
        if held:
            logs = [np.rint(np.log2(p + 1.0) * 6).clip(0, 255).astype(np.uint8).tobytes() for p in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(logs, pa.binary())], names=["number", "logs"])

    out = np.zeros(SKETCH, np.uint8)
    for r in pages.repartition("number").mapInArrow(tidy(run), "number int, logs binary").collect():
        out[r["number"] * PAGE : (r["number"] + 1) * PAGE] = np.frombuffer(r["logs"], np.uint8)
    return out


def parity(tokens: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit maps for each set: a bit is how many of its words fall on it, modulo 2.

    Differing bits of two maps are at most the words that one of the sets lacks.
    """
    bit = (mix(tokens) >> np.uint64(57)).astype(np.int64)
    odd = np.bincount(of * 128 + bit, minlength=128 * n) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, 128), axis=1).view(np.uint64)


#: A line in a cell: the cell, the line's name and size, the word's place in its order times four plus the line's side, and its parity map.
#: A text has less than 2**31 bytes, so a place is below 2**30.
_BODY = np.dtype([("cell", "<u8"), ("id", "<u8"), ("n", "<u4"), ("at", "<u4"), ("map", "<u8", 2)])


def least_size(four: int, five: int) -> int:
    """The fewest words of a line that another set can be similar to at four/five: n of n + 1 must reach it."""
    return -(-four // (five - four)) if five > four else 1 << 31


def bucket_count(logs: np.ndarray) -> int:
    """Buckets for all entries, so that one has a few tens of thousands, whatever the corpus."""
    words = float((np.exp2(logs / 6.0) - 1).sum())
    return int(min(max(BUCKETS, words // BUCKET_WORDS), 1 << 24))


def _dealt(bodies: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """The entries as rows of a bucket with up to ROW of them."""
    body = np.concatenate([x.view(np.uint64).reshape(len(x), -1) for x in bodies]).view(_BODY)[:, 0]  # numpy is slow at joining and indexing records
    bucket = ((body["cell"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    body, bucket = body.take(order), bucket[order]
    first = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
    since = np.arange(len(body)) - np.repeat(first, np.diff(first, append=len(body)))
    begins = np.flatnonzero(since % ROW == 0)
    ends = np.append(begins, len(body))
    for k in range(0, len(begins), 1000):
        at = ends[k : k + 1001]
        offsets = ((at - at[0]) * body.itemsize).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body[at[0] : at[-1]].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int32)), data], names=["cell", "bodies"])


def _entries(docs: DataFrame, logs: np.ndarray, four: int, five: int) -> DataFrame:
    """Buckets of cells (``cell`` is the bucket), and bodies (see _BODY) for each prefix word of each line.

    A line is named by 64 bits here: lines that share a name by chance are candidates of the same
    component, no more, as names of 128 bits and the sets themselves decide later.
    """
    sent = docs.sparkSession.sparkContext.broadcast(logs)  # SKETCH bytes
    kind, fewest, buckets, most = _BODY, least_size(four, five), bucket_count(logs), HELD

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, fresh = sent.value, _Fresh()
        block_count = np.ceil(np.exp2(np.arange(256) / 6.0) * 1.1 / LINE_BLOCK).astype(np.int64)
        held: list[np.ndarray] = []
        size = 0
        for part in parts:
            texts = text_bytes(part.column(0))
            for a, b in chunks(texts):
                lines = Lines(texts[a:b], log)
                names = lines.names()
                new = np.flatnonzero(fresh(names) & (lines.sizes >= fewest)) if names else np.zeros(0, np.int64)
                if not len(new):
                    continue
                keep = np.zeros(len(names), bool)
                keep[new] = True
                keep = keep[lines.of_token]
                token = lines.token[keep]
                renumber = np.zeros(len(names), np.int64)
                renumber[new] = np.arange(len(new))
                of = renumber[lines.of_token[keep]]
                sizes = lines.sizes[new].astype(np.int64)
                maps = parity(token, of, len(new))
                prefix = sizes - -(-four * sizes // five) + 1
                of = np.repeat(np.arange(len(new)), prefix)
                at = np.arange(len(of)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
                token = token[np.repeat(np.cumsum(sizes) - sizes, prefix) + at]
                blocks = block_count[log[slot(token)]]
                line = np.zeros(len(new), kind)
                line["id"], line["n"], line["map"] = lines.ids[new, 0], sizes, maps
                body = line.take(of)
                body["at"] = at * 4
                own = other = np.zeros(len(body), np.int64)
                if (blocks > 1).any():
                    own = (body["id"] % blocks.astype(np.uint64)).astype(np.int64)
                    repeat = np.repeat(np.arange(len(token)), blocks)
                    other = np.arange(len(repeat)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    token, own, body = token[repeat], own[repeat], body.take(repeat)
                    body["at"] += np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint32)
                with np.errstate(over="ignore"):
                    body["cell"] = mix(token + mix((np.minimum(own, other) * 1_000_003 + np.maximum(own, other)).astype(np.uint64)))
                for k in range(0, len(body), most):
                    held.append(body[k : k + most])
                    size += len(held[-1])
                    if size >= most:
                        yield from _dealt(held, buckets)
                        held, size = [], 0
        if size:
            yield from _dealt(held, buckets)

    return docs.select("text").mapInArrow(tidy(run), "cell int, bodies binary")


def _ties(names: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each name but the least of its component, among those that the pairs tie together, to the least."""
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    at, node = np.unique(np.concatenate([a, b]), return_inverse=True)
    _, first, of = np.unique(names[at].view(np.int64), return_index=True, return_inverse=True)
    node = of[node]
    label = least_labels(len(first), node[: len(a)], node[len(a) :])
    moved = np.flatnonzero(label != np.arange(len(first)))
    return at[first[moved]], at[first[label[moved]]]


def _tied(rows: np.ndarray, four: int, five: int) -> tuple[np.ndarray, np.ndarray]:
    """Names a, b of lines in the same cells that no bound rules out: an edge from each to the least it is tied to."""
    none = np.zeros(0, np.int64)
    cell = rows["cell"]
    order = np.argsort(cell)
    cell = cell[order]
    same = cell[1:] == cell[:-1]
    many = np.append(same, False) | np.insert(same, 0, False)
    order, cell = order[many], cell[many]
    if not len(order):
        return none, none
    rows = rows.take(order)
    new = np.append(True, cell[1:] != cell[:-1])
    cell = np.cumsum(new) - 1
    key = (cell << 32) + rows["n"]
    order = np.argsort(key)
    rows, key = rows.take(order), key[order]  # by size within each cell
    n, side, maps, names, pairs, held = rows["n"].astype(np.int64), rows["at"] & 3, np.ascontiguousarray(rows["map"]), np.ascontiguousarray(rows["id"]), [], 0
    # Two lines share the lesser of their rests at most, and need four of four + five of their sizes' sum. So a
    # rest bounds the other's size, both that of the larger and that of the smaller.
    most = (n - (rows["at"] >> 2)) * (four + five) // four - n
    last = np.minimum(np.minimum(five * n // four, most), (1 << 32) - 1)
    ends = np.searchsorted(key, (cell << 32) + np.maximum(last, 0), "right")
    base, lag = np.arange(len(rows)), 1
    while True:
        base = base[base + lag < ends[base]]
        if not len(base):
            break
        j = base + lag
        lag += 1
        i = base[ok := n[base] <= most[j]]
        j = j[ok]
        ok = (side[i] == 0) | (side[i] != side[j])
        total = n[i] + n[j]
        apart = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
        ok &= (apart <= total - 2 * -(-four * total // (four + five))) & (names[i] != names[j])
        if ok.any():
            pairs.append((i[ok], j[ok]))
            held += len(pairs[-1][0])
        if held > PAIRS:
            pairs = [_ties(names, pairs)]
            held = 0
    if not pairs:
        return none, none
    a, b = _ties(names, pairs)
    return names[a].view(np.int64), names[b].view(np.int64)


def _candidates(entries: DataFrame, four: int, five: int) -> DataFrame:
    """Edges a, b of lines that no bound rules out, made from whole buckets."""
    kind, most = _BODY, TOGETHER

    def work(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        bodies = table.column("bodies").combine_chunks()
        offset = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1, bodies.offset * 4).astype(np.int64)
        ends, at = (offset[begins] - offset[0]) // kind.itemsize, 0  # of buckets, in entries
        rows = np.frombuffer(bodies.buffers()[2], kind, int(ends[-1]), int(offset[0]))
        while at < len(ends) - 1:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            a, b = _tied(rows[ends[at] : ends[to]], four, five)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            at = to

    return by_cell(entries, work, "a long, b long")


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen lines with their sets, made anew from their first places."""
    wanted = chosen.groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.th").alias("_th")).agg(F.collect_list(F.col("first.number")).alias("numbers"))
    wanted = small(written(wanted, "wanted"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, numbers = text_bytes(part.column(0)), part.column(1).to_pylist()
            for a, b in chunks(texts):
                lines = Lines(texts[a:b])
                names = lines.names()
                asked = {(k, x) for k, of in enumerate(numbers[a:b]) for x in of}
                at = [k for k, x in enumerate(zip(lines.text.tolist(), lines.number.tolist(), strict=True)) if x in asked]
                for k in range(0, len(at), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in at[k : k + 5000]], pa.binary()), pa.array([lines.set(x).tobytes() for x in at[k : k + 5000]], pa.binary())], names=["id", "set"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = rows.join(wanted, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "numbers")
    return rows.mapInArrow(tidy(run), "id binary, set binary").join(small(chosen.select("id", "root", "n_group", F.lit(1).cast("long").alias("copies"), F.col("first").alias("ord"))), "id")


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, th and the sorted numbers (from 0) of the lines that go, for each document that loses any."""
    if not 0 < threshold <= 1:
        raise ValueError("thresholds are above 0 and at most 1")
    four, five = max(1, round(threshold * 100)), 100
    scanned = written(_scanned(docs), "lines")
    lines = scanned.where("id IS NOT NULL").drop("counts")
    logs = _sketch(scanned.where("id IS NULL").select("number", "counts"))
    place = F.struct("doc_id", "th", "number")
    firsts = written(lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n_lines"), F.first("name").alias("name")), "firsts")
    groups = grouped(_candidates(_entries(docs, logs, four, five), four, five))
    named = firsts.select(F.col("name").alias("node"), "id", "first")
    chosen = written(groups.withColumnRenamed("id", "node").join(named, "node"), "chosen")
    found = verified(_sets(docs, chosen), four, five).where("later").select("id").distinct()
    near = small(written(found, "similar")).withColumn("near", F.lit(True))
    gone = firsts.join(near, "id", "left").where("n_lines > 1 OR near")
    gone = small(written(gone.select("id", "first", F.coalesce("near", F.lit(False)).alias("near")), "gone"))
    hit = lines.join(gone, "id").where(F.col("near") | ~place.eqNullSafe(F.col("first")))
    return hit.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("number")).alias("removed"))


def _without(docs: DataFrame, threshold: float, into: str | None) -> DataFrame:
    gone = written(removed_lines(docs, threshold), "removed")
    gone = small(gone.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "removed"))
    rows = docs.join(gone, same_row(docs, gone), "left").select(*(docs[f"`{c}`"] for c in docs.columns), gone["removed"].alias("_gone_lines"))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            removed = part.column(part.num_columns - 1)
            hit = pc.greater(pc.fill_null(pc.list_value_length(removed), 0), 0)
            texts = []
            for text, of in zip(part.column(at).filter(hit).to_pylist(), removed.filter(hit).to_pylist(), strict=True):
                lost = set(of)
                texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in lost))
            made = part.columns if into else part.columns[:-1]
            if texts:
                made[at] = pc.replace_with_mask(part.column(at), hit, pa.array(texts, part.schema.field(at).type))
            yield pa.RecordBatch.from_arrays(made, names=names)

    names = [*docs.columns, into] if into else docs.columns
    schema = StructType([*docs.schema.fields, *([StructField(into, ArrayType(IntegerType()))] if into else [])])
    return rows.mapInArrow(tidy(run), schema)


def without_lines(docs: DataFrame, threshold: float = 0.8, into: str = "removed") -> DataFrame:
    """The rows of docs, their texts less the lines that go, and a new column with the numbers of these (null: none)."""
    if into in docs.columns:
        raise ValueError(f"the table has a column {into} already")
    return _without(docs, threshold, into)


def deduped(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows and columns of docs, their texts less the lines that go."""
    return _without(docs, threshold, None)
