"""A quality classifier: vectors of hashed words and character n-grams, averaged for each document
by kind (words, word pairs, n-grams of each length).

The vectors and a softmax layer over two classes are learned by stochastic gradient descent in numpy,
on a bounded sample of labelled rows. As the layer is linear in the average, scoring needs one number
a bucket: the difference of the classes' scores. So scoring is one narrow pass with a table of fixed
size (BUCKETS floats) whatever the corpus is.

Nulls and empty texts get the score of the layer's bias. A row without doc_id counts as not held out.
Repeated rows get equal scores. Where no labelled row can be learned from, every score is 0.5. Texts of any length are
scored whole; only what is learned from is bounded. An empty table gives no row, and other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACED, Words, chunks, text_bytes

BUCKETS = 1 << 17
GRAMS = (3, 4)
WIDTH = 16
#: The sample to learn from: labelled rows of at most so many bytes, those first by a hash of doc_id.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32_768
EPOCHS, RATE, LEAST_STEPS = 4, 0.5, 8000


def buckets(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, word pairs and each n-gram length: buckets in order, and where each text's begin and end.

    All pairs of a word with itself share a bucket.
    """
    t = Words(texts, SPACED)
    ends = t.begins[1:] - 1
    out = [((t.hashes >> np.uint64(40)).astype(np.uint32) % np.uint32(BUCKETS), t.first[:-1], t.first[1:])]
    with np.errstate(over="ignore"):
        pair = ((t.hashes[:-1] * np.uint64(3) + t.hashes[1:]) >> np.uint64(40)).astype(np.uint32) % np.uint32(BUCKETS)
    pair[t.hashes[:-1] == t.hashes[1:]] = BUCKETS - 1
    out.append((pair, np.minimum(t.first[:-1], len(pair)), np.minimum(np.maximum(t.first[1:] - 1, t.first[:-1]), len(pair))))
    raw = t.raw.astype(np.uint32)
    for n in GRAMS:
        if len(raw) < n:
            continue
        key = raw[: len(raw) - n + 1].copy()
        for i in range(1, n):
            key |= raw[i : len(raw) - n + 1 + i] << np.uint32(8 * i)
        key = (key ^ (key >> np.uint32(15))) * np.uint32(2654435761 + 2 * n)
        first = np.minimum(t.begins[:-1], len(key))  # short texts at the end have no n-gram
        last = np.maximum(np.minimum(ends - n + 1, len(key)), first)
        out.append(((key ^ (key >> np.uint32(13))) % np.uint32(BUCKETS), first, last))
    return out


@dataclass
class Model:
    """What scoring needs: a number for each bucket and one for the bias."""

    table: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The softmax's probability of class 1 for each text."""
        total = np.full(len(texts), self.bias)
        for b, first, last in buckets(texts):
            sums = np.concatenate([np.zeros(1), np.cumsum(self.table[b], dtype=np.float64)])
            total += (sums[last] - sums[first]) / np.maximum(last - first, 1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def learn(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """Vectors and layer by stochastic gradient descent, one document a step, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    known = []
    for a, b in chunks(texts):
        parts = buckets(texts[a:b])
        for i in range(b - a):
            kinds = [x[first[i] : last[i]] for x, first, last in parts]
            found, place = np.unique(np.concatenate(kinds), return_inverse=True)
            share = np.concatenate([np.full(len(x), 1 / max(1, len(x))) for x in kinds])
            known.append((found, np.bincount(place, weights=share, minlength=len(found)).astype(np.float32)))
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, len(texts))))
    steps, step = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            found, share = known[i]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = share @ vectors[found]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            vectors[found] -= (rate * share)[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row may never be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels to learn from, at most ``rows`` of at most ``most`` bytes; none of them is held out."""
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    )
    if not chosen:
        return [], []
    ids = spark.createDataFrame([tuple(r) for r in chosen], f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, quality int")
    found = (
        docs.select("doc_id", "text").where(F.octet_length("text") <= most)
        .join(F.broadcast(ids), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows).collect()
    )
    return [r["text"].encode() for r in found], [r["quality"] for r in found]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row."""
    texts, known = sample(docs, labels)
    model = learn(texts, known) if texts else Model(np.zeros(BUCKETS, np.float32), 0.0)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.table, model.bias))  # BUCKETS floats, whatever the corpus

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for part in parts:
            rows = text_bytes(part.column(1))
            scores = np.zeros(len(rows))
            for a, b in chunks(rows):
                scores[a:b] = own.score(rows[a:b])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
