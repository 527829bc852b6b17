"""Local encoders that stand in for models: hashed counts of words and character pairs. A registry names them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import normalised

#: Words that a worker remembers, slots for pairs that it does, and characters that are counted at a time.
MEMORY, SLOT_BITS, CHARS = 500_000, 20, 1 << 18


def _place(token: str, size: int) -> int:
    return int.from_bytes(hashlib.md5(token.encode("utf-8", "replace"), usedforsecurity=False).digest()[:4], "big") % size


class _Words(dict):
    """The places of words, each found when it is first asked for; a full memory is emptied."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = at = _place(word, self.size)
        return at


class _Pairs:
    """The places of character pairs, given as numbers. Each pair has a slot of a table of fixed size; the last pair that missed there is the one kept."""

    def __init__(self, size: int):
        self.size, self.shift = size, np.uint64(64 - SLOT_BITS)
        self.kept, self.at = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int32)

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def places(self, pairs: np.ndarray) -> np.ndarray:
        slots = self._slots(pairs)
        out = self.at[slots]
        new = np.flatnonzero(self.kept[slots] != pairs)
        if len(new):
            names, back = np.unique(pairs[new], return_inverse=True)
            made = np.array([_place(chr(p >> 21) + chr(p & 0x1FFFFF), self.size) for p in names.tolist()], np.int32)
            out[new] = made[back]
            slots, last = np.unique(self._slots(names), return_index=True)  # of pairs with one slot one is kept
            self.kept[slots], self.at[slots] = names[last], made[last]
        return out


def _counts(texts: list[str], size: int, words: _Words, pairs: _Pairs) -> np.ndarray:
    """Counts by place of each lower-case text."""
    n, split = len(texts), [x.split() for x in texts]
    lengths = [len(x) for x in split]
    rows = np.repeat(np.arange(n) * size, lengths)
    out = np.bincount(rows + np.fromiter(map(words.__getitem__, chain.from_iterable(split)), np.int64, len(rows)), minlength=n * size)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([0, *map(len, texts)])
    for a in range(0, len(points) - 1, CHARS):
        b = min(a + CHARS, len(points) - 1)
        some = points[a : b + 1].astype(np.int64)
        rows = np.repeat(np.arange(n) * size, np.diff(np.clip(ends, a, b)))
        rows[ends[(ends > a) & (ends <= b)] - a - 1] = n * size  # pairs of two texts count for none
        rows += pairs.places(some[:-1] << 21 | some[1:])
        out += np.bincount(rows, minlength=n * size)[: n * size]
    return out.reshape(n, size)


def _stretches(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in lists of about CHARS characters."""
    held, length = [], 0
    for x in texts:
        held.append(x)
        length += len(x)
        if length >= CHARS:
            yield held
            held, length = [], 0
    if held:
        yield held


def hashed_counts(rows: DataFrame, key: str, text: str, size: int = 128) -> DataFrame:
    """key and counts: how many of the text's words and character pairs fall on each of so many places.

    A token's place is the first 32 bits of its MD5, modulo the size, so it is the same in every run. Nulls and
    empty texts have zeros alone. Pairs are counted as numbers, many texts at a time, and a long text in pieces.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = _Words(size), _Pairs(size)
        for part in parts:
            lower = ((x.as_py() or "").lower() for x in part.column(1))
            out = np.concatenate([np.zeros((0, size), np.int64), *(_counts(some, size, words, pairs) for some in _stretches(lower))])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=[key, "counts"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, counts array<long>")


def hashed_vectors(rows: DataFrame, key: str, text: str, size: int = 128) -> DataFrame:
    """key and embedding: hashed_counts of unit length."""
    return hashed_counts(rows, key, text, size).select(key, normalised(F.col("counts")).alias("embedding"))


def digest_vectors(rows: DataFrame, key: str, text: str, size: int = 384) -> DataFrame:
    """key and embedding: the bytes of the text's SHA-256, over and over, as short floats, of unit length.

    Equal texts have equal vectors, and others have nothing in common: for tests alone. What isn't a number, or is beyond
    1e30, counts as 0; a vector of zeros has a 1 in front. A null is an empty text.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            digests = b"".join(hashlib.sha256((x or "").encode("utf-8", "replace")).digest() for x in part.column(1).to_pylist())
            short = np.frombuffer(digests, "<f4").reshape(part.num_rows, 8).astype(np.float64)
            short = np.tile(np.where(np.abs(short) < 1e30, short, 0.0), -(-size // 8))[:, :size]  # a comparison with NaN doesn't hold
            long = np.sqrt((short * short).sum(axis=1))
            short[long == 0, 0] = 1.0
            out = short / np.where(long == 0, 1.0, long)[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=[key, "embedding"])

    return rows.select(key, text).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<double>")


#: Encoders by name: (rows, key, text) to key and embedding. Models may be added.
ENCODERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {"hash-128": hashed_vectors, "digest-384": digest_vectors}


def encoder(name: str) -> Callable[[DataFrame, str, str], DataFrame]:
    """The encoder of a name."""
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name}; there are {sorted(ENCODERS)}")
    return ENCODERS[name]
