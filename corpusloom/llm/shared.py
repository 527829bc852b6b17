"""Word tables over UTF-8 buffers, and tables in the folder that a cluster's machines share.

Words are told apart by 64-bit hashes, polynomials for short words. As those have known collisions for long
ones, words above LONG bytes have a cryptographic hash.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A word of the lower-cased text: digits, a-z and all bytes of non-ASCII characters. 0: a separator.
FOLD = np.zeros(256, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
#: A word between white space: everything but the space and the characters from tab to carriage return.
SPACED = np.arange(256, dtype=np.uint8)
SPACED[[0]] = 255  # 255 isn't in UTF-8; 0 stands for a separator
SPACED[[32, *range(9, 14)]] = 0

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_JOIN = np.uint64(0x9FB21C651E98DF25)
_tables: list[np.ndarray] = []

def trim() -> None:
    """Gives memory that is free back to the system, as workers live on and share a machine's memory with the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that trims at its end."""

    @functools.wraps(run)
    def wrapped(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        trim()

    return wrapped


#: Texts are taken together until they have so many bytes; a longer text stands alone.
CHUNK = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, CHUNK + 65_536)
        with np.errstate(over="ignore"):
            _tables[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, _BACK)]
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


#: Bytes of the longest word whose hash is a polynomial.
LONG = 32


class Words:
    """The words of several texts: for each its text, first and end byte, and a hash of its folded bytes.

    Equal words have equal hashes in every chunk, process and run.
    """

    def __init__(self, texts: list[bytes], fold: np.ndarray = FOLD, hashed: bool = True):
        self.texts = texts
        self.joined = b"\0".join(texts) + b"\0"
        self.raw = np.frombuffer(self.joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes + 1)])
        self.folded = fold[self.raw]
        if fold is SPACED:
            self.folded[self.begins[1:] - 1] = 0
        inside = np.concatenate([np.zeros(1, bool), self.folded != 0])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.begins)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        if hashed:
            power, back = _powers(len(self.raw) + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.folded * power[: len(self.raw)])])
                self.hashes = mix((total[self.ends] - total[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))
            for k in np.flatnonzero(self.ends - self.starts > LONG).tolist():
                self.hashes[k] = int.from_bytes(hashlib.blake2b(self.folded[self.starts[k] : self.ends[k]].tobytes(), digest_size=8).digest(), "little")

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each run of k words of a text, and the run's hash."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h, run, size, done = None, self.hashes, 1, 0  # run: of each size in the binary form of k
        with np.errstate(over="ignore"):
            while True:
                if k & size:
                    part = run[done : done + n]
                    h, done = part if h is None else mix(h * _JOIN + part), done + size
                if size * 2 > k:
                    break
                run, size = mix(run[:-size] * _JOIN + run[size:]), size * 2
        at = np.flatnonzero(self.owner[:n] == self.owner[k - 1 : k - 1 + n])
        return at, h[at]


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have at most so many bytes, or one text."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield at, i
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts):
        yield at, len(texts)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, or, where it is unset and all run on one machine, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/corpusloom-{uuid.uuid4().hex}/{name}"
    atexit.register(_delete, spark, os.path.dirname(path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: its lineage is cut, its size is known, lost executors can't lose it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table made by written() has."""
    spark, total = df.sparkSession, 0
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        total += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return total


#: A table is broadcast below so many rows, bytes of its files, and bytes of its values in memory.
BROADCAST_ROWS, BROADCAST_BYTES, BROADCAST_MEMORY = 500_000, 8 << 20, 64 << 20


def width(c: Column, kind: DataType) -> Column:
    """The bytes that a value takes in memory, about."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            return F.aggregate(F.coalesce(c, F.array().cast(kind)), F.lit(16).cast("long"), lambda total, x: total + width(x, kind.elementType))
        return F.coalesce(F.size(c), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, StructType):
        return sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    return F.lit(8).cast("long")


def small(df: DataFrame) -> DataFrame:
    """A table made by written(), marked for broadcast if it is proven small; else as it is, for a shuffled join."""
    if table_bytes(df) > BROADCAST_BYTES:
        return df
    size = df.agg(F.count("*").alias("rows"), F.sum(sum((width(df[f.name], f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_MEMORY else df


def same_row(docs: DataFrame, named: DataFrame) -> Column:
    """Whether a row of docs is the one that ``_doc`` (its doc_id) and ``_th`` (its text's hash) of another table name."""
    return docs["doc_id"].eqNullSafe(named["_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == named["_th"])


def batches(rows: dict[str, np.ndarray | list | pa.Array], schema: pa.Schema, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Columns of equal length as batches of bounded size."""
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in ((rows[t.name], t) for t in schema)]
    for at in range(0, len(arrays[0]), most):
        yield pa.RecordBatch.from_arrays([x.slice(at, most) for x in arrays], schema=schema)
