"""Helpers shared by the operators: Arrow access, byte-window hashing, work folders.

Texts are handled as UTF-8 bytes in slices of bounded size, so a task's memory
does not depend on how many documents its partition holds.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: bytes of text that a task handles at once
SLICE = 2 << 20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        for name, base in (("p", BASE), ("i", INVERSE)):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xA0761D6478BD642F)
    h ^= h >> U(32)
    return h


class Rolling:
    """Hashes of any substring of one byte array, equal for equal strings."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    def every(self, k: int) -> np.ndarray:
        """Of the k bytes from every position on."""
        n = max(0, len(self.sums) - k)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U(k))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 bounds of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes together; a longer row comes alone."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
#: bytes of words: digits, a-z (after lower-casing) and all of multi-byte characters
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
#: bytes that end a white-space token
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true flags; a run does not cross a row's bounds."""
    if len(flags) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    begins = flags.copy()
    begins[1:] &= ~flags[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[cuts < len(flags)]
    begins[cuts] = flags[cuts]
    starts = np.flatnonzero(begins)
    closes = flags.copy()
    closes[:-1] &= ~flags[1:]
    last = cuts[cuts > 0] - 1
    closes[last] = flags[last]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


class KeyTable:
    """Open-addressing table from distinct 64-bit keys to row numbers, looked up in bulk."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = (keys * U(BASE) >> self.shift).astype(np.int64)
        while len(left):
            free = self.rows[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[slot], self.rows[slot] = keys[who], who
            stay = self.rows[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it has none."""
        at = (keys * U(BASE) >> self.shift).astype(np.int64)
        out = self.rows[at]
        left = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            rows = self.rows[at]
            out[left] = rows
            stay = (rows >= 0) & (self.keys[at] != keys[left])
            left, at = left[stay], at[stay]
        return out


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 for every i, and i for each."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def trim() -> None:
    """Give free memory back to the system: a worker lives through many stages, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    if "://" not in at and not at.startswith("file:"):
        at = "file://" + at
    return ("file://" + at[5:]) if at.startswith("file:/") and not at.startswith("file://") else at


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, under this application's own."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Work:
    """Tables written on the way to a result; each can be deleted as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths, self.folders = spark, name, {}, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = work_dir(self.spark, self.name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        self.free()
        return out

    def free(self) -> None:
        """Spark deletes a finished query's shuffle files once the driver has collected its plan."""
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths.pop(id(t))[0])

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables but ``keep``."""
        self.drop(*(t for _, t in list(self.paths.values()) if not any(t is k for k in keep)))
        while self.folders:
            remove(self.spark, self.folders.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def empty_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
