"""Shared helpers: document rows with a row key, UTF-8 bytes of Arrow text
columns as numpy arrays, blocks of bounded size inside a task."""

from __future__ import annotations

import ctypes
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass handles at a time inside a task.
BLOCK_BYTES = 2 << 20
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def find_modules(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver has it
    (same place on every machine; else send it with ``--py-files``)."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_modules(spark).read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``row_key``, a hash of both: rows that repeat
    a doc_id with another text stay apart in joins.  Other columns of the
    input are left out, so their names cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.xxhash64("doc_id", "text").alias("row_key"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on ``row_key`` and a null-safe ``doc_id``."""
    return (left["row_key"] == right["row_key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give freed memory back at the end of a task: workers live on and serve
    the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """(first, end) rows of consecutive blocks of about ``limit`` bytes; a
    longer text is a block of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit hashes (wrapping)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def rolling(values: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial in ``base`` over each ``width`` consecutive 64-bit values
    (wrapping), by doubling; one result for each place where they fit."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, span, out, done, left = values, 1, None, 0, width
    while left:
        if left & 1:
            part = h[done:done + n]
            out = part.copy() if out is None else out * np.uint64(pow(base, span, 1 << 64)) + part
            done += span
        left >>= 1
        if left:
            h = h[:len(h) - span] * np.uint64(pow(base, span, 1 << 64)) + h[span:]
            span *= 2
    return out


class WordHasher:
    """64-bit hashes of words given as byte ranges of one array: a polynomial
    over the bytes by prefix sums, freed of its offset by the inverse power."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of the polynomial over ``data``."""
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = powers(self.base, n), powers(self.inverse, n)
        total = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n - 1], out=total[1:])
        return total

    def between(self, total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges, from the prefix sums."""
        return mix64((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.between(self.sums(data), start, end)


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross the rows given by
    ``offsets``: (start, end, number of runs before each row)."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    first[inner] = mask[inner]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = mask[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets, side="left")


#: Bytes 0x20 and 0x09-0x0D, which part words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
