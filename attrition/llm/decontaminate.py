"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are compared as characters, with A-Z in lower case
and white space collapsed.  An item is cut into overlapping segments of at
most ``SEGMENT`` characters (a shorter one is a segment itself).  If a region
of a text is within k edits of a segment of m characters, they share at least
m - q + 1 - k*q q-grams on k + 1 neighbouring diagonals, so shared q-grams are
counted in overlapping bands of diagonals.  Bands that reach the bound are
verified by alignment inside the band.

The benchmark is indexed in blocks of a bounded number of characters, each
broadcast in turn and held against all documents, so its size has no limit.
Nothing is shuffled.

Null and empty texts and items match nothing, nor do items of fewer than q
characters.  Repeated rows are judged each on its own; other columns are
ignored; with an empty benchmark every document is clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import mix64, rolling, row_blocks, utf8

Q, RATE, SEGMENT, STEP = 10, 0.08, 160, 80
#: Diagonals from one band to the next; every k + 1 of them lie in one band.
BAND = 16
#: Candidates aligned at a time.
ALIGNED = 2048
#: Characters of the benchmark indexed at a time.
INDEX_CHARS = 1_000_000
TABLE_BITS = 22


def normal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(characters in lower case with white space collapsed, their places)."""
    space = (codes == 0x20) | ((codes >= 9) & (codes <= 13))
    keep = ~space
    keep[:1] = True
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    out = np.where(space, 0x20, codes)[at]
    return out + 32 * ((out >= 65) & (out <= 90)).astype(out.dtype), at


def grams(codes: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place on."""
    return mix64(rolling(codes.astype(np.uint64) + np.uint64(1), Q))


@dataclass
class Index:
    """Segments of benchmark items and their q-grams, by hash."""
    item: np.ndarray            # item of a segment
    text: list[np.ndarray]
    budget: np.ndarray          # edits allowed
    bound: np.ndarray           # q-grams shared at least
    hashes: np.ndarray          # distinct, in order
    first: np.ndarray           # where each hash's places begin
    segment: np.ndarray         # places by hash
    place: np.ndarray
    table: np.ndarray           # which leading hash bits occur


def build(items: list[tuple[int, str]]) -> Index:
    item, text = [], []
    for key, s in items:
        codes, _ = normal(np.frombuffer((s or "").strip().encode("utf-32-le", "surrogatepass"), np.uint32))
        n = len(codes)
        cuts = [0] if n <= SEGMENT else [*range(0, n - SEGMENT, STEP), n - SEGMENT]
        for c in cuts:
            if n >= Q:
                item.append(key)
                text.append(codes[c:c + SEGMENT])
    size = np.array([len(t) for t in text], np.int64)
    budget = np.minimum((size * RATE).astype(np.int64), (size - Q) // Q)
    hashes = [grams(t) for t in text]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    segment = np.repeat(np.arange(len(text)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    distinct, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[distinct >> np.uint64(64 - TABLE_BITS)] = True
    return Index(np.array(item, np.int64), text, budget, size - Q + 1 - budget * Q, distinct,
                 np.append(first, len(flat)), segment[order], place[order], table)


def shared_grams(index: Index, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the text, segment, place in the segment) of shared q-grams."""
    h = grams(codes)
    at = np.flatnonzero(index.table[h >> np.uint64(64 - TABLE_BITS)])
    if not len(at) or not len(index.hashes):
        return (np.zeros(0, np.int64),) * 3
    k = np.minimum(np.searchsorted(index.hashes, h[at]), len(index.hashes) - 1)
    same = index.hashes[k] == h[at]
    at, k = at[same], k[same]
    n = index.first[k + 1] - index.first[k]
    use = np.repeat(index.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), index.segment[use], index.place[use]


def bands(index: Index, row: np.ndarray, at: np.ndarray, segment: np.ndarray, place: np.ndarray):
    """(row, segment, band, q-grams) of bands that reach their segment's
    bound.  A band covers the diagonals [band * BAND, band * BAND + 2 * BAND)."""
    band = (at - place + SEGMENT) // BAND       # not negative
    n, width = len(index.text), int(band.max()) + 2
    key = (row * n + segment) * width + band
    key, count = np.unique(np.concatenate([key, (key - 1)[band > 0]]), return_counts=True)
    pair = key // width
    ok = count >= index.bound[pair % n]
    return pair[ok] // n, pair[ok] % n, key[ok] % width, count[ok]


def align(index: Index, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray, segment: np.ndarray, band: np.ndarray):
    """(edits, start, end) of each candidate's best alignment within its band:
    the whole segment against a stretch of the text ``codes[begin:stop]``.
    Cost and start travel together in one integer, so equal costs keep the
    earliest start."""
    n, width = len(segment), 2 * BAND
    size = np.array([len(index.text[s]) for s in segment])
    longest = int(size.max())
    seg = np.full((n, longest), -2, np.int64)
    for i, s in enumerate(segment):
        seg[i, :size[i]] = index.text[s]
    low = band * BAND - SEGMENT
    offset = np.arange(width)
    unit = 1 << 16
    state = np.broadcast_to(offset, (n, width)).astype(np.int64).copy()
    final = np.zeros((n, width), np.int64)
    for i in range(1, longest + 1):
        j = (begin + low + i - 1)[:, None] + offset     # character of the text on each diagonal
        inside = (j >= begin[:, None]) & (j < stop[:, None])
        there = np.where(inside, codes[np.clip(j, 0, len(codes) - 1)].astype(np.int64), -1)
        step = state + unit * (there != seg[:, i - 1:i])
        step[:, :-1] = np.minimum(step[:, :-1], state[:, 1:] + unit)
        state = np.minimum.accumulate(step - unit * offset, axis=1) + unit * offset
        ended = size == i
        final[ended] = state[ended]
    best = final.argmin(1)
    value = final[np.arange(n), best]
    return value // unit, low + value % unit, low + size + best


def row_matches(index: Index, codes: np.ndarray, begin: np.ndarray) -> dict[int, list[tuple]]:
    """Best (item, regions, start, end, edits, q-grams) per item of each text
    that holds any; the texts lie one after the other in ``codes`` from the
    places ``begin`` (and its end) on, results are places in the text."""
    flat, where = normal(codes)
    start_of = np.searchsorted(where, begin)
    at, segment, place = shared_grams(index, flat)
    row = np.searchsorted(start_of, at, side="right") - 1
    inside = at + Q <= start_of[row + 1]
    row, segment, at = row[inside], segment[inside], at[inside] - start_of[row[inside]]
    out: dict[int, list[tuple]] = {}
    if not len(row):
        return out
    row, segment, band, count = bands(index, row, at, segment, place[inside])
    regions: dict[tuple[int, int], set] = {}
    for i in range(0, len(row), ALIGNED):
        r, s = row[i:i + ALIGNED], segment[i:i + ALIGNED]
        edits, start, end = align(index, flat, start_of[r], start_of[r + 1], s, band[i:i + ALIGNED])
        for k in np.flatnonzero(edits <= index.budget[s]):
            first = start_of[r[k]] + max(int(start[k]), 0)
            last = min(start_of[r[k]] + int(end[k]), start_of[r[k] + 1]) - 1
            regions.setdefault((int(r[k]), int(index.item[s[k]])), set()).add(
                (int(edits[k]), int(where[first] - begin[r[k]]), int(where[last] - begin[r[k]]) + 1, int(count[i + k])))
    for (r, item), found in sorted(regions.items()):
        edits, first, last, shared = min(found)
        out.setdefault(r, []).append((item, len({f[1:3] for f in found}), first, last, edits, shared))
    return out


def column_matches(index: Index, column: pa.Array):
    """The matches of each text of an Arrow column, in blocks."""
    data, offsets = utf8(column)
    for i, j in row_blocks(offsets):
        block = data[offsets[i]:offsets[j]]
        codes = np.frombuffer(block.tobytes().decode().encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((block & 0xC0) != 0x80)])[offsets[i:j + 1] - offsets[i]]
        found = row_matches(index, codes, chars)
        for r in range(j - i):
            yield found.get(r, [])


def blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``INDEX_CHARS`` characters; one block
    at a time is on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-int(total) // INDEX_CHARS))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield sorted((NO_ITEM if r["item_id"] is None else r["item_id"], r["text"]) for r in part.collect())


#: Stands for a null item id inside tasks.
NO_ITEM = -(1 << 63)
SCHEMA = "doc_id long, item_id long, n_regions long, start long, end long, edits long, q_grams long"


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: the region with
    the fewest edits (code points of the text, end exclusive)."""
    spark, out = docs.sparkSession, None
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(build(items))

        def run(batches, shared=shared):
            for batch in batches:
                found = [(d, None if m[0] == NO_ITEM else m[0], *m[1:]) for d, ms in zip(batch.column(0).to_pylist(),
                                                  column_matches(shared.value, batch.column(1))) for m in ms]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)],
                                                     names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(build(items))

        def run(batches, shared=shared):
            for batch in batches:
                yield batch.filter(pa.array([not m for m in column_matches(shared.value, batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
