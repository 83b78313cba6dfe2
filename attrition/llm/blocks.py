"""Questions from blocks of documents to parts of a hash space.

Documents are dealt into blocks of bounded size by a hash of the row.  A block
asks about many hashes: they are made distinct, put in order and cut by part,
so a message is one packed array and a hash that occurs a million times in the
corpus is asked once by each block.  A part sees all blocks' messages for its
range of hashes and answers each entry with one byte.  Blocks read the answers
beside their documents.  The documents are shuffled once: all steps read the
same exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import keyed, utf8

BLOCK_BYTES = 4 << 20
MESSAGE = "part long, block long, n long, payload binary"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, row_key and the text's UTF-8 bytes, compressed: less to shuffle
    (a null text counts as empty)."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            view = memoryview(np.ascontiguousarray(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([squeeze(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                names=["doc_id", "row_key", "packed"])

    return keyed(docs).mapInArrow(run, "doc_id long, row_key long, packed binary")


def unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of compressed texts."""
    expand = zstandard.ZstdDecompressor().decompress
    texts = [expand(z) for z in column.to_pylist()]
    return (np.frombuffer(b"".join(texts), np.uint8),
            np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, packed text and block of each document, and the number of
    blocks."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, math.ceil(((size["b"] or 0) + 64 * size["n"]) / block_bytes))
    return packed(docs).select("doc_id", "packed", F.pmod("row_key", F.lit(n)).alias("block")), n


def documents_of(part: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, bytes, offsets) of a block's documents, always in one order."""
    part = part.sort_by([("doc_id", "ascending"), ("packed", "ascending")])
    return part["doc_id"], *unpacked(part["packed"])


def cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's slice of ordered hashes begins (and the end)."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, bounds), [len(hashes)]])


def messages(block: int, parts: int, *arrays: np.ndarray) -> list[tuple]:
    """One message per part that the first array (ordered hashes) reaches;
    the other arrays are cut alike and follow it in the payload."""
    at = cuts(arrays[0], parts)
    return [(p, block, int(at[p + 1] - at[p]), b"".join(np.ascontiguousarray(a[at[p]:at[p + 1]]).tobytes() for a in arrays))
            for p in np.flatnonzero(np.diff(at)).tolist()]


def unpack(payload: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    """The arrays of a message, by numpy type."""
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(payload, k, n, at))
        at += size
    return out


def table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows as an Arrow table; ``schema`` has long and binary columns."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    cols = [c.split() for c in schema.split(", ")]
    data = list(zip(*rows)) if rows else [[]] * len(cols)
    return pa.table({name: pa.array(list(c), kinds[k]) for (name, k), c in zip(cols, data)})


def reply(messages_: pa.Table, judge, kinds: tuple[str, ...]) -> pa.Table:
    """A part's answers: ``judge(block of each entry, arrays)`` gives one byte
    for each entry; they go back, packed, to the blocks that asked."""
    rows = messages_.to_pylist()
    arrays = [unpack(r["payload"], r["n"], *kinds) for r in rows]
    of = np.repeat([r["block"] for r in rows], [r["n"] for r in rows])
    found = judge(of, *[np.concatenate(c) for c in zip(*arrays)]).astype(np.uint8)
    ends = np.cumsum([r["n"] for r in rows])
    return table([(r["part"], r["block"], r["n"], found[e - r["n"]:e].tobytes()) for r, e in zip(rows, ends)], MESSAGE)


def answers(asked: DataFrame, judge, kinds: tuple[str, ...]) -> DataFrame:
    """``reply`` for each part.  A message with a negative part is a block's
    note to itself and is passed on."""

    def run(messages_: pa.Table) -> pa.Table:
        return messages_ if messages_["part"][0].as_py() < 0 else reply(messages_, judge, kinds)

    return asked.groupBy("part").applyInArrow(run, MESSAGE)


def answered(replies: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """A block's answers in the order of what it asked, and its notes."""
    rows = sorted(replies.to_pylist(), key=lambda r: r["part"])
    got = [np.frombuffer(r["payload"], np.uint8) for r in rows if r["part"] >= 0]
    return (np.concatenate(got) if got else np.zeros(0, np.uint8)), [r["payload"] for r in rows if r["part"] < 0]


def note(block: int, payload: bytes) -> tuple:
    return (-1 - block, block, 0, payload)
