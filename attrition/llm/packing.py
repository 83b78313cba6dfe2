"""Packing by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows of the capacity and a rest; the
rest is cut into pieces of at most ``PIECE`` tokens.  Pieces are gathered in
groups of ``GROUP`` inside a task.  A group's total gives the least number of
windows.  Differencing starts from one partial partition per piece (one window
filled, the others empty) and merges, again and again, the two partial
partitions whose windows differ most, the fullest windows of one with the
emptiest of the other, until one is left: near-equal windows.  If a window
exceeds the capacity, the number of windows rises and the group is done again.

Nulls and empty texts have the end token alone.  Repeated rows are packed each
on its own; a text of any length is tokenized whole; other columns are
ignored; an empty table gives no rows.  Nothing is shuffled: a lost task is
done again with the same result, sequence ids come from the partition number.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from attrition.llm.common import release

CAPACITY, PIECE, GROUP, END_ID = 2048, 512, 768, 1
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000


def difference(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Karmarkar-Karp: (sum, members) of each of ``windows`` windows (empty
    ones left out).  A partial partition lists its filled windows, the fullest
    first; the rest are empty."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)] if windows > 1 else []
    if windows == 1:
        return [(sum(sizes), list(range(len(sizes))))] if sizes else []
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        both = len(a) + len(b) - windows    # so many of b's windows fall on filled ones of a
        if both <= 0:
            merged = a + b
        else:
            free = len(b) - both            # b's fullest go to windows that a leaves empty
            over = b[free:]
            keep = len(a) - both
            merged = a[:keep] + b[:free]
            # the emptiest of a meet the fullest of what is left of b
            merged += [(x + y, p + q) for (x, p), (y, q) in zip(a[keep:], reversed(over))]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == windows else 0
        turn += 1
        heapq.heappush(heap, (least - merged[0][0], turn, merged))
    return heap[0][2] if heap else []


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Members of near-equal windows within the capacity."""
    if not sizes:
        return []
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        filled = difference(sizes, n)
        if max(s for s, _ in filled) <= capacity:
            return [m for _, m in filled]
        n += 1


def cut(n_tokens: int, capacity: int = CAPACITY, piece: int = PIECE) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of a document's full windows, and of the pieces of its
    rest (as few as ``piece`` allows, of near-equal length)."""
    full = [(s, capacity) for s in range(0, n_tokens - capacity + 1, capacity)]
    rest = n_tokens - len(full) * capacity
    k = -(-rest // piece)
    edge = [len(full) * capacity + rest * i // k for i in range(k + 1)] if k else []
    return full, [(a, b - a) for a, b in zip(edge, edge[1:])]


def _byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


#: Marks after a word that the tokenizer parts from its letters.
STOPS = ".,:;!?*#$%&|"


class Encoder:
    """Token ids of a text as little-endian 32-bit bytes.  The tokenizer parts
    words at white space and letters from the marks after them, so words and
    marks are encoded once and remembered.  A word of letters goes straight to
    the vocabulary's merges, any other through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.characters = _byte_characters()
        self.known: dict[str, bytes] = {}
        self.stop: dict[str, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters, None for any other."""
        if word.isascii():
            low = word.lower()
        elif max(word) < "\u0250" and is_normalized("NFC", word):
            low = "".join(map(str.lower, word))
        else:
            return None
        if not low.isalpha() or max(low) >= "\u0250":
            return None
        got = self.known.get(low)
        if got is None:
            mapped = low if low.isascii() else "".join([self.characters[b] for b in low.encode()])
            got = array("I", [t.id for t in self.merge(mapped)]).tobytes()
            self.known[low] = got
        return got

    def word(self, word: str) -> bytes:
        core = word.rstrip(STOPS)
        got = self._letters(core) if core else b"" if not word else None
        if got is None:
            got = self._whole(word)
        elif len(core) < len(word):
            rest = word[len(core):]
            if rest not in self.stop:
                self.stop[rest] = self._whole(rest)
            got = got + self.stop[rest]
        self.known[word] = got
        return got

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        out, get = [], self.known.get
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            ids = list(map(get, words))
            if None in ids:
                ids = [self.word(w) if i is None else i for w, i in zip(words, ids)]
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)
#: Texts encoded at a time, in characters.
TEXT_BLOCK = 4 << 20


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, capacity: int = CAPACITY,
         piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """One row per piece of the documents; ``with_ids`` adds the piece's ids."""

    def run(batches):
        encode = encoder(tokenizer_path)
        first = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []      # finished pieces
        wait: list[tuple] = []      # pieces of the group that fills up

        def place(members: list[tuple]) -> None:
            nonlocal first
            at = 0
            for doc, s, length, ids, total in members:
                rows.append((doc, s, length, zlib.crc32(ids), total, first, at, ids))
                at += length
            first += 1

        def close() -> None:
            for members in windows_of([w[2] for w in wait], capacity):
                place([wait[i] for i in members])
            wait.clear()

        def out():
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
            if with_ids:
                ends = np.cumsum([0] + [r[2] for r in rows]).astype(np.int32)
                ids = np.frombuffer(b"".join(r[7] for r in rows), "<u4").astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)))
            batch = pa.RecordBatch.from_arrays(cols, names=COLUMNS + ["ids"] * with_ids)
            rows.clear()
            return batch

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").to_pylist()
            for i, j in _blocks(texts):
                for doc, ids in zip(doc_ids[i:j], encode(texts[i:j])):
                    ids += END
                    total = len(ids) // 4
                    full, rest = cut(total, capacity, piece)
                    for s, n in full:
                        place([(doc, s, n, ids[4 * s:4 * (s + n)], total)])
                    wait += [(doc, s, n, ids[4 * s:4 * (s + n)], total) for s, n in rest]
                    if len(wait) >= group:
                        close()
                if rows:
                    yield out()
        close()
        if rows:
            yield out()
        release()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, SCHEMA + (", ids array<int>" if with_ids else ""))


END = np.array([END_ID], "<u4").tobytes()


def _blocks(texts: list[str]):
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > TEXT_BLOCK:
            yield i, j
            i, size = j, 0
        size += len(t)
    if texts:
        yield i, len(texts)
