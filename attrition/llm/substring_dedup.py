"""Repeated passages of words, found by difference-cover anchors.

A window is ``WINDOW`` consecutive words.  Anchors are runs of ``ANCHOR``
words that begin at cover places only: places whose number in the document,
modulo ``PERIOD``, is in ``COVER``.  ``COVER`` is a difference cover: for any
two windows there is a shift below ``PERIOD`` at which both have a cover
place, and ``PERIOD - 1 + ANCHOR <= WINDOW``, so equal windows share an aligned
anchor.  Windows around an anchor that occurs twice are extended: the whole
window is compared by a 96-bit hash of its words, and every occurrence but the
earliest (smallest doc_id, then start) is removed.  A document whose whole
word sequence occurs under a smaller id is removed at once.

Nulls and empty texts have no words.  A null id counts as the smallest.  Rows
with the same id are one document for the order: of two equal windows at the
same place of the same id neither is earlier.  Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attrition.llm.blocks import MESSAGE, answered, answers, blocked, documents_of, messages, note, reply, table
from attrition.llm.common import SPACE, WordHasher, mix64, powers, rolling, spans_of

WINDOW, PERIOD, COVER, ANCHOR = 20, 13, (0, 1, 3, 9), 8
#: A second base, for the other 32 bits of a window's hash.
OTHER_BASE = 0xD6E8FEB86659FD93
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
LEAST = np.iinfo(np.int64).min


class Words:
    """Words of a block's documents, their hashes, and windows over them."""

    def __init__(self, docs: pa.Table, window: int = WINDOW):
        self.window = window
        self.ids, self.data, self.offsets = documents_of(docs)
        self.doc = self.ids.fill_null(LEAST).to_numpy()
        self.start, self.end, self.before = spans_of(~SPACE[self.data], self.offsets)
        self.hash = WordHasher()(self.data, self.start, self.end)
        self.row = np.repeat(np.arange(len(self.doc)), np.diff(self.before))
        self.place = np.arange(len(self.row)) - self.before[self.row]
        self.left = self.before[self.row + 1] - np.arange(len(self.row))    # words from here to the end

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit hashes of the windows that begin at the words ``at``."""
        first = mix64(rolling(self.hash, self.window))
        second = mix64(rolling(self.hash, self.window, OTHER_BASE))
        return first[at], (second[at] >> np.uint64(32)).astype(np.uint32)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(words where anchors begin, their hashes)."""
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= ANCHOR))
        return at, mix64(rolling(self.hash, ANCHOR))[at]

    def sequences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of at least a window, two hashes of their whole sequence)."""
        rows = np.flatnonzero(np.diff(self.before) >= self.window)
        n = len(self.hash)
        out = []
        for base in (OTHER_BASE, 0xA24BAED4963EE407):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * powers(base, n))])
            inverse = np.array([pow(base, -int(b), 1 << 64) for b in self.before[rows]], np.uint64)
            out.append(mix64((total[self.before[rows + 1]] - total[self.before[rows]]) * inverse
                             + np.diff(self.before)[rows].astype(np.uint64)))
        return rows, out[0], (out[1] >> np.uint64(32)).astype(np.uint32)


def earliest(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries are an earliest one of those with their hash."""
    order = np.lexsort((start, doc, h2, h))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(h2[order]) != 0)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    out = np.zeros(len(h), bool)
    out[order] = (doc[head] == doc[order]) & (start[head] == start[order])
    return out


def firsts(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """One entry per distinct hash, in order: (index of an earliest entry,
    number of each entry's hash)."""
    order = np.lexsort((start, doc, h2, h))
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(h[order]) != 0) | (np.diff(h2[order]) != 0)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def split_answers(got: np.ndarray, *sizes: int) -> list[np.ndarray]:
    return np.split(got, np.cumsum(sizes)[:-1])


def deduplicate(docs: DataFrame, with_text: bool = False, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words removed, and the kept words joined
    by one space (their SHA-256 and, if asked for, the text)."""
    if PERIOD - 1 + ANCHOR > window:
        raise ValueError("a window has to hold an anchor at every shift")
    rows, n = blocked(docs)
    # parts 0 .. n-1 are asked about anchors, n .. 2n-1 about whole sequences

    def ask(part: pa.Table) -> pa.Table:
        words, block = Words(part, window), part["block"][0].as_py()
        _, h = words.anchors()
        distinct = np.unique(h)
        own, s1, s2 = words.sequences()
        head, _ = firsts(s1, s2, words.doc[own], np.zeros(len(own), np.int64))
        out = messages(block, n, distinct)
        whole = messages(block, n, s1[head], s2[head], words.doc[own][head])
        return table(out + [(p + n, *rest) for p, *rest in whole], MESSAGE)

    def answer(messages_: pa.Table) -> pa.Table:
        kinds = ("u8",) if messages_["part"][0].as_py() < n else ("u8", "u4", "i8")

        def judge(block, h, *more):
            if not more:    # anchors: asked by two blocks
                _, number, count = np.unique(h, return_inverse=True, return_counts=True)
                return count[number] > 1
            return earliest(h, more[0], more[1], np.zeros(len(h), np.int64))
        return reply(messages_, judge, kinds)

    def extend(key, part: pa.Table, replies: pa.Table) -> pa.Table:
        if not part.num_rows:
            return table([], MESSAGE)
        words, block = Words(part, window), part["block"][0].as_py()
        got, _ = answered(replies)
        at, h = words.anchors()
        distinct, number, count = np.unique(h, return_inverse=True, return_counts=True)
        own, s1, s2 = words.sequences()
        head, seq = firsts(s1, s2, words.doc[own], np.zeros(len(own), np.int64))
        elsewhere, first = split_answers(got, len(distinct), len(head))
        gone = np.zeros(len(words.doc), bool)
        gone[own] = (first[seq] == 0) | (words.doc[own] > words.doc[own][head][seq])
        repeated = np.zeros(len(words.row) + 1, np.int32)
        repeated[1:][at[(elsewhere[number] > 0) | (count[number] > 1)]] = 1
        total = np.cumsum(repeated)
        last = np.minimum(np.arange(len(words.row)) + PERIOD, len(words.row))
        seen = total[last] > total[:-1] if len(words.row) else np.zeros(0, bool)
        ask_about = np.flatnonzero(seen & (words.left >= window) & ~gone[words.row])
        h1, h2 = words.windows(ask_about) if len(ask_about) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        doc, place = words.doc[words.row[ask_about]], words.place[ask_about].astype(np.int32)
        head, _ = firsts(h1, h2, doc, place)
        bits = np.zeros(len(words.row), bool)
        bits[ask_about] = True
        own_note = np.packbits(np.concatenate([gone, bits])).tobytes()
        return table(messages(block, n, h1[head], h2[head], doc[head], place[head]) + [note(block, own_note)], MESSAGE)

    def remove(key, part: pa.Table, replies: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _result([], [], [], [], [])
        words = Words(part, window)
        got, notes = answered(replies)
        flags = np.unpackbits(np.frombuffer(notes[0], np.uint8), count=len(words.doc) + len(words.row)).astype(bool)
        gone, candidate = flags[:len(words.doc)], np.flatnonzero(flags[len(words.doc):])
        cover = np.zeros(len(words.row) + 1, np.int32)
        if len(candidate):
            h1, h2 = words.windows(candidate)
            doc, place = words.doc[words.row[candidate]], words.place[candidate].astype(np.int32)
            head, number = firsts(h1, h2, doc, place)
            same = (doc == doc[head][number]) & (place == place[head][number])
            again = candidate[~(same & (got[number] > 0))]
            np.add.at(cover, again, 1)
            np.add.at(cover, again + window, -1)
        removed = (np.cumsum(cover)[:-1] > 0) | gone[words.row]
        return _kept(words, removed, with_text)

    asked = rows.groupBy("block").applyInArrow(ask, MESSAGE)
    replies = asked.groupBy("part").applyInArrow(answer, MESSAGE)
    windows = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(extend, MESSAGE)
    judged = answers(windows, lambda block, *a: earliest(*a), ("u8", "u4", "i8", "i4"))
    out = rows.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(remove, SCHEMA)
    return out if with_text else out.drop("kept_text")


def _kept(words: Words, removed: np.ndarray, with_text: bool) -> pa.Table:
    """Kept words of each document, each but the last followed by a space:
    the white-space byte behind the word, made 0x20."""
    n = len(words.doc)
    kept = np.flatnonzero(~removed)
    row = words.row[kept]
    final = np.ones(len(kept), bool)
    final[:-1] = row[1:] != row[:-1]
    data = words.data.copy()
    data[words.end[kept[~final]]] = 0x20
    change = np.zeros(len(data) + 2, np.int32)
    change[words.start[kept]] += 1
    np.add.at(change, words.end[kept] + ~final, -1)
    keep = np.cumsum(change)[:len(data)] > 0
    out = data[keep]
    at = np.concatenate([[0], np.cumsum(keep)])[words.offsets]
    view = memoryview(out)
    gone = np.bincount(words.row[removed], minlength=n)
    return _result(words.ids.to_pylist(), np.diff(words.before), gone,
                   [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])],
                   [out[a:b].tobytes().decode() if with_text else None for a, b in zip(at[:-1], at[1:])])


def _result(ids, n_words, n_removed, digests, texts) -> pa.Table:
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
                     "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                     "kept_text": pa.array(texts, pa.string())})
