"""Repeated byte strings, by suffix arrays over shards.

Every window of ``WINDOW`` bytes belongs to the smallest hash of the ``GRAM``-byte
strings in it.  Consecutive windows with the same smallest place, which begin
in the same stretch of ``STRETCH`` bytes before it, are one segment.  All of them
hold the same core, the bytes that are in every window of the stretch.  Equal
windows have equal places and cores, so the core's hash deals segments into
shards.  A segment whose core nobody shares is unique, and a segment that
occurs twice byte for byte is repeated whole.  What is left, the distinct
segments that share a core with others, is sorted by external induced sorting
(``induced_sort``): suffixes with a common prefix of a window's length mark
repeated windows.  Where the distinct segments of one core are more than
``SHARD_BYTES`` (a short passage in many documents, with other words around
it), their windows are dealt on by the hash of the whole window: no task holds
such a core's segments, and a window that two of them have is repeated.

Each block of documents asks about each distinct segment once, so a passage
that a third of the corpus holds is one entry per block; bytes are sent for one
copy of a segment only.

Nulls and empty texts, and texts shorter than a window, lose nothing.
Repeated rows are occurrences like any other.  Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attrition.llm.blocks import MESSAGE, answered, answers, blocked, cuts, documents_of, messages, table, unpack
from attrition.llm.common import WordHasher, mix64, rolling, row_blocks
from attrition.llm.induced_sort import repeated

WINDOW, GRAM, STRETCH = 400, 32, 128
#: Bytes of text whose hashes are looked at together.
SCAN_BYTES = 1 << 19
#: Bytes of segments sorted at a time; a core with more is dealt by windows.
SHARD_BYTES = 1 << 20
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
SEGMENT = "shard long, hash long, block long, entry long, whole long, bytes binary"
FOUND = "block long, entry long, payload binary"
#: In place of an entry: the payload is bits of what is repeated whole, or codes of dealt windows.
NOTE, DEALT = -1, -2


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values: running minima forwards
    and backwards inside stretches of ``width``."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(start, windows, start of the core) of each segment of the texts."""
    out = []
    for i, j in row_blocks(offsets, SCAN_BYTES):
        low, high = offsets[i], offsets[j]
        part = data[low:high]
        if len(part) < window:
            continue
        h = mix64(rolling(part.astype(np.uint64) + np.uint64(1), gram))
        bits = np.uint64(max(21, int(len(part)).bit_length()))
        place = np.arange(len(h), dtype=np.uint64)
        least = sliding_minimum((h >> bits << bits) | place, window - gram + 1)
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        # windows that lie inside a text
        inside = np.zeros(len(least) + 1, np.int32)
        long = np.flatnonzero(np.diff(offsets[i:j + 1]) >= window)
        np.add.at(inside, offsets[i:j][long] - low, 1)
        np.add.at(inside, offsets[i + 1:j + 1][long] - low - window + 1, -1)
        ok = np.cumsum(inside)[:-1] > 0
        back = (at - np.arange(len(at))) // STRETCH
        head = ok.copy()
        head[1:] &= ~ok[:-1] | (at[1:] != at[:-1]) | (back[1:] != back[:-1])
        first = offsets[i:j][long] - low
        head[first] = True
        start = np.flatnonzero(head)
        tail = ok.copy()
        tail[:-1] &= ~ok[1:] | head[1:]
        end = np.flatnonzero(tail) + 1
        out.append((start + low, end - start, at[start] - back[start] * STRETCH + low))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


class Segments:
    """A block's documents, their segments, and the distinct segments."""

    def __init__(self, part: pa.Table, window: int):
        self.ids, self.data, self.offsets = documents_of(part)
        self.start, self.windows, core = segments(self.data, self.offsets, window)
        end = self.start + self.windows + window - 1
        least, s1, s2 = (np.zeros(len(end), np.uint64) for _ in range(3))
        text_of = np.searchsorted(self.offsets, self.start, side="right") - 1
        for i, j in row_blocks(self.offsets, SCAN_BYTES):       # hashes of cores and contents
            own = slice(*np.searchsorted(text_of, [i, j]))
            low = self.offsets[i]
            hasher = _hasher(BASE)
            total = hasher.sums(self.data[low:self.offsets[j]])
            least[own] = hasher.between(total, core[own] - low, core[own] - low + window - STRETCH + 1)
            s1[own] = hasher.between(total, self.start[own] - low, end[own] - low)
            total = (hasher := _hasher(OTHER_BASE)).sums(self.data[low:self.offsets[j]])
            s2[own] = hasher.between(total, self.start[own] - low, end[own] - low)
        s2 = (s2 >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((s2, s1, least))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (least[a] != least[b]) | (s1[a] != s1[b]) | (s2[a] != s2[b])
        self.entry = np.empty(len(order), np.int64)         # of each segment, its distinct one
        self.entry[order] = np.cumsum(new) - 1
        self.head = order[new]                              # of each distinct one, a segment
        self.least, self.s1, self.s2 = least[self.head], s1[self.head], s2[self.head]
        self.many = (np.bincount(self.entry, minlength=len(self.head)) > 1).astype(np.uint8)


_HASHERS: dict[int, WordHasher] = {}


def _hasher(base: int) -> WordHasher:
    return _HASHERS.setdefault(base, WordHasher(base))


WHOLE, SORT, DEAL = 1, 2, 4      # an answer's bits: repeated whole, to be sorted (bytes wanted), to be dealt by windows


def judge(block, least, s1, s2, many, most: int = SHARD_BYTES // (WINDOW + STRETCH)) -> np.ndarray:
    """Of each entry: does its segment occur twice, does its hash have other
    segments (more than ``most``: they are dealt), and is this block the one
    to send it."""
    order = np.lexsort((block, s2, s1, least))
    a, b = order[1:], order[:-1]
    group = np.ones(len(order), bool)
    group[1:] = least[a] != least[b]
    new = group.copy()
    new[1:] |= (s1[a] != s1[b]) | (s2[a] != s2[b])
    number, bundle = np.cumsum(new) - 1, np.cumsum(group) - 1
    copies = np.bincount(number) > 1
    copies |= np.bincount(number, many[order]) > 0
    distinct = np.bincount(bundle[new])
    out = np.zeros(len(order), np.uint8)
    out[order] = WHOLE * copies[number] + new * np.where(distinct > most, DEAL, SORT * (distinct > 1))[bundle]
    return out


def dealt(s: Segments, entries: np.ndarray, window: int):
    """(hash, further hash, whether the block has it again, code) of the
    distinct windows of the entries, by hash; codes of the windows that the
    block itself has again.  A code is entry * STRETCH + place in it."""
    number = s.windows[s.head[entries]]
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    code = np.repeat(entries, number) * STRETCH + place
    start = np.repeat(s.start[s.head[entries]], number) + place
    order = np.argsort(start, kind="stable")
    code, start = code[order], start[order]
    w1, w2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    text_of = np.searchsorted(s.offsets, start, side="right") - 1
    for i, j in row_blocks(s.offsets, SCAN_BYTES):
        own = slice(*np.searchsorted(text_of, [i, j]))
        if own.start < own.stop:
            low = s.offsets[i]
            for base, out in ((BASE, w1), (OTHER_BASE, w2)):
                hasher = _hasher(base)
                total = hasher.sums(s.data[low:s.offsets[j]])
                out[own] = hasher.between(total, start[own] - low, start[own] - low + window)
    w2 = (w2 >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((w2, w1))
    w1, w2, code = w1[order], w2[order], code[order]
    new = np.ones(len(order), bool)
    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
    again = (np.bincount(np.cumsum(new) - 1) > 1) if len(new) else new
    return (w1[new], w2[new], again.astype(np.uint8), code[new]), code[np.repeat(again, np.diff(np.flatnonzero(np.append(new, True))))]


def settle(rows: pa.Table) -> pa.Table:
    """Windows dealt to one part that two blocks have, or that one has twice."""
    rows = [(b, *unpack(raw, n, "u8", "u4", "u1", "i8")) for b, n, raw in
            zip(rows["block"].to_pylist(), rows["entry"].to_pylist(), rows["bytes"].to_pylist())]
    w1, w2, many = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
    order = np.lexsort((w2, w1))
    a, b = order[1:], order[:-1]
    new = np.ones(len(order), bool)
    new[1:] = (w1[a] != w1[b]) | (w2[a] != w2[b])
    number = np.cumsum(new) - 1
    twice = (np.bincount(number) > 1) | (np.bincount(number, many[order]) > 0)
    found = np.zeros(len(order), bool)
    found[order] = twice[number]
    ends = np.cumsum([len(r[1]) for r in rows])
    return table([(r[0], DEALT, r[4][found[e - len(r[1]):e]].tobytes()) for r, e in zip(rows, ends)
                  if found[e - len(r[1]):e].any()], FOUND)


def sort_shard(rows: pa.Table, window: int) -> pa.Table:
    """Repeated windows of the segments of a shard that are not repeated
    whole; whole hashes' groups are sorted together, up to ``SHARD_BYTES``."""
    rows = rows.sort_by([("hash", "ascending"), ("block", "ascending"), ("entry", "ascending")])
    hashes, size = rows["hash"].to_numpy(), np.array([len(b) for b in rows["bytes"].to_pylist()])
    edge = np.append(np.flatnonzero(np.diff(hashes, prepend=hashes[0] - 1 if len(hashes) else 0)), len(hashes))
    total = np.concatenate([[0], np.cumsum(size)])
    out, i = [], 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + SHARD_BYTES, side="right")) - 1)
        part = rows.slice(edge[i], edge[j] - edge[i])
        for block, entry, whole, found in zip(part["block"].to_pylist(), part["entry"].to_pylist(),
                                              part["whole"].to_pylist(), repeated(part["bytes"].to_pylist(), window)):
            if not whole and found.any():
                out.append((block, entry, np.packbits(found).tobytes()))
        i = j
    return table(out, FOUND)


def deduplicate(docs: DataFrame, with_text: bool = False, window: int = WINDOW,
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: bytes, bytes removed, runs of removed bytes, and
    the kept bytes (their SHA-256 and, if asked for, the bytes)."""
    rows, n = blocked(docs)
    judged = partial(judge, most=shard_bytes // (window + STRETCH))

    def ask(part: pa.Table) -> pa.Table:
        s = Segments(part, window)
        return table(messages(part["block"][0].as_py(), n, s.least, s.s1, s.s2, s.many), MESSAGE)

    def send(key, part: pa.Table, replies: pa.Table) -> pa.Table:
        if not part.num_rows:
            return table([], SEGMENT)
        s, block = Segments(part, window), part["block"][0].as_py()
        got, _ = answered(replies)
        at = cuts(s.least, n)
        shard = np.repeat(np.arange(n), np.diff(at))
        out = []
        for e in np.flatnonzero(got & SORT).tolist():
            a = int(s.start[s.head[e]])
            raw = s.data[a:a + int(s.windows[s.head[e]]) + window - 1].tobytes()
            out.append((int(shard[e]), int(s.least[e].view(np.int64)), block, e, int(got[e] & WHOLE), raw))
        arrays, again = dealt(s, np.flatnonzero(got & DEAL), window)
        # the windows' parts come after the shards
        out += [(n + p, 0, block, k, 0, raw) for p, _, k, raw in messages(block, n, *arrays)]
        # what is repeated whole and in the block itself, as notes to itself
        out.append((-1 - block, 0, block, NOTE, 0, np.packbits(got & WHOLE).tobytes()))
        out.append((-1 - block, 0, block, DEALT, 0, again.tobytes()))
        return table(out, SEGMENT)

    def sort(part: pa.Table) -> pa.Table:
        if part["shard"][0].as_py() < 0:
            return part.select(["block", "entry", "bytes"]).rename_columns(["block", "entry", "payload"])
        return settle(part) if part["shard"][0].as_py() >= n else sort_shard(part, window)

    def remove(key, part: pa.Table, found: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _result([], [], [], [], [], [])
        s = Segments(part, window)
        whole, partly = np.zeros(len(s.head), bool), {}
        change = np.zeros(len(s.data) + 1, np.int32)
        for entry, payload in zip(found["entry"].to_pylist(), found["payload"].to_pylist()):
            if entry == DEALT:
                code = np.frombuffer(payload, np.int64)
                at = s.start[s.head[code // STRETCH]] + code % STRETCH
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                continue
            bits = np.unpackbits(np.frombuffer(payload, np.uint8)).astype(bool)
            if entry == NOTE:
                whole = bits[:len(s.head)]
            else:
                partly[entry] = bits
        own = np.flatnonzero(whole[s.entry])
        np.add.at(change, s.start[own], 1)
        np.add.at(change, s.start[own] + s.windows[own] + window - 1, -1)
        for entry, bits in partly.items():
            at = s.start[s.head[entry]] + np.flatnonzero(bits[:s.windows[s.head[entry]]])
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
        return _kept(s, np.cumsum(change)[:-1] > 0, with_text)

    asked = rows.groupBy("block").applyInArrow(ask, MESSAGE)
    replies = answers(asked, judged, ("u8", "u8", "u4", "u1"))
    sent = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(send, SEGMENT)
    found = sent.groupBy("shard").applyInArrow(sort, FOUND)
    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, SCHEMA)
    return out if with_text else out.drop("kept_text")


def _kept(s: Segments, gone: np.ndarray, with_text: bool) -> pa.Table:
    kept = s.data[~gone]
    at = np.concatenate([[0], np.cumsum(~gone)])[s.offsets]
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[s.offsets])
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    opening = s.offsets[:-1][s.offsets[:-1] < len(gone)]
    head[opening] = gone[opening]
    spans = np.diff(np.concatenate([[0], np.cumsum(head)])[s.offsets])
    view = memoryview(np.ascontiguousarray(kept))
    return _result(s.ids.to_pylist(), np.diff(s.offsets), removed, spans,
                   [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])],
                   [kept[a:b].tobytes() if with_text else None for a, b in zip(at[:-1], at[1:])])


def _result(ids, n_bytes, n_removed, n_spans, digests, texts) -> pa.Table:
    longs = {"doc_id": ids, "n_bytes": n_bytes, "n_removed": n_removed, "n_spans": n_spans}
    return pa.table({**{k: pa.array(v, pa.int64()) for k, v in longs.items()},
                     "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(texts, pa.binary())})
