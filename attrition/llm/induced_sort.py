"""Suffixes of a shard by external induced sorting.

Suffixes are ordered by their first ``cap`` characters.  Leftmost S suffixes
are ordered first: their substrings are named, and the names' sequence, in
place of a recursive call on an alphabet as large as the text, is ranked by
doubling.  From their order all L suffixes are induced, and from those all S
suffixes.  A suffix that is taken from the queue puts the suffix one character
longer into its character's queue.  Entries enter a character's queue in
order, so the priority queue is one first-in first-out queue per character;
queues go to disk when together they pass a limit.  Each entry carries its
common prefix with the entry before it: one more than the least common prefix
of the suffixes taken in between.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of queue entries kept in memory.
QUEUE_BYTES = 64 << 20


class Queues:
    """One queue of (position, common prefix) per character."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.limit, self.bytes = limit, 0
        self.parts: dict[int, list] = {}
        self.files: dict[int, list] = {}

    def put(self, character: int, position: np.ndarray, common: np.ndarray) -> None:
        self.parts.setdefault(character, []).append((position, common))
        self.bytes += position.nbytes + common.nbytes
        if self.bytes > self.limit:
            for c in list(self.parts):
                self._spill(c)
            self.bytes = 0

    def _spill(self, character: int) -> None:
        if character not in self.files:
            self.files[character] = [tempfile.TemporaryFile(), 0]
        f = self.files[character]
        for position, common in self.parts.pop(character, []):
            np.save(f[0], position)
            np.save(f[0], common)
            f[1] += 1

    def take(self, character: int):
        """All entries of a character so far, in order; they leave the queue."""
        out = []
        if character in self.files:
            f, n = self.files.pop(character)
            f.seek(0)
            out = [(np.load(f), np.load(f)) for _ in range(n)]
            f.close()
        own = self.parts.pop(character, [])
        self.bytes -= sum(p.nbytes + c.nbytes for p, c in own)
        out += own
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate([p for p, _ in out]), np.concatenate([c for _, c in out])


class Minima:
    """Least common prefix since the last entry put for each character."""

    def __init__(self, characters: int, cap: int):
        self.since = np.full(characters, cap, np.int16)

    def entries(self, character: np.ndarray, at: np.ndarray, common: np.ndarray):
        """For entries of a batch (their character and their place among the
        batch's suffixes, whose common prefixes are ``common``): in stable
        order by character, the least common prefix since the entry before."""
        order = np.argsort(character, kind="stable")
        c, a = character[order], at[order]
        least = np.empty(len(c), np.int16)
        head = np.ones(len(c), bool)
        head[1:] = c[1:] != c[:-1]
        ahead = np.minimum.accumulate(common)
        least[head] = np.minimum(self.since[c[head]], ahead[a[head]])
        rest = np.flatnonzero(~head)
        least[rest] = range_minimum(common, a[rest - 1] + 1, a[rest] + 1)
        last = np.ones(len(c), bool)
        last[:-1] = head[1:]
        self.since = np.minimum(self.since, ahead[-1])
        behind = np.append(np.minimum.accumulate(common[::-1])[::-1], np.int16(np.iinfo(np.int16).max))
        self.since[c[last]] = behind[a[last] + 1]
        return order, least


def range_minimum(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of x[start:end] for each pair (not empty)."""
    out = np.empty(len(start), x.dtype)
    if not len(start):
        return out
    level = np.frexp((end - start).astype(np.float64))[1] - 1
    table = x
    for k in range(int(level.max()) + 1):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[start[own]], table[end[own] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[:len(table) - (1 << k)], table[1 << k:])
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes a and b, at most ``cap``, by comparison."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < len(text)) & (y < len(text)) & (out[live] < cap)
        live, x, y = live[ok], x[ok], y[ok]
        same = text[x] == text[y]
        live = live[same]
        out[live] += 1
    return out


def leftmost_s(text: np.ndarray, s_type: np.ndarray, cap: int):
    """Leftmost S suffixes in order of their first ``cap`` characters, with
    the common prefix of each and the one before."""
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    m = len(lms)
    if m == 0:
        return lms, np.zeros(0, np.int16)
    # names: substrings to the next leftmost S, by (character, type), 6 at a time
    codes = np.append((text.astype(np.uint64) << np.uint64(1)) | s_type.astype(np.uint64), np.zeros(8, np.uint64))
    word = np.zeros(len(text), np.uint64)
    for k in range(6):
        word = (word << np.uint64(10)) | codes[k:k + len(text)]
    stop = np.append(lms[1:], len(text) - 1)            # the last character of each substring
    rank, live, depth = np.zeros(m, np.int64), np.arange(m), 0
    while len(live) and depth < cap:
        at = lms[live] + depth
        short = np.clip(stop[live] + 1 - at, 0, 6)
        inside = np.minimum(at, len(text) - 1)
        key = np.where(short > 0, word[inside] >> (np.uint64(10) * (6 - short).astype(np.uint64)) << (np.uint64(10) * (6 - short).astype(np.uint64)), 0)
        order = np.lexsort((key, rank[live]))
        r, k = rank[live][order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        place = np.arange(len(order))
        group = np.maximum.accumulate(np.where(new, place, 0))
        first = np.ones(len(order), bool)
        first[1:] = r[1:] != r[:-1]
        base = np.maximum.accumulate(np.where(first, place, 0))
        rank[live[order]] = r + (group - base)          # the smallest rank of a tie
        depth += 6
        size = np.bincount(np.cumsum(new) - 1)
        tied = size[np.cumsum(new) - 1] > 1
        live = live[order][tied & (stop[live[order]] + 1 - lms[live[order]] > depth)]
    ranks = [_dense(rank)]
    span = 1
    while 2 * span < 2 * cap and int(ranks[-1].max()) + 1 < m:
        after = np.zeros(m, np.int64)
        after[:m - span] = ranks[-1][span:] + 1 if span < m else 0
        ranks.append(_dense(ranks[-1] * (m + 1) + after))
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        ok = (a + (1 << k) < m) & (b + (1 << k) < m) & (common < cap)
        ok[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        common[ok] += lms[a[ok] + (1 << k)] - lms[a[ok]]
        a[ok] += 1 << k
        b[ok] += 1 << k
    common += common_prefix(text, lms[a], lms[b], cap)
    out = np.zeros(m, np.int16)
    out[1:] = np.minimum(common, cap)
    return lms[order], out


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def suffix_order(text: np.ndarray, cap: int, limit: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``cap`` characters, common prefix of
    each and the one before).  ``text`` ends with its only 0."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    s_type = np.zeros(n, bool)
    at = np.searchsorted(change, np.arange(n - 1))     # the next change from each place on
    s_type[:-1] = text[change[at] + 1] > text[change[at]]
    s_type[-1] = True
    lms, lms_common = leftmost_s(text, s_type, cap)
    top = int(text.max()) + 1
    bounds = np.searchsorted(text[lms], np.arange(top + 1))
    l_part: list = [None] * top

    # L suffixes, from small to large
    queues, minima = Queues(limit), Minima(top, cap)

    def induce(position, common, wanted):
        before = position - 1
        use = np.flatnonzero((position > 0) & (s_type[before] == wanted))
        if not len(position):
            return
        if not len(use):
            minima.since = np.minimum(minima.since, common.min())
            return
        character = text[before[use]]
        order, least = minima.entries(character, use, common)
        use, character = use[order], character[order]
        least = np.minimum(least + 1, cap).astype(np.int16)
        cut = np.flatnonzero(np.diff(character, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(use)]):
            queues.put(int(character[a]), before[use[a:b]], least[a:b])

    for c in range(top):
        kept = []
        while True:
            position, common = queues.take(c)
            if not len(position):
                break
            common = common.copy()
            if not kept:
                common[0] = 0
            kept.append((position, common))
            induce(position, common, False)
        l_part[c] = _joined(kept)
        own = slice(bounds[c], bounds[c + 1])
        if own.stop > own.start:
            position, common = lms[own], lms_common[own].copy()
            common[0] = common_prefix(text, l_part[c][0][-1:], position[:1], cap)[0] if len(l_part[c][0]) else 0
            induce(position, common, False)

    # S suffixes, from large to small; common prefixes are with the next larger one
    queues, minima = Queues(limit), Minima(top, cap)
    order, shared = [], []
    for c in range(top - 1, -1, -1):
        kept = []
        if c == 0:
            queues.put(0, np.array([n - 1]), np.zeros(1, np.int16))
        while True:
            position, common = queues.take(c)
            if not len(position):
                break
            common = common.copy()
            if not kept:
                common[0] = 0
            kept.append((position, common))
            induce(position, common, True)
        s_position, s_common = _joined(kept)
        position, common = l_part[c]
        if len(position):
            back = np.empty(len(common), np.int16)
            back[1:] = common[:0:-1]
            back[0] = common_prefix(text, position[-1:], s_position[-1:], cap)[0] if len(s_position) else 0
            induce(position[::-1], back, True)
        # in ascending order: L, then S turned round
        up = np.empty(len(s_common), np.int16)
        up[1:] = s_common[:0:-1]
        if len(up):
            up[0] = common_prefix(text, position[-1:], s_position[-1:], cap)[0] if len(position) else 0
        order.append(np.concatenate([position, s_position[::-1]]))
        shared.append(np.concatenate([common, up]))
    return np.concatenate(order[::-1]), np.concatenate(shared[::-1])


def _joined(kept: list) -> tuple[np.ndarray, np.ndarray]:
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    return np.concatenate([p for p, _ in kept]), np.concatenate([c for _, c in kept])


def repeated(segments: list[bytes], length: int, limit: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each segment, which of its ``length``-byte windows (by start) occur
    at another place of any segment."""
    raw = b"\x00".join(segments)
    sizes = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.empty(len(raw) + 1, np.int16)
    text[:-1] = np.frombuffer(raw, np.uint8)
    text[:-1] += 2
    text[(begin[1:] - 1)] = 1       # parts segments
    text[-1] = 0
    order, common = suffix_order(text, length, limit)
    same = common >= length
    again = same.copy()
    again[:-1] |= same[1:]
    found = np.zeros(len(text), bool)
    found[order[again]] = True
    return [found[b:b + max(0, s - length + 1)] for b, s in zip(begin, sizes)]
