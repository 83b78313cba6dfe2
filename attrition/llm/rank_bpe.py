"""BPE encoding and decoding with contiguous rank arrays.

A text is cut at spaces and line feeds, a piece at special tokens, normalised
and cut into words by the tokenizer file's own rules.  A word starts as one
part per byte, the last one marked as the word's end.  Beside the parts lies
the array of ranks of adjacent pairs; the least rank is found by a scan,
its boundary deleted, and the two neighbouring ranks are looked up again, until
no pair has a rank.  A scan per merge is the quickest way for short words; a
word of more than ``SHORT`` bytes keeps its pairs in a heap instead (the same
merges in the same order), so that a text without any space takes n log n.

Decoding looks each id up and joins the tokens by a space, as the tokenizer
file has no decoder of its own; ids outside the vocabulary are left out.

Nulls count as empty texts, which have no tokens.  Repeated rows are encoded
each on its own, texts of any length whole; other columns are ignored; an empty
table gives no rows.  Nothing is shuffled, so a lost task is simply done again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from attrition.llm.common import release, row_blocks, utf8

#: Bytes up to which a word's ranks are scanned; beyond it they are in a heap.
SHORT = 96
#: Words and pieces whose ids a worker remembers.
CACHE_WORDS = 200_000
#: Bytes of text encoded at a time.
BLOCK = 4 << 20
NONE = 1 << 40


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others follow U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def merge_scan(parts: list[int], rank: dict, merged: list[int]) -> list[int]:
    """Merge by scanning the array of adjacent ranks for its least entry."""
    get = rank.get
    ranks = [get(pair, NONE) for pair in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)
        parts[i] = merged[low]
        del parts[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get((parts[i], parts[i + 1]), NONE)
        if i:
            ranks[i - 1] = get((parts[i - 1], parts[i]), NONE)
    return parts


def merge_heap(parts: list[int], rank: dict, merged: list[int]) -> list[int]:
    """The same merges for a long word: pairs in a heap by rank and place,
    parts in a linked list."""
    n, get = len(parts), rank.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(get(p, NONE) for p in zip(parts, parts[1:])) if r != NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if parts[i] >= 0 else n
        if j >= n or get((parts[i], parts[j])) != r:
            continue        # one of the two was merged since
        parts[i], parts[j] = merged[r], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            again = get((parts[i], parts[k]))
            if again is not None:
                heapq.heappush(heap, (again, i))
        h = before[i]
        if h >= 0:
            again = get((parts[h], parts[i]))
            if again is not None:
                heapq.heappush(heap, (again, h))
    return [p for p in parts if p >= 0]


class Codec:
    """Encoder and decoder of a word-end BPE tokenizer file."""

    #: Characters below U+0250 have had the same classes in all Unicode versions.
    LATIN = "ɐ"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end, chars = model["end_of_word_suffix"], byte_characters()
        self.first = [vocab[c] for c in chars]              # a byte inside a word
        self.last = [vocab[c + end] for c in chars]         # a byte that ends one
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in [*vocab.items(), *special.items()]}
        self.tokens = np.array([tokens.get(i) for i in range(max(tokens) + 1)], object)
        self.special = {t: array("I", [i]).tobytes() for t, i in special.items()}
        self.marks = regex.compile("(" + "|".join(sorted(map(regex.escape, special), key=len, reverse=True)) + ")")
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(cut).findall
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        self.byte = {c: b for b, c in enumerate(chars)}
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {"": b""}

    def word(self, data: bytes) -> bytes:
        """Ids of one word, given as its bytes."""
        got = self.words.get(data)
        if got is None:
            first = self.first
            parts = [first[b] for b in data[:-1]]
            parts.append(self.last[data[-1]])
            merge = merge_scan if len(data) <= SHORT else merge_heap
            got = array("I", merge(parts, self.rank, self.merged)).tobytes()
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            if len(data) <= SHORT:
                self.words[data] = got
        return got

    def cut(self, text: str) -> list[bytes]:
        """Words of a text without special tokens, as bytes."""
        if text.isascii():
            return [w.encode() for w in self.split(text.lower())]
        if max(text) < self.LATIN and is_normalized("NFC", text):
            return [w.encode() for w in self.split("".join(map(str.lower, text)))]
        byte = self.byte
        return [bytes([byte[c] for c in w]) for w, _ in self.pieces(self.normalize(text))]

    def piece(self, text: str) -> bytes:
        """Ids of a text between spaces."""
        if "<|" not in text:
            return b"".join(map(self.word, self.cut(text)))
        out = []
        for part in self.marks.split(text):
            ids = self.special.get(part)
            out.append(b"".join(map(self.word, self.cut(part))) if ids is None else ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Token ids of a text, as 32-bit integers in the machine's order."""
        known, get = self.known, self.known.get
        pieces = text.replace("\n", " ").split(" ")
        ids = list(map(get, pieces))
        if None in ids:
            for i, got in enumerate(ids):
                if got is None:
                    p = pieces[i]
                    got = get(p)
                    if got is None:
                        got = self.piece(p)
                        if len(p) <= SHORT:
                            known[p] = got
                    ids[i] = got
            if len(known) > CACHE_WORDS:
                known.clear()
                known[""] = b""
        return b"".join(ids)

    def decode(self, ids: np.ndarray) -> str:
        """Text of token ids: the tokens joined by a space."""
        tokens = self.tokens
        if len(ids) and (ids.min() < 0 or ids.max() >= len(tokens)):
            ids = ids[(ids >= 0) & (ids < len(tokens))]
        return " ".join([t for t in tokens[ids].tolist() if t is not None])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _blocks(batch: pa.RecordBatch):
    """(rows, texts) of a batch in blocks of bounded size; nulls are empty."""
    _, offsets = utf8(batch.column(1))
    for i, j in row_blocks(offsets, BLOCK):
        yield slice(i, j), batch.column(1).slice(i, j - i).fill_null("").to_pylist()


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the token ids of every whole text."""

    def run(batches):
        use = codec(tokenizer_path)
        for batch in batches:
            for rows, texts in _blocks(batch):
                coded = [use.encode(t) for t in texts]
                ends = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(coded), np.uint32).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.ListArray.from_arrays(pa.array(ends), ids)],
                                                 names=["doc_id", "ids"])
        release()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and the text of each row's ``ids`` (null ids: a null text)."""

    def run(batches):
        use = codec(tokenizer_path)
        for batch in batches:
            lists = batch.column(1)
            texts = [use.decode(s.values.to_numpy(zero_copy_only=False)) if s.is_valid else None for s in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.selectExpr("cast(doc_id as long) doc_id", "transform(ids, x -> cast(coalesce(x, -1) as int)) ids") \
        .mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, number of tokens, digest of the ids and of the text that they
    decode to; ids and texts stay inside the task."""

    def run(batches):
        use = codec(tokenizer_path)
        number = np.array([str(i) for i in range(len(use.tokens))], object)
        sha = hashlib.sha256
        for batch in batches:
            for rows, texts in _blocks(batch):
                count, ids_sha, text_sha = [], [], []
                for text in texts:
                    ids = np.frombuffer(use.encode(text), np.uint32)
                    count.append(len(ids))
                    ids_sha.append(sha(" ".join(number[ids].tolist()).encode()).hexdigest())
                    text_sha.append(sha(use.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[rows], pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
