"""Alignment of two tokenizers' tokens over the same bytes.

Side A is a byte-level tokenizer, side B a piece tokenizer that puts a space
before the text; both are read as byte ranges of space + text.  In each batch
``pandas.merge_asof``, keyed by document and byte, finds for every token's start the
other side's token that covers it; the union of both directions is the overlaps
of the two tokenizations.  Where tokens of both sides end at the same byte a
group ends; all A and B tokens of a group are linked.

Counts over the corpus (in how many documents an A id and a B id are linked)
are made from blocks: a batch of documents is a block, and sends each of its
distinct id pairs once, with the number of its documents.  A pair that occurs
in all documents is one row per block, so no key is hot.  Counts go back to the
blocks in the same way, and the block's documents look them up.

Nulls, empty texts and texts whose tokens do not give back space + text (on
either side) have no tokens: zeros and empty digests.  Repeated rows count as
documents of their own.  A text of any length is taken whole; a group's links
are counted by distinct ids, so a long run without a common end stays small.
Other columns are ignored; an empty table gives no rows.  Blocks and counts
are written tables, so a lost executor loses one step's work only.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import release, row_blocks, utf8
from attrition.llm.rank_bpe import byte_characters
from attrition.session import materialize

#: Bytes of text in a block of documents, and aligned at a time.
BLOCK, BATCH = 4 << 20, 1 << 19
#: An id pair is a * RADIX + b; vocabularies larger than that are refused.
RADIX = 1 << 16
#: A group with more links than this is counted by distinct ids.
WIDE = 64


class Side:
    """One tokenizer: ids of texts and the bytes that an id stands for."""

    #: Characters below U+0250 have had the same classes in all Unicode versions.
    LATIN = "\u0250"

    def __init__(self, path: str):
        self.piece = path.endswith(".model")
        if self.piece:
            import sentencepiece
            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                          for i, p in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one core for each task
            from tokenizers import Tokenizer
            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            byte = {c: bytes([b]) for b, c in enumerate(byte_characters())}
            vocab = self.model.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self.bytes[i] = b"".join(byte.get(c) or c.encode() for c in token)
            self.fast = self._ranked(path)
        if len(self.bytes) > RADIX:
            raise ValueError(f"a vocabulary of {len(self.bytes)} ids does not fit in a pair")
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)

    def _ranked(self, path: str):
        """The same vocabulary in a quicker library, where the file's ids follow
        its merges and its words are cut by the plain byte-level rule; else None."""
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, rule = spec["model"]["vocab"], spec["pre_tokenizer"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        if (spec["normalizer"] or rule["type"] != "ByteLevel" or not rule.get("use_regex", True) or rule["add_prefix_space"]
                or [vocab[m] for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged)):
            return None
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks={self.bytes[i]: i for i in vocab.values()}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text for each text."""
        if self.piece:      # puts the space itself
            return self.model.encode(texts, num_threads=1)
        quick = [self.fast is not None and (t.isascii() or max(t) < self.LATIN) for t in texts]
        rest = iter(self.model.encode_batch_fast([" " + t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self.fast(" " + t) if q else next(rest).ids for t, q in zip(texts, quick)]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def side(path: str) -> Side:
    return Side(path)


def tokens(use: Side, texts: list[str], skip: np.ndarray) -> list[list[int]]:
    """Ids of each text; those of skipped texts, and of texts that the tokens
    don't give back, are none."""
    out = use.encode(["" if s else t for t, s in zip(texts, skip)])
    return [[] if s or use.joined(ids) != b" " + t.encode() else ids for t, s, ids in zip(texts, skip, out)]


def frame(ids: list[list[int]], sizes: np.ndarray) -> pd.DataFrame:
    """One row per token: document (place in the batch), start and end byte
    counted over the batch, id.  Both sides have the same bytes, so a document
    begins at the same place on both, and a place is in one document only."""
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, sum(map(len, ids)))
    size = sizes[flat]
    end = np.cumsum(size)
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(i) for i in ids]), "start": end - size, "end": end, "id": flat},
                        copy=False)


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of ``a`` and ``b``) of all tokens that share a byte: each
    start's covering token on the other side, in both directions.  The key is
    the document and the byte in one number (the byte over the batch).  Where
    both tokens start at one byte, the first direction has the pair already."""
    def covering(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = pd.merge_asof(x[["start"]], pd.DataFrame({"start": y["start"], "row": np.arange(len(y))}), on="start")
        row = found["row"].to_numpy()
        same = y["start"].to_numpy()[row] == x["start"].to_numpy()
        return row, same

    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    over_a, _ = covering(a, b)
    over_b, same = covering(b, a)
    return (np.concatenate([np.arange(len(a)), over_b[~same]]), np.concatenate([over_a, np.flatnonzero(~same)]))


def groups(a: pd.DataFrame, b: pd.DataFrame, lap: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of each A and each B token: a group ends with a
    pair of overlapping tokens that end at the same byte."""
    closed = a["end"].to_numpy()[lap[0]] == b["end"].to_numpy()[lap[1]]

    def number(n: int, last: np.ndarray) -> np.ndarray:
        ends = np.zeros(n + 1, np.int64)
        ends[last + 1] = 1
        return np.cumsum(ends)[:n]

    return number(len(a), lap[0][closed]), number(len(b), lap[1][closed])


def linked_pairs(a: pd.DataFrame, b: pd.DataFrame, ga: np.ndarray, gb: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, id pair, links) of the distinct linked id pairs of each document.
    In wide groups ids are made distinct first."""
    none = np.zeros(0, np.int64)
    if not len(a):
        return none, none, none
    ai, bi = a["id"].to_numpy(), b["id"].to_numpy()
    ca, cb = np.bincount(ga), np.bincount(gb)
    first_b = np.cumsum(cb) - cb
    width = np.where((ca * cb > WIDE)[ga], 0, cb[ga])
    left = np.repeat(np.arange(len(a)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first_b[ga], width)
    doc, pair, n = [a["doc"].to_numpy()[left]], [ai[left] * RADIX + bi[right]], [np.ones(len(left), np.int64)]
    first_a = np.cumsum(ca) - ca
    for g in np.flatnonzero(ca * cb > WIDE).tolist():
        x, nx = np.unique(ai[first_a[g]:first_a[g] + ca[g]], return_counts=True)
        y, ny = np.unique(bi[first_b[g]:first_b[g] + cb[g]], return_counts=True)
        doc.append(np.full(len(x) * len(y), a["doc"].to_numpy()[first_a[g]]))
        pair.append((x[:, None] * RADIX + y[None]).ravel())
        n.append((nx[:, None] * ny[None]).ravel())
    doc, pair, n = map(np.concatenate, (doc, pair, n))
    key = doc << 32 | pair
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new] >> 32, key[new] & 0xFFFFFFFF, np.add.reduceat(n[order], new)


@lru_cache(maxsize=8)
def written(n_ids: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}" for i in range(n_ids)], object)


class Aligned:
    """Both sides' tokens of a batch of texts, overlaps and groups."""

    def __init__(self, left: Side, right: Side, column: pa.Array):
        texts = column.to_pylist()
        skip = np.array([not t for t in texts], bool)
        ids_a = tokens(left, texts, skip)
        ids_b = tokens(right, texts, skip | np.array([not i for i in ids_a], bool))
        ids_a = [i if j else [] for i, j in zip(ids_a, ids_b)]
        self.a, self.b = frame(ids_a, left.sizes), frame(ids_b, right.sizes)
        self.lap_a, self.lap_b = overlaps(self.a, self.b)
        self.ga, self.gb = groups(self.a, self.b, (self.lap_a, self.lap_b))
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64) for ids in (ids_a, ids_b))
        self.n, self.ids = len(texts), (len(left.bytes), len(right.bytes))

    def digests(self) -> tuple[np.ndarray, list[str]]:
        """Number of groups and digest of each document.  Tokens are written
        group by group, A before B, each with the mark that follows it."""
        a, b = self.a["id"].to_numpy(), self.b["id"].to_numpy()
        if not len(a):
            return np.zeros(self.n, np.int64), [""] * self.n
        ca, cb = np.bincount(self.ga), np.bincount(self.gb)
        last_a, last_b = np.cumsum(ca), np.cumsum(cb)
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + (last_b - cb)[self.ga]] = written(self.ids[0], ",")[a]
        text[np.arange(len(b)) + last_a[self.gb]] = written(self.ids[1], ",")[b]
        text[last_a - 1 + last_b - cb] = written(self.ids[0], "|")[a[last_a - 1]]
        text[last_a + last_b - 1] = written(self.ids[1], ";")[b[last_b - 1]]
        ends = self.at_a + self.at_b
        sha = [hashlib.sha256("".join(text[i:j].tolist())[:-1].encode()).hexdigest() if i < j else ""
               for i, j in zip(ends[:-1], ends[1:])]
        count = np.concatenate([[0], self.ga + 1])
        return count[self.at_a[1:]] - count[self.at_a[:-1]], sha


def _batches(batches):
    """Arrow batches cut into smaller ones of bounded bytes."""
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for i, j in row_blocks(offsets, BATCH):
            yield batch.slice(i, j - i), int(offsets[j] - offsets[i])


OVERLAPS = "doc_id long, a_token long, b_token long, a_id int, b_id int, start long, end long, group long"


def overlap_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per pair of overlapping tokens: their places and ids in the
    document, the shared bytes of space + text, and their group."""

    def run(batches):
        left, right = side(path_a), side(path_b)
        for batch, _ in _batches(batches):
            al = Aligned(left, right, batch.column(1))
            x, y = al.a.iloc[al.lap_a], al.b.iloc[al.lap_b]
            doc = x["doc"].to_numpy()
            base = al.a["start"].to_numpy()[al.at_a[doc]]
            group = al.ga[al.lap_a]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), *map(pa.array, (
                    al.lap_a - al.at_a[doc], al.lap_b - al.at_b[doc], x["id"].to_numpy(np.int32), y["id"].to_numpy(np.int32),
                    np.maximum(x["start"].to_numpy(), y["start"].to_numpy()) - base,
                    np.minimum(x["end"].to_numpy(), y["end"].to_numpy()) - base, group - al.ga[al.at_a[doc]]))],
                names=[c.split()[0] for c in OVERLAPS.split(", ")])
        release()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, OVERLAPS)


DOCUMENT = ("doc_id long, n_a long, n_b long, n_overlaps long, n_groups long, n_links long, groups_sha256 string, "
            "block long, pairs binary, links binary, distinct binary, documents binary")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
          "groups_sha256 string, n_overlaps long")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document with its figures and its distinct linked id pairs;
    the first row of each block also has the block's distinct pairs and the
    number of documents of each."""
    names = [c.split()[0] for c in DOCUMENT.split(", ")]

    def run(batches):
        left, right = side(path_a), side(path_b)
        block, parts, pairs, size = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            own, holders = np.unique(np.concatenate(pairs), return_counts=True)
            table = pa.Table.from_batches(parts)
            none = [None] * (len(table) - 1)
            for name, col in (("block", pa.array([block] * len(table), pa.int64())),
                              ("distinct", pa.array([own.tobytes(), *none], pa.binary())),
                              ("documents", pa.array([holders.astype(np.uint32).tobytes(), *none], pa.binary()))):
                table = table.append_column(name, col)
            return table.select(names).to_batches()

        for batch, n_bytes in _batches(batches):
            al = Aligned(left, right, batch.column(1))
            doc, pair, n = linked_pairs(al.a, al.b, al.ga, al.gb)
            at = np.searchsorted(doc, np.arange(al.n + 1))
            total = np.concatenate([[0], np.cumsum(n)])
            n_groups, sha = al.digests()
            small, many = pair.astype(np.uint32), n.astype(np.uint32)
            pairs.append(small)
            parts.append(pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(al.at_a)), pa.array(np.diff(al.at_b)),
                 pa.array(np.bincount(al.a["doc"].to_numpy()[al.lap_a], minlength=al.n)), pa.array(n_groups),
                 pa.array(total[at[1:]] - total[at[:-1]]), pa.array(sha, pa.string()),
                 pa.array([small[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()),
                 pa.array([many[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_overlaps", "n_groups", "n_links", "groups_sha256", "pairs", "links"]))
            size += n_bytes
            if size >= BLOCK:
                yield from close()
                block, parts, pairs, size = block + 1, [], [], 0
        if parts:
            yield from close()
        release()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, DOCUMENT)


def pair_rows(blocks: DataFrame) -> DataFrame:
    """(block, pair, n) from the blocks' distinct pairs."""

    def run(batches):
        for batch in batches:
            for block, pairs, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                pairs = np.frombuffer(pairs, np.uint32).astype(np.int64)
                for i in range(0, len(pairs), 1 << 17):
                    part = slice(i, i + (1 << 17))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs[part]), block)), pa.array(pairs[part]),
                         pa.array(np.frombuffer(n, np.uint32)[part].astype(np.int64))], names=["block", "pair", "n"])

    return blocks.where("distinct IS NOT NULL").select("block", "distinct", "documents").mapInArrow(
        run, "block long, pair long, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents of the corpus each id pair is
    linked, and whether that is the most for its A id.  An A id has at most as
    many rows as side B has ids."""
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("count").alias("most"))
    return counts.join(most, F.shiftright(counts["pair"], 16) == most["a"]).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Figures of each document's alignment, with the corpus-wide counts."""
    found = materialize(aligned(docs, path_a, path_b), "aligned")
    rows = pair_rows(found)
    counts = pair_counts(rows)
    told = rows.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")

    def look_up(documents: pa.Table, known: pa.Table) -> pa.Table:
        pair = known["pair"].to_numpy()
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        count, best = known["count"].to_numpy()[order], known["best"].to_numpy()[order]
        n_best, total = [], []
        for pairs, links in zip(documents["pairs"].to_pylist(), documents["links"].to_pylist()):
            at = np.searchsorted(pair, np.frombuffer(pairs, np.uint32).astype(np.int64))
            n = np.frombuffer(links, np.uint32).astype(np.int64)
            n_best.append(int(n[best[at]].sum()))
            total.append(int((n * count[at]).sum()))
        names = [c.split()[0] for c in RESULT.split(", ")]
        return documents.append_column("n_best", pa.array(n_best, pa.int64())) \
            .append_column("count_sum", pa.array(total, pa.int64())).select(names)

    kept = found.drop("distinct", "documents")
    return kept.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(look_up, RESULT)
