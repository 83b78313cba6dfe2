"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it whole.
Every chunk is embedded byte by byte and convolved with learned filters; each
filter's greatest response in the chunk is kept (max-pooling).  The greatest
and the mean response over all chunks are combined into one probability.

Training uses a bounded sample of labelled documents (``SAMPLE`` per class,
``TRAIN_CHUNKS`` evenly spaced chunks each); scoring reads every byte.

Null and empty texts are one chunk of padding and get a score like any other.
Repeated rows get equal scores; labels without a document and other columns
are ignored; with no labels of both classes every score is the share of
label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.llm.common import release, row_blocks, utf8

SAMPLE, TRAIN_CHUNKS = 2000, 12
CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 6, 24
PAD = 256
EPOCHS, BATCH, RATE = 10, 64, 0.01
SCORE_CHUNKS = 512      # chunks convolved at a time


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def chunks(data: np.ndarray, offsets: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK byte codes, row of each chunk); ``most``: so many
    evenly spaced chunks of a row at most (training only)."""
    size, step = np.diff(offsets), CHUNK - OVERLAP
    n = np.maximum(1, -(-(size - OVERLAP) // step))
    take = n if most is None else np.minimum(n, most)
    row = np.repeat(np.arange(len(size)), take)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
    at = nth if most is None else nth * n[row] // take[row]
    begin = offsets[:-1][row] + at * step
    index = begin[:, None] + np.arange(CHUNK)
    inside = index < offsets[1:][row][:, None]
    padded = np.append(data, np.uint8(0)).astype(np.int16)
    return np.where(inside, padded[np.minimum(index, len(data))], PAD), row


class Network:
    """Embedding, filters, and the weights of the pooled responses."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.weights, self.bias]

    def pooled(self, codes: np.ndarray, places: bool = False):
        """Max-pooled responses of each chunk (and where they were)."""
        x = self.embed[codes].reshape(len(codes), CHUNK * EMBED)
        n = (CHUNK - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(
            x, (len(codes), n, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * 4, 4))
        y = (view.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(codes), n, FILTERS)
        top = np.maximum(y.max(1) + self.shift, 0)
        return (top, y.argmax(1), view) if places else top

    def logits(self, greatest: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.concatenate([greatest, mean], 1) @ self.weights + self.bias[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability per row; rows of a block, every chunk of each."""
        n = len(offsets) - 1
        greatest, total, count = np.zeros((n, FILTERS), np.float32), np.zeros((n, FILTERS)), np.zeros(n)
        for i, j in row_blocks(offsets, SCORE_CHUNKS * CHUNK):
            codes, row = chunks(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            for k in range(0, len(codes), SCORE_CHUNKS):
                top, own = self.pooled(codes[k:k + SCORE_CHUNKS]), row[k:k + SCORE_CHUNKS]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                rows = own[first] + i
                greatest[rows] = np.maximum(greatest[rows], np.maximum.reduceat(top, first))
                total[rows] += np.add.reduceat(top, first)
                count[rows] += np.diff(np.append(first, len(own)))
        z = self.logits(greatest, (total / count[:, None]).astype(np.float32))
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def fit(texts: list[bytes], label: np.ndarray, weight: np.ndarray, seed: int = 7) -> Network:
    """Adam on the weighted log loss over mini-batches of documents.  Max
    pooling sends a gradient only to the window with the greatest response."""
    net, rng = Network(seed), np.random.default_rng(seed)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes, row = chunks(data, offsets, TRAIN_CHUNKS)
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    params = net.parameters()
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            docs = order[b:b + BATCH]
            take = np.concatenate([np.arange(begin[d], begin[d + 1]) for d in docs])
            size = begin[docs + 1] - begin[docs]
            cut = np.cumsum(size) - size
            own = np.repeat(np.arange(len(docs)), size)
            top, place, view = net.pooled(codes[take], places=True)
            greatest, mean = np.maximum.reduceat(top, cut), np.add.reduceat(top, cut) / size[:, None]
            z = net.logits(greatest, mean)
            dz = ((1 / (1 + np.exp(-z)) - label[docs]) * weight[docs] / weight[docs].sum()).astype(np.float32)
            g_weights = dz @ np.concatenate([greatest, mean], 1) + 1e-4 * net.weights
            d_greatest, d_mean = dz[:, None] * net.weights[:FILTERS], dz[:, None] * net.weights[FILTERS:]
            is_top = top == greatest[own]
            share = is_top / np.maximum(np.add.reduceat(is_top, cut, dtype=np.float32)[own], 1)
            d_top = (d_greatest[own] * share + d_mean[own] / size[own, None]) * (top > 0)
            patch = view[np.arange(len(take))[:, None], place]              # chunk x filter x window
            g_filters = np.einsum("cfw,cf->wf", patch, d_top)
            d_patch = (d_top[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            where = (place * STRIDE)[:, :, None] + np.arange(WIDTH)
            byte = codes[take][np.arange(len(take))[:, None, None], where].ravel()
            g_embed = np.stack([np.bincount(byte, d_patch[:, e], 257) for e in range(EMBED)], 1)
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in enumerate((g_embed, g_filters, d_top.sum(0), g_weights, dz.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= (rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)).astype(np.float32)
    return net


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit on at most ``sample`` labelled documents of each class, those with
    the smallest id hash, weighted to the classes' true shares."""
    known = (labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
             .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
             .join(docs.select("doc_id").distinct(), "doc_id", "left_semi"))
    total = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    net = Network()
    if len(total) < 2:
        net.weights[:] = 0
        net.bias[:] = 0 if not total else (4 if 1 in total else -4)
        return net
    ids = None
    for q in (0, 1):
        part = known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.unionByName(part)

    def cut(batches):  # only the bytes that training looks at leave the task
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            texts = [_sampled(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)],
                                             names=["doc_id", "bytes", "quality"])

    rows = (docs.select(F.col("doc_id"), "text").join(F.broadcast(ids), "doc_id")
            .selectExpr("cast(doc_id as long) doc_id", "text", "quality")
            .mapInArrow(cut, "doc_id long, bytes binary, quality int").collect())
    rows.sort(key=lambda r: (r["doc_id"], r["bytes"]))
    label = np.array([r["quality"] for r in rows])
    weight = np.where(label == 1, total[1] / max(1, (label == 1).sum()), total[0] / max(1, (label == 0).sum()))
    return fit([bytes(r["bytes"]) for r in rows], label, weight / weight.mean())


def _sampled(data: np.ndarray) -> bytes:
    """The bytes under ``TRAIN_CHUNKS`` evenly spaced chunks of a text."""
    if len(data) <= TRAIN_CHUNKS * CHUNK:
        return data.tobytes()
    codes, _ = chunks(data, np.array([0, len(data)]), TRAIN_CHUNKS)
    return b"".join(c[c != PAD].astype(np.uint8).tobytes() for c in codes)


def probabilities(net: Network, column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    return net.score(data, offsets)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every document; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(probabilities(shared.value, batch.column(1)))],
                names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(probabilities(shared.value, batch.column(at)) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
