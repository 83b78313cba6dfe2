"""SimHash fingerprints, and search by permuted block tables.

A text's terms are its word shingles (a text of fewer words is one term),
weighted by how often they occur.  Every term's hash votes on each bit of the
fingerprint, plus or minus its weight; the sign of the sum is the bit.

For the search within a small Hamming radius r the fingerprint is cut into
blocks: two fingerprints within r agree in all but r blocks, so a table for each
choice of agreeing blocks, keyed by their bits, holds every partner.  Texts of a
Jaccard similarity of 0.8 differ in up to about 27 of the 128 bits; at that
radius only blocks of 4 bits agree for certain, whose tables hold nearly all
pairs.  The near counts therefore compare every query fingerprint with every
fingerprint, chunk by chunk, and miss none within the radius.

Nulls and empty texts have no terms and the fingerprint of all zero bits.
Equal texts have equal fingerprints.  Documents follow each other by doc_id,
a null id first; rows that repeat an id are put in order by their text.  Other
columns are ignored; an empty table gives no rows; a lone document is its own
next.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.blocks import packed
from attrition.llm.common import LOWER, SPACE, WordHasher, mix64, powers, rolling, spans_of
from attrition.session import materialize

BITS, WORDS, RADIUS, BLOCKS = 128, 5, 3, 4
#: Similarity that the near counts are to find, and the radius they take for it.
SIMILARITY, NEAR_RADIUS = 0.8, 27
#: Fingerprints in a chunk of the queries and of all, and chunks of the queries at least.
ASKED_CHUNK, CHUNK, ASKED_CHUNKS = 4096, 1 << 16, 4
#: Bytes of text fingerprinted at a time.
TEXT_BYTES = 1 << 20


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Fingerprints (texts x BITS / 8 bytes)."""
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end, before = spans_of(~SPACE[data], offsets)
    h = WordHasher()(data, start, end)
    count = np.diff(before)
    row = np.repeat(np.arange(len(texts)), count)
    at = np.flatnonzero(before[row + 1] - np.arange(len(row)) >= words)
    terms = mix64(rolling(h, words))[at]
    begin = np.searchsorted(row[at], np.arange(len(texts) + 1))
    base = powers(0x9E3779B97F4A7C15, words)
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for i in range(len(texts)):
        if count[i] >= words:
            own = terms[begin[i]:begin[i + 1]]
        elif count[i]:
            own = mix64(np.array([(h[before[i]:before[i + 1]] * base[:count[i]]).sum()], np.uint64))
        else:
            continue
        votes = np.zeros(BITS, np.int64)
        for k in range(0, len(own), 1 << 15):       # each occurrence of a term is one vote
            part = own[k:k + (1 << 15)]
            both = np.stack([part, mix64(part ^ np.uint64(0xD6E8FEB86659FD93))], 1)
            votes += np.unpackbits(both.view(np.uint8), axis=1).sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * votes > len(own))
    return out


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """(code points, the text whose last half is replaced by the first as many
    code points of ``following``)."""
    own, other = text.decode(), following.decode()
    half = len(own) // 2
    return len(own), (own[:len(own) - half] + other[:half]).encode()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of fingerprints."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(1) / BITS


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
OPEN = SCHEMA + ", part int, head binary, tail binary"


def compare(ids: list, texts: list[bytes]) -> list[tuple]:
    """Result rows of documents that follow each other; the last one only
    serves as the next of the one before."""
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    own = fingerprints(texts)
    new = fingerprints([t for _, t in changed]) if changed else own[:0]
    near, following = likeness(own[:-1], new), likeness(own[:-1], own[1:])
    return [(i, n, hashlib.sha256(t).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), float(x), float(y))
            for i, (n, t), a, b, x, y in zip(ids, changed, own, new, near, following)]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and
    the likeness of the fingerprint to the edited text's and the next
    document's.  Documents are dealt by ranges of doc_id, so the next one is
    in the same task but for the last of a range; those are joined with the
    first of the following range."""
    expand = zstandard.ZstdDecompressor

    def run(batches):
        part, ids, texts, size, opened = TaskContext.get().partitionId(), [], [], 0, False
        z = expand()

        def rows():
            found = [(*r, part, None, None) for r in compare(ids, texts)]
            del ids[:-1], texts[:-1]
            return _open(found)

        for batch in batches:
            for i, squeezed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = z.decompress(squeezed)
                if not opened:
                    opened = True
                    yield _open([(None,) * 7 + (part, squeezed, None)])
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size > TEXT_BYTES:
                    yield rows()
                    size = len(texts[-1])
        if texts:
            yield rows()
            yield _open([(ids[-1],) + (None,) * 6 + (part, None, zstandard.ZstdCompressor(level=1).compress(texts[-1]))])

    def join_ends(batches):
        z = expand()
        for batch in batches:
            out = []
            for i, tail, head in zip(*(batch.column(k).to_pylist() for k in range(3))):
                out += compare([i], [z.decompress(tail), z.decompress(head)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _kinds()[:7])] if out else
                                             [pa.array([], t) for t in _kinds()[:7]], names=COLUMNS)

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = packed(docs).select("doc_id", "packed").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "packed")
    done = materialize(ranged.mapInArrow(run, OPEN), "fingerprints")
    # one number per range of ids comes to the driver
    parts = sorted(r["part"] for r in done.where("head is not null").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    ends = (done.where("tail is not null").select("doc_id", "tail", "part").join(F.broadcast(following), "part")
            .join(done.where("head is not null").select(F.col("part").alias("next"), "head"), "next")
            .select("doc_id", "tail", "head").mapInArrow(join_ends, SCHEMA))
    return done.where("head is null and tail is null").select(*COLUMNS).unionByName(ends)


def _kinds() -> list:
    return [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
            pa.int32(), pa.binary(), pa.binary()]


def _open(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _kinds())], names=COLUMNS + ["part", "head", "tail"])


def within(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (query, fingerprint) of distinct fingerprints (columns hi, lo)
    within the radius, found in the permuted tables.  Both sides have one row
    per distinct fingerprint."""
    if not 0 <= radius < blocks or BITS % blocks:
        raise ValueError("the radius leaves at least one block that agrees")
    size = BITS // blocks
    chosen = list(combinations(range(blocks), blocks - radius))

    def bits(block: int):
        shift, word = (block * size) % 64, "hi" if block * size < 64 else "lo"
        return F.expr(f"shiftrightunsigned({word}, {64 - size - shift})").bitwiseAND((1 << size) - 1)

    def keyed(df: DataFrame) -> DataFrame:
        keys = F.array(*[F.xxhash64(F.lit(i), *[bits(b) for b in c]) for i, c in enumerate(chosen)])
        return df.select("hi", "lo", F.explode(keys).alias("key"))

    q = keyed(queries).toDF("qhi", "qlo", "key")
    distance = F.bit_count(F.col("hi").bitwiseXOR(F.col("qhi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("qlo")))
    return keyed(corpus).join(q, "key").where(distance <= radius).select("qhi", "qlo", "hi", "lo").distinct()


def chunks(df: DataFrame, n: int, number: str) -> DataFrame:
    """The fingerprints (columns hi, lo, n) in ``n`` packed chunks."""

    def pack(part: pa.Table) -> pa.Table:
        return pa.table({number: part[number].slice(0, 1).cast(pa.int32()),
                         "packed": pa.array([b"".join(part[c].to_numpy().tobytes() for c in ("hi", "lo", "n"))], pa.binary())})

    dealt = df.select("hi", "lo", "n", F.pmod(F.xxhash64("hi", "lo"), F.lit(n)).cast("int").alias(number))
    return dealt.groupBy(number).applyInArrow(pack, f"{number} int, packed binary")


def scan(queries: DataFrame, corpus: DataFrame, radius: int = NEAR_RADIUS) -> DataFrame:
    """(qhi, qlo, n): of each query fingerprint, the sum of n over the
    fingerprints of the corpus within the radius, by comparing all.  Both
    sides have one row (hi, lo, n) per distinct fingerprint."""
    width = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_asked = max(ASKED_CHUNKS, math.ceil(queries.count() / ASKED_CHUNK))
    n = max(width, math.ceil(corpus.count() / CHUNK))

    def compare_chunks(batches):
        for batch in batches:
            for asked, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q, x = (np.frombuffer(raw, np.int64).reshape(3, -1) for raw in (asked, held))
                total = np.zeros(q.shape[1], np.int64)
                for i, (hi, lo) in enumerate(q[:2].T.view(np.uint64)):
                    # np.bitwise_count takes the absolute value of signed numbers
                    distance = np.bitwise_count(x[0].view(np.uint64) ^ hi) + np.bitwise_count(x[1].view(np.uint64) ^ lo)
                    total[i] = x[2][distance <= radius].sum()
                some = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (q[0], q[1], total)], names=["qhi", "qlo", "n"])

    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk")
    asked = chunks(queries, n_asked, "asked").select(F.col("packed").alias("asked_packed"), every)
    pairs = asked.join(chunks(corpus, n, "chunk"), "chunk").select("asked_packed", "packed")
    found = pairs.mapInArrow(compare_chunks, "qhi long, qlo long, n long")
    return found.groupBy("qhi", "qlo").agg(F.sum("n").alias("n"))


def near_counts(found: DataFrame, is_query) -> DataFrame:
    """(fingerprint, n_near): other documents within ``NEAR_RADIUS`` of each
    query document's fingerprint; equal fingerprints count."""
    word = lambda k: F.conv(F.substring("fingerprint", 1 + 16 * k, 16), 16, -10).cast("long")
    marks = found.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(is_query).alias("asked"))
    marks = materialize(marks.select("fingerprint", "n", "asked", word(0).alias("hi"), word(1).alias("lo")), "marks")
    counted = scan(marks.where("asked"), marks)
    return marks.where("asked").join(counted, (F.col("hi") == F.col("qhi")) & (F.col("lo") == F.col("qlo"))).select(
        "fingerprint", (counted["n"] - 1).alias("n_near"))
