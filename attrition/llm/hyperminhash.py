"""Near-duplicates by HyperMinHash.

A text's set is its distinct word shingles.  Every shingle hash falls into one
of ``BUCKETS`` buckets; the smallest rest of the hash in a bucket is kept in
compressed form, the count of its leading zeros and the ``MANTISSA`` bits after
them.  An empty bucket takes the register of another one, in a fixed order of
its own.  Bands of registers bring candidates together; the share of equal
registers, corrected for chance collisions, estimates the Jaccard similarity;
what passes with a margin is verified on the full sets.

No bucket is expanded into pairs.  First every text is compared with the
smallest id of its buckets, and the verified links are joined into components.
Only buckets that still hold several components are looked at again, and there
only texts of different components are compared, in numpy: first each proposes
its likeliest partners; what these links have not joined proposes every partner
that passes the estimate and a comparison of the sets.  A large bucket is cut
into slices, and a task compares two of them, so none holds a whole bucket.  Texts with the same
words are one text throughout.

Nulls, empty texts and texts without words have an empty set and link with
nothing.  A null id counts as the smallest id.  Repeated rows are copies of
one text; ids are taken to be unique, of several texts with one id the smallest
is compared.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import LOWER, SPACE, WordHasher, mix64, powers, release, rolling, row_blocks, spans_of, utf8
from attrition.session import materialize

BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
#: Chance of equal registers of unrelated sets, for ``MANTISSA`` bits.
COLLISION = 0.169919487159739 / (1 << MANTISSA)
#: How far an estimate may lie below the threshold: four standard deviations.
MARGIN = 4 * (0.8 * 0.2 / BUCKETS) ** 0.5
#: Bits of the filter by which texts to verify are picked in the scan.
FILTER_BITS = 1 << 23
LEAST = -(1 << 63)
#: Partners that a text proposes in a bucket, round by round; at last all
#: whose sets pass.
PROPOSED = (2, None)
#: Most rows, and bytes of registers and sets, that a slice of a bucket has on
#: average; a task compares two slices.
SLICE_ROWS, SLICE_BYTES = 4096, 64 << 20


def word_sets(data: np.ndarray, offsets: np.ndarray, words: int):
    """Of the texts of a block: (row of each distinct shingle, its hash, in
    order; two hashes of each text's words; number of words)."""
    data = LOWER[data]
    start, end, before = spans_of(~SPACE[data], offsets)
    h = WordHasher()(data, start, end)
    count = np.diff(before)
    row = np.repeat(np.arange(len(count)), count)
    left = before[row + 1] - np.arange(len(row))
    at = np.flatnonzero(left >= words)
    sequence = []
    for base in (0xD6E8FEB86659FD93, 0xA24BAED4963EE407):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)))])
        inverse = np.array([pow(base, -int(b), 1 << 64) for b in before[:-1]], np.uint64)
        sequence.append(mix64((total[before[1:]] - total[before[:-1]]) * inverse + count.astype(np.uint64)))
    short = np.flatnonzero((count > 0) & (count < words))
    rows = np.concatenate([row[at], short])
    hashes = np.concatenate([mix64(rolling(h, words))[at], sequence[0][short]])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new], sequence, count


#: For every bucket the order in which others lend it their register.
LENDERS = np.argsort(np.random.default_rng(20).random((BUCKETS, BUCKETS)), axis=1)


def registers(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x BUCKETS, 16 bits) of sets given as ordered (row, hash)."""
    rest_bits = 64 - BUCKETS.bit_length() + 1
    bucket = (hashes >> np.uint64(rest_bits)).astype(np.int64)
    cell = rows * BUCKETS + bucket
    first = np.flatnonzero(np.diff(cell, prepend=-1))        # the smallest rest of each cell
    rest = hashes[first] & np.uint64((1 << rest_bits) - 1)
    length = np.frexp((rest >> np.uint64(8)).astype(np.float64))[1] + 8    # bits after the leading zeros
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    code = ((rest_bits - length).astype(np.uint64) << np.uint64(MANTISSA)) | ((rest >> shift) & np.uint64((1 << MANTISSA) - 1))
    out = np.full(n * BUCKETS, -1, np.int32)
    out[cell[first]] = code.astype(np.int32)
    out = out.reshape(n, BUCKETS)
    r, b = np.nonzero((out < 0) & (out >= 0).any(1)[:, None])
    known = out.copy()
    for turn in range(BUCKETS):
        if not len(r):
            break
        lent = known[r, LENDERS[b, turn]]
        ok = lent >= 0
        out[r[ok], b[ok]] = lent[ok]
        r, b = r[~ok], b[~ok]
    return np.maximum(out, 0).astype(np.uint16)


def estimate(equal: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers."""
    return np.maximum(equal - COLLISION, 0) / (1 - COLLISION)


SIGNED = "node long, n_shingles long, s1 long, s2 long, registers binary"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0)
            for i, j in row_blocks(offsets):
                rows, hashes, seq, _ = word_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], words)
                regs = registers(rows, hashes, j - i)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.bincount(rows, minlength=j - i).astype(np.int64)),
                     *[pa.array(s.view(np.int64)) for s in seq], pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["node", "n_shingles", "s1", "s2", "registers"])
        release()

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("node"), "text").mapInArrow(run, SIGNED)


def needed_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given nodes.  A bitmap of fixed size made of the
    nodes' hashes is held against the scan, so that few other texts are
    shuffled; the join decides."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)) + 1
    got = (nodes.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("k"))
           .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits")).collect())
    seen = np.zeros(FILTER_BITS + 8, bool)
    for r in got:      # bucket k holds the positions 32768 * (k - 1) + 1 ..
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little")
        seen[np.flatnonzero(bits) + (r["k"] - 1) * 32768 + 1] = True
    shared = spark.sparkContext.broadcast(np.packbits(seen))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("node"), "text")

    def run(batches):
        member = np.unpackbits(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(member[batch.column(2).to_numpy()].astype(bool))).select(["node", "text"])

    picked = rows.withColumn("bit", bit).mapInArrow(run, "node long, text string")
    # of rows that repeat an id with another text the smallest text counts
    return picked.join(nodes.select("node"), "node").groupBy("node").agg(F.min("text").alias("text"))


def verify(pairs: DataFrame, texts: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """The pairs (a, b) with whole * |A and B| >= part * |A or B|."""
    joined = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
              .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def run(batches):
        last, hashes = None, None
        for batch in batches:
            ok = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b != last or hashes is None:
                    last, hashes = b, shingles(tb, words)
                other = shingles(ta, words)
                both = len(np.intersect1d(hashes, other, assume_unique=True))
                ok.append(both > 0 and whole * both >= part * (len(hashes) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    return joined.mapInArrow(run, "a long, b long")


def shingles(text: str, words: int) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return word_sets(raw, np.array([0, len(raw)]), words)[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest
    label among neighbours, and then the label's own label, until nothing
    changes.  Every round is written to the shared folder."""
    both = materialize(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component"))
                         .withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b").withColumnRenamed("component", "c"), "b")
                .groupBy("a").agg(F.min("c").alias("c")).withColumnRenamed("a", "node"))
        step = labels.join(near, "node").select("node", F.least("component", "c").alias("next"),
                                                F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("over"))
        step = materialize(step.join(jump, "next").select(
            "node", F.least("next", "over").alias("component"), "old"), "labels")
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels


def cross_pairs(table: pa.Table, least: float, part: int, whole: int, most: int | None) -> pa.Table:
    """Pairs of texts of a bucket (or of two of its slices), of different
    components, that may reach the similarity by their sizes and whose
    estimate is at least ``least``.  Every text marked ``asks`` is held against
    all texts of other components marked ``answers`` and proposes its ``most``
    likeliest partners.  With None
    it proposes all whose sets (``small``, 32 bits of each shingle hash) reach
    the similarity, a pair only in the first band that its texts share."""
    node, comp, n = table["node"].to_numpy(), table["component"].to_numpy(), table["n_shingles"].to_numpy()
    regs = np.stack([np.frombuffer(r, np.uint16) for r in table["registers"].to_pylist()])
    asks, answers = (table[c].to_numpy().astype(bool) for c in ("asks", "answers"))
    bands, a, b = regs[:, :BANDS * ROWS].copy().view(np.uint64), [], []
    if most is None:
        band = int(table["band"][0].as_py())
        sets = [np.frombuffer(x, np.uint32) for x in table["small"].to_pylist()]
    for i in np.flatnonzero(asks):
        others = np.flatnonzero(answers & (comp != comp[i]) & (part * np.maximum(n, n[i]) <= whole * np.minimum(n, n[i])))
        found = [(estimate((regs[o] == regs[i]).mean(1)), o) for o in np.split(others, range(4096, len(others), 4096))]
        likely, others = np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found])
        hit = np.flatnonzero(likely >= least)
        if most is not None and len(hit) > most:
            hit = hit[np.lexsort((node[others[hit]], -likely[hit]))[:most]]
        if most is None:
            hit = hit[~(bands[others[hit], :band] == bands[i, :band]).any(1)]
            both = np.array([len(np.intersect1d(sets[i], sets[o], assume_unique=True)) for o in others[hit]], np.int64)
            hit = hit[whole * both >= part * (n[i] + n[others[hit]] - both)]
        partner = node[others[hit]]
        a.append(np.maximum(partner, node[i]))
        b.append(np.minimum(partner, node[i]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def sliced(held: DataFrame, slice_rows: int, slice_bytes: int) -> DataFrame:
    """The rows of ``held`` (key, node, component, n_shingles) with the pairs
    of slices (``i``, ``j``) that they take part in.  Texts outside a bucket's
    largest component ask, all texts answer; slice i of those that ask meets
    slice j of those that answer, so every pair of different components meets.
    A bucket of one slice is one group, each row in it once."""
    weight = F.lit(2 * BUCKETS) + 4 * F.col("n_shingles")
    part = held.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    size = part.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("big"), F.sum("n").alias("n"), F.sum("w").alias("w"))

    def slices(n, w):
        return F.greatest(F.lit(1), F.ceil(n / slice_rows), F.ceil(w / slice_bytes)).cast("int")

    size = size.select("key", F.col("big.component").alias("largest"), slices(F.col("n"), F.col("w")).alias("n_answer"),
                       slices(F.col("n") - F.col("big.n"), F.col("w") - F.col("big.w")).alias("n_ask"))
    rows = held.join(size, "key").withColumn("_ask", F.col("component") != F.col("largest"))
    rows = (rows.withColumn("_i", F.pmod(F.xxhash64("node", F.lit(1)), "n_ask").cast("int"))
            .withColumn("_j", F.pmod(F.xxhash64("node", F.lit(2)), "n_answer").cast("int")))
    answer = F.transform(F.sequence(F.lit(0), F.col("n_ask") - 1), lambda i: F.struct(
        i.alias("i"), F.col("_j").alias("j"), (F.col("_ask") & (i == F.col("_i"))).alias("asks"), F.lit(True).alias("answers")))
    other = F.filter(F.sequence(F.lit(0), F.col("n_answer") - 1), lambda j: F.col("_ask") & (j != F.col("_j")))
    ask = F.transform(other, lambda j: F.struct(
        F.col("_i").alias("i"), j.alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers")))
    return rows.withColumn("_at", F.explode(F.concat(answer, ask))).select(*held.columns, "_at.*")


def _small_sets(words: int):
    """(node, 32 bits of each shingle hash, in order).  Different shingles
    with equal bits count once for each, so a link is never lost."""
    def run(batches):
        for batch in batches:
            sets = [(shingles(t, words) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "small"])
    return run


def _proposing(least: float, part: int, whole: int, most: int | None):
    def run(table: pa.Table) -> pa.Table:
        return cross_pairs(table, least, part, whole, most)
    return run


def near_duplicates(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100, slice_rows: int = SLICE_ROWS,
                    slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """node (the id), n_shingles, component and s1 and s2 (hashes of the words)
    of each row; the component is the smallest id that links lead to."""
    least = part / whole - MARGIN
    signed = materialize(signatures(docs, words), "signatures")
    rep = materialize(signed.where("n_shingles > 0").groupBy("s1", "s2").agg(
        F.min("node").alias("node"), F.min_by("registers", "node").alias("registers"), F.max("n_shingles").alias("n_shingles")), "texts")
    regs = rep.select("node", "registers", "n_shingles")
    keys = rep.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "registers").select(
        "node", "band", F.expr(f"xxhash64(band, substring(registers, band * {2 * ROWS} + 1, {2 * ROWS}))").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = materialize(keys.join(shared, "key"), "buckets")

    # each text against the smallest id of each of its buckets
    star = buckets.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    star = (star.join(regs.select(F.col("node").alias("a"), F.col("registers").alias("ra")), "a")
            .join(regs.select(F.col("node").alias("b"), F.col("registers").alias("rb")), "b").mapInArrow(_passing(least), "a long, b long"))
    star = materialize(star.groupBy("a").agg(F.min("b").alias("b")), "star")
    links = verified(docs, star, words, part, whole)
    labels = components(links)

    # buckets that still hold several components, the likeliest partners first
    tested = star
    for most in PROPOSED:
        named = buckets.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        mixed = materialize(named.join(mixed.select("key"), "key").join(rep.select("node", "n_shingles"), "node"), "mixed")
        held = sliced(mixed, slice_rows, slice_bytes).join(rep.select("node", "registers"), "node")
        if most is None:
            texts = needed_texts(docs, materialize(mixed.select("node").distinct(), "nodes"))
            held = held.join(texts.mapInArrow(_small_sets(words), "node long, small binary"), "node")
        again = (held.groupBy("key", "i", "j")
                 .applyInArrow(_proposing(least, part, whole, most), "a long, b long"))
        fresh = materialize(again.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        if fresh.isEmpty():
            continue
        links = links.union(verified(docs, fresh, words, part, whole))
        tested = tested.union(fresh)
        labels = components(links)

    found = signed.join(rep.select("s1", "s2", F.col("node").alias("text_node")), ["s1", "s2"], "left")
    found = found.join(labels.withColumnRenamed("node", "text_node"), "text_node", "left")
    return found.select("node", "n_shingles", "s1", "s2", F.when(F.col("n_shingles") > 0, F.coalesce("component", "text_node"))
                        .otherwise(F.col("node")).alias("component"))


def verified(docs: DataFrame, pairs: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = needed_texts(docs, nodes)
    return materialize(verify(pairs, texts, words, part, whole), "links")


def _passing(least: float):
    def run(batches):
        for batch in batches:
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                      for k in (batch.schema.get_field_index("ra"), batch.schema.get_field_index("rb")))
            if batch.num_rows:
                ok = estimate((ra == rb).mean(1)) >= least
                yield batch.select(["a", "b"]).filter(pa.array(ok))
    return run


def original(column: str):
    """The id of a node (a null id is the smallest node)."""
    return F.when(F.col(column) != LEAST, F.col(column))
