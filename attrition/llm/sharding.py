"""Shards by fixed virtual slots.

Every record is hashed into one of thousands of slots, which never changes.
Bytes are added up per slot, and a versioned map says which shard holds a
slot.  Rebalancing edits the map (it moves slots, never single records), so a
new version moves little data, and a grown map moves slots only into the new
shard.

Nulls: a null text has no bytes, a null id is hashed like any other value.
Equal rows (same id and text) share a slot and get places of their own.  An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """``shard[slot]`` of one version."""
    version: int
    n_shards: int
    shard: np.ndarray

    @staticmethod
    def first(n_slots: int, n_shards: int) -> SlotMap:
        return SlotMap(1, n_shards, np.arange(n_slots) % n_shards)

    def loads(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.shard, weights=weight, minlength=self.n_shards)


def rebalance(slots: SlotMap, weight: np.ndarray, max_edits: int = 100_000) -> SlotMap:
    """The next version: the heaviest and the lightest shard exchange the slot
    (or the pair of slots) that comes nearest to half their difference, until
    no exchange brings the two closer."""
    shard, load = slots.shard.copy(), slots.loads(weight)
    for _ in range(max_edits):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        if gap <= 1:
            break
        a, b = np.flatnonzero(shard == hi), np.flatnonzero(shard == lo)
        b = b[np.argsort(weight[b], kind="stable")]
        # "nothing" in exchange is the partner of weight 0 at index -1
        other = np.concatenate([[0], weight[b]])
        want = weight[a] - gap / 2
        at = np.clip(np.searchsorted(other, want), 1, len(other) - 1) if len(b) else np.zeros(len(a), int)
        at = np.where(np.abs(other[at - 1] - want) <= np.abs(other[at] - want), at - 1, at) if len(b) else at
        moved = weight[a] - other[at]
        gain = np.where((moved > 0) & (moved < gap), np.minimum(moved, gap - moved), 0)
        if not len(a) or gain.max() <= 0:
            break
        i = int(gain.argmax())
        shard[a[i]] = lo
        if at[i] > 0:
            shard[b[at[i] - 1]] = hi
        load[hi] -= moved[i]
        load[lo] += moved[i]
    return SlotMap(slots.version + 1, slots.n_shards, shard)


def grow(slots: SlotMap, weight: np.ndarray) -> SlotMap:
    """The next version with one more shard: slots move only into it, each
    from the shard that is heaviest at that moment among those with a slot
    that fits."""
    n, shard = slots.n_shards + 1, slots.shard.copy()
    load = np.bincount(shard, weights=weight, minlength=n)
    goal = load.sum() / n
    while load[-1] < goal:
        fits = (shard < n - 1) & (weight > 0) & (weight <= goal - load[-1])
        if not fits.any():
            break
        # the heaviest shard that has a slot that fits, and its largest such slot
        s = int(np.lexsort((-weight, -load[shard], ~fits))[0])
        load[shard[s]] -= weight[s]
        load[-1] += weight[s]
        shard[s] = n - 1
    return SlotMap(slots.version + 1, n, shard)


def store(spark: SparkSession, path: str, slots: SlotMap) -> None:
    """Write one version of the map beside the others."""
    rows = [(s, int(h), slots.n_shards) for s, h in enumerate(slots.shard)]
    spark.createDataFrame(rows, "slot int, shard int, n_shards int").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/version={slots.version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """One stored version (the newest, if none is named)."""
    t = spark.read.parquet(path)
    v = version if version is not None else t.agg(F.max("version")).first()[0]
    rows = sorted(t.where(F.col("version") == v).collect(), key=lambda r: r["slot"])
    return SlotMap(int(v), rows[0]["n_shards"], np.array([r["shard"] for r in rows]))


def digest(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each distinct row, with
    the number of rows that repeat it (``copies``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    (F.octet_length(text) + 1).cast("long").alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"))
    d = d.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n_slots)).cast("int"))
    return d.groupBy("virtual_slot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))


def slot_bytes(digests: DataFrame, n_slots: int = N_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows per slot: at most ``n_slots`` rows come to the driver."""
    size, rows = np.zeros(n_slots), np.zeros(n_slots, np.int64)
    for r in digests.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("b"),
                                                 F.sum("copies").alias("n")).collect():
        size[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"], r["n"]
    return size, rows


def assign(digests: DataFrame, slots: SlotMap, rows_per_slot: np.ndarray) -> DataFrame:
    """Every row with its shard and its place in the shard, gapless from 0:
    places inside a slot are counted per slot, and the map carries each slot's
    offset in its shard (``n_slots`` rows, hence broadcast)."""
    spark = digests.sparkSession
    offset = np.zeros(len(slots.shard), np.int64)
    for s in range(slots.n_shards):
        own = np.flatnonzero(slots.shard == s)
        offset[own] = np.concatenate([[0], np.cumsum(rows_per_slot[own])[:-1]]) if len(own) else 0
    table = spark.createDataFrame([(i, int(h), int(o)) for i, (h, o) in enumerate(zip(slots.shard, offset))],
                                  "virtual_slot int, shard int, slot_offset long")
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = digests.withColumn("before", F.sum("copies").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return (placed.join(F.broadcast(table), "virtual_slot")
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
            .withColumn("slot", F.coalesce("before", F.lit(0)) + F.col("copy") + F.col("slot_offset")))
