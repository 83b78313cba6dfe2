"""Ordered window work that survives hot keys.

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key in
one task; with one key holding a third of the data (the majority class,
one huge customer) that task is the whole job.  ``bucketed_running`` splits
each key into ``(key, bucket)`` window partitions, where ``bucket`` is any
expression that never decreases along the order inside a key (a hash prefix
when the order is by that hash, a score bin, a day number).  Per-bucket
totals form a small table whose prefix sums are the offsets added back, so
the result is exactly the single-partition window's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__ord_bucket"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucketed_running(df: DataFrame, keys: Sequence[str], bucket: Column,
                     order: Sequence, *, row_number: str | None = None,
                     key_count: str | None = None,
                     sums: dict[str, Column] | None = None,
                     nexts: dict[str, Column] | None = None) -> DataFrame:
    """Add per-key ordered columns.

    * ``row_number``: 1-based position in ``order`` within the key;
    * ``key_count``: number of rows of the key;
    * ``sums``: ``name -> value``; running sum from the first row of the key
      to the current row (nulls skipped, null while nothing was summed);
    * ``nexts``: ``name -> value``; the value on the next row (``lead``).

    ``order`` must be a total order inside a key (add a unique tiebreak).
    """
    sums = dict(sums or {})
    nexts = dict(nexts or {})
    keys = list(keys)
    order_cols = [_c(o) for o in order]
    d = df.withColumn(_B, bucket)
    for n, v in sums.items():
        d = d.withColumn(f"__ord_v_{n}", v)
    for n, v in nexts.items():
        d = d.withColumn(f"__ord_n_{n}", v)

    w = Window.partitionBy(*keys, _B).orderBy(*order_cols)
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = d.withColumn("__ord_rn", F.row_number().over(w))
    for n in sums:
        local = local.withColumn(f"__ord_ls_{n}", F.sum(f"__ord_v_{n}").over(w_run))
    if nexts:
        local = local.withColumn("__ord_last", F.lead(F.lit(1)).over(w).isNull())
        for n in nexts:
            local = local.withColumn(f"__ord_ln_{n}", F.lead(f"__ord_n_{n}").over(w))

    # One row per (key, bucket): counts, sums, first value of each `next`.
    # Aggregated from the input (not the windowed rows) so that map-side
    # partial aggregation shrinks the shuffle to one row per bucket and task.
    aggs = [F.count(F.lit(1)).alias("__ord_t_cnt")]
    aggs += [F.sum(f"__ord_v_{n}").alias(f"__ord_t_{n}") for n in sums]
    first_key = F.struct(*order_cols)
    aggs += [F.min_by(f"__ord_n_{n}", first_key).alias(f"__ord_f_{n}") for n in nexts]
    totals = d.groupBy(*keys, _B).agg(*aggs)

    wb = Window.partitionBy(*keys).orderBy(_B)
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    offs = [F.coalesce(F.sum("__ord_t_cnt").over(before), F.lit(0)).alias("__ord_o_cnt")]
    if key_count:
        offs.append(F.sum("__ord_t_cnt").over(Window.partitionBy(*keys)).alias("__ord_o_total"))
    offs += [F.sum(f"__ord_t_{n}").over(before).alias(f"__ord_o_{n}") for n in sums]
    offs += [F.lead(f"__ord_f_{n}").over(wb).alias(f"__ord_x_{n}") for n in nexts]
    offsets = totals.select(*keys, _B, *offs)

    cond = [local[k].eqNullSafe(offsets[k]) for k in keys] + [local[_B].eqNullSafe(offsets[_B])]
    j = local.join(offsets, on=cond, how="inner")
    j = j.select(local["*"], *[offsets[c] for c in offsets.columns if c not in keys and c != _B])

    out = j
    if row_number:
        out = out.withColumn(row_number, (F.col("__ord_o_cnt") + F.col("__ord_rn")).cast("bigint"))
    if key_count:
        out = out.withColumn(key_count, F.col("__ord_o_total").cast("bigint"))
    for n in sums:
        o, s = F.col(f"__ord_o_{n}"), F.col(f"__ord_ls_{n}")
        out = out.withColumn(n, F.when(o.isNull(), s).when(s.isNull(), o).otherwise(o + s))
    for n in nexts:
        out = out.withColumn(n, F.when(F.col("__ord_last"), F.col(f"__ord_x_{n}"))
                             .otherwise(F.col(f"__ord_ln_{n}")))
    drop = [c for c in out.columns if c.startswith("__ord_")]
    return out.drop(*drop)


def hash_prefix_bucket(hash_hex: Column, digits: int = 3) -> Column:
    """Bucket for orders by a hex hash: its first ``digits`` characters, so
    the bucket order equals the hash order (16**digits buckets per key)."""
    return F.substring(hash_hex, 1, digits)


def with_quantile_bucket(df: DataFrame, col: str, out: str, n: int = 1024,
                         accuracy: int = 10000) -> DataFrame:
    """Add ``out``: the index of ``col`` among ``n - 1`` approximate
    quantile cut points (equal-count buckets, monotone in ``col``).  The cut
    points are one sketch aggregation (n numbers, collected); the lookup
    is ``Bucketizer``'s binary search on the JVM, so n can be large."""
    from pyspark.ml.feature import Bucketizer
    probs = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(col, probs, accuracy)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0).cast("int"))
    tmp = f"__qb_{out}"
    b = Bucketizer(splits=splits, inputCol=col, outputCol=tmp, handleInvalid="keep")
    return b.transform(df.withColumn(col, F.col(col).cast("double"))).withColumn(out, F.col(tmp).cast("int")).drop(tmp)
