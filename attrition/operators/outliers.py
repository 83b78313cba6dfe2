"""Outlier capping (M6, M7) and box statistics (A5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.nulls import pmax, pmin
from attrition.operators.quantiles import quantile_row, quantiles


def winsor_bounds(df: DataFrame, cols: Sequence[str], lower: float = 0.01,
                  upper: float = 0.99) -> dict[str, tuple[float, float]]:
    """Per column (p_lower, p_upper) from one exact-quantile job; the result
    is cols x 2 numbers, collected like a fitted scaler's statistics."""
    q = quantile_row(df, cols, [lower, upper])
    return {c: (q.get((c, float(lower))), q.get((c, float(upper)))) for c in cols}


def winsorize(df: DataFrame, cols: Sequence[str], lower: float = 0.01, upper: float = 0.99,
              bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """M6: cap each column to its percentile bounds, R
    ``pmin(pmax(x, p1), p99)`` (null stays null).  Pass ``bounds`` learned
    on training rows to apply them to other rows."""
    bounds = bounds or winsor_bounds(df, cols, lower, upper)
    out = []
    for c in df.columns:
        if c in bounds and bounds[c][0] is not None:
            lo, hi = bounds[c]
            x = F.col(f"`{c}`")
            # Double, as R's pmin/pmax against double quantiles.
            out.append(pmin(pmax(x.cast("double"), F.lit(float(lo))), F.lit(float(hi))).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def winsor_summary(df: DataFrame, cols: Sequence[str], lower: float = 0.01,
                   upper: float = 0.99) -> DataFrame:
    """M7: per column min, max, p1, p99 (2 dp) and the numbers strictly
    below / above the bounds that capping changes (one quantile job plus
    one aggregation)."""
    q = quantiles(df, cols, [lower, upper])
    qw = (q.groupBy("variable")
          .agg(F.max(F.when(F.col("prob") == lower, F.col("value"))).alias("p_lo"),
               F.max(F.when(F.col("prob") == upper, F.col("value"))).alias("p_hi")))
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (variable, x)")
    # qw has one row per column (bounded): broadcast, never shuffle the long
    # rows on a handful of variable names.
    j = long.join(F.broadcast(qw), "variable")
    return (j.groupBy("variable")
            .agg(F.round(F.min("x"), 2).alias("original_min"),
                 F.round(F.max("x"), 2).alias("original_max"),
                 F.round(F.first("p_lo"), 2).alias("p1"),
                 F.round(F.first("p_hi"), 2).alias("p99"),
                 F.sum((F.col("x") < F.col("p_lo")).cast("bigint")).alias("n_capped_low"),
                 F.sum((F.col("x") > F.col("p_hi")).cast("bigint")).alias("n_capped_high")))


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """A5: five-number summary per group with 1.5 IQR whiskers (the
    box-plot data): q1, median, q3 (type 7), whisker ends = most extreme
    values inside the fences, and the number of points outside them."""
    by = list(by)
    x = F.col(value).cast("double")
    # A struct of the group columns is never null itself, so a null group
    # joins with its own statistics.
    group = ["_group"] if by else []
    rows = df.select(*([F.struct(*by).alias("_group")] if by else []), x.alias("_x")).filter(F.col("_x").isNotNull())
    q = quantiles(rows, ["_x"], [0.25, 0.5, 0.75], by=group)
    qw = (q.groupBy(*group)
          .agg(F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
               F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
               F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3")))
    iqr = F.col("q3") - F.col("q1")
    qw = qw.withColumn("lo_fence", F.col("q1") - F.lit(1.5) * iqr) \
           .withColumn("hi_fence", F.col("q3") + F.lit(1.5) * iqr)
    if by:
        j = rows.join(qw, group)
    else:  # one row of four numbers: literals, no join
        r = qw.first()
        j = rows.select("_x", *[F.lit(r[c]).alias(c) for c in ("q1", "median", "q3", "lo_fence", "hi_fence")])
    inside = (F.col("_x") >= F.col("lo_fence")) & (F.col("_x") <= F.col("hi_fence"))
    out = (j.groupBy(*group)
            .agg(F.count(F.lit(1)).alias("n"),
                 F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
                 F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
                 F.sum((~inside).cast("bigint")).alias("n_outliers")))
    stats = [c for c in out.columns if c not in group]
    return out.select(*[F.col("_group")[c].alias(c) for c in by], *stats)
