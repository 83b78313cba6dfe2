"""Exact sample quantiles (R type 7 / SQL ``quantile_cont``) at scale.

Spark's exact ``percentile`` keeps a value->count map of every distinct
value of a group in one task; at 100 TB that map does not fit.  Here:

1. one aggregation per (group, variable): ``count`` and ``percentile_approx``
   at p -/+ a margin, which brackets the needed ranks (rank error <= n/accuracy);
2. one join of the rows with that small table: rows below the bracket are
   only counted, rows inside it are grouped by value (about 4n/accuracy);
3. a window over those few candidate values finds the values at ranks
   floor((n-1)p) and ceil((n-1)p) and interpolates ``lo + (hi-lo)*frac``
   (type 7; may differ from other engines in the last bit, so reports round).

A bracket that misses its ranks (not expected, the sketch bound holds) is
recomputed with the exact ``percentile`` for that group only, so the
result is always exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.operators.ordering import bucketed_running


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    keep = ", ".join(f"`{b}`" for b in by)
    expr = f"stack({len(cols)}, {pairs}) AS (variable, x)"
    out = df.selectExpr(*( [keep] if keep else []), expr)
    return out.filter(F.col("x").isNotNull())


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              by: Sequence[str] = (), accuracy: int = 20000) -> DataFrame:
    """Long ``(*by, variable, prob, value)``: type-7 quantiles of each
    column (nulls removed) at each probability, exactly."""
    by = list(by)
    probs = [float(p) for p in probs]
    margin = 3.0 / accuracy
    long = _long(df, cols, by)
    brackets = []
    for p in probs:
        brackets += [max(0.0, p - margin), min(1.0, p + margin)]

    stats = (long.groupBy(*by, "variable")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.percentile_approx("x", F.array(*[F.lit(b) for b in brackets]), accuracy).alias("br"))
             .select(*by, "variable", "n", "br",
                     F.posexplode(F.array(*[F.lit(p) for p in probs])).alias("pi", "prob")))
    stats = stats.select(
        *by, "variable", "n", "prob",
        F.element_at("br", (F.col("pi") * 2 + 1).cast("int")).alias("lo_b"),
        F.element_at("br", (F.col("pi") * 2 + 2).cast("int")).alias("hi_b"))
    pos = (F.col("n") - 1).cast("double") * F.col("prob")
    stats = (stats.withColumn("pos", pos)
             .withColumn("r_lo", F.floor("pos").cast("bigint"))
             .withColumn("r_hi", F.ceil("pos").cast("bigint")))

    # Without groups the stats table is cols x probs rows: broadcast it so
    # the rows are not shuffled onto a few variable names.  With groups AQE
    # picks broadcast or a skew-split sort-merge join from measured sizes.
    j = long.join(F.broadcast(stats) if not by else stats, [*by, "variable"])
    below = (j.groupBy(*by, "variable", "prob")
             .agg(F.sum((F.col("x") < F.col("lo_b")).cast("bigint")).alias("below"),
                  F.sum(((F.col("x") >= F.col("lo_b")) & (F.col("x") <= F.col("hi_b"))).cast("bigint"))
                  .alias("inside")))
    cand = (j.filter((F.col("x") >= F.col("lo_b")) & (F.col("x") <= F.col("hi_b")))
            .groupBy(*by, "variable", "prob", "x").agg(F.count(F.lit(1)).alias("c")))
    # Running count over the candidate values, split into equal-width
    # sub-ranges of the bracket so a wide bracket is not one window task.
    span = F.col("hi_b") - F.col("lo_b")
    sub = F.when(span > 0, F.least(F.floor((F.col("x") - F.col("lo_b")) / span * F.lit(1024)), F.lit(1023))) \
        .otherwise(F.lit(0)).cast("int")
    cand = (cand.join(stats.select(*by, "variable", "prob", "lo_b", "hi_b"), [*by, "variable", "prob"])
            .withColumn("_sub", sub))
    cand = bucketed_running(cand, [*by, "variable", "prob"], F.col("_sub"), ["x"],
                            sums={"cum_in": F.col("c")}).drop("_sub", "lo_b", "hi_b")
    cand = cand.join(below, [*by, "variable", "prob"]).join(
        stats.select(*by, "variable", "prob", "pos", "r_lo", "r_hi"), [*by, "variable", "prob"])
    cum = F.col("below") + F.col("cum_in")  # rows <= x
    picked = (cand.groupBy(*by, "variable", "prob")
              .agg(F.min(F.when(cum > F.col("r_lo"), F.col("x"))).alias("v_lo"),
                   F.min(F.when(cum > F.col("r_hi"), F.col("x"))).alias("v_hi"),
                   F.first("pos").alias("pos"), F.first("r_lo").alias("r_lo"),
                   F.first("below").alias("below"), F.first("inside").alias("inside"),
                   F.first("r_hi").alias("r_hi")))
    ok = (F.col("below") <= F.col("r_lo")) & (F.col("below") + F.col("inside") > F.col("r_hi"))
    frac = F.col("pos") - F.col("r_lo").cast("double")
    # picked has one row per (group, variable, prob): compute it once.
    picked = _small(picked.withColumn("_ok", ok).withColumn(
        "value", F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * frac))
    good = picked.filter("_ok").select(*by, "variable", "prob", "value")
    missed = picked.filter(~F.col("_ok")).select(*by, "variable", "prob")
    if missed.isEmpty():
        return good
    # Exact fallback, only for groups whose bracket missed (not expected).
    exact = (long.join(missed.select(*by, "variable").distinct(), [*by, "variable"], "left_semi")
             .groupBy(*by, "variable")
             .agg(F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("qs"))
             .select(*by, "variable", F.posexplode("qs").alias("pi", "value"))
             .withColumn("prob", F.element_at(F.array(*[F.lit(p) for p in probs]),
                                              (F.col("pi") + 1).cast("int"))))
    fb = exact.join(missed, [*by, "variable", "prob"], "left_semi").select(*by, "variable", "prob", "value")
    return good.unionByName(fb)


def _small(df: DataFrame) -> DataFrame:
    """Keep the statistics table (one row per group x variable x prob)
    persisted, so the result and the fallback check do not recompute the
    quantile jobs; recomputed from lineage if an executor is lost."""
    df = df.persist()
    df.count()
    return df


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                 accuracy: int = 20000) -> dict[tuple[str, float], float]:
    """``{(column, prob): value}``; metadata-sized (cols x probs), collected."""
    rows = quantiles(df, cols, probs, accuracy=accuracy).collect()
    return {(r["variable"], float(r["prob"])): r["value"] for r in rows}
