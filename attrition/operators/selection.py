"""Feature selection (L1-L4): cardinality guard, forest importance,
cumulative-share selection, top-k importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attrition.operators.forest import forest_gains

MAX_LEVELS = 53
#: A sketch tells a number of levels beyond this share of the bound apart from the bound (its error is 1.6 %).
NEAR = 0.1


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, n_levels)``: distinct values per column, null counted as
    one level (R ``length(unique(x))``).  Distinct (feature, value) pairs are
    combined map-side before the shuffle, so the job is cheap whatever
    the row count."""
    cols = list(cols)
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (feature, level)")
    return (long.distinct().groupBy("feature").agg(F.count(F.lit(1)).cast("bigint").alias("n_levels")))


def cardinality_guard(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """L1: categorical columns and whether they exceed ``max_levels``."""
    return level_counts(df, cols).withColumn("too_many_levels", F.col("n_levels") > max_levels)


def within_levels(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS,
                  parts: Sequence[Column] = ()) -> list[list[str]]:
    """The columns that have at most ``max_levels`` levels (null is one) in
    each part of the rows (conditions; none: all rows).  Levels are counted by
    sketches, a few kilobytes for each task and column however many
    levels there are; only where a sketch comes near the bound are the
    levels themselves gathered, which are few there.  No rows: every column."""
    conditions = list(parts) or [F.lit(True)]
    level = {c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")) for c in cols}

    def counts(pairs: list[tuple[int | None, str]], exact: bool) -> dict[tuple[int | None, str], int]:
        if not pairs:
            return {}
        values = [level[c] if k is None else F.when(conditions[k], level[c]) for k, c in pairs]
        row = df.agg(*[(F.size(F.collect_set(v)) if exact else F.hll_sketch_estimate(F.hll_sketch_agg(v, F.lit(12)))).alias(f"n{i}")
                       for i, v in enumerate(values)]).first()
        return dict(zip(pairs, row))

    low, high = max_levels * (1 - NEAR), max_levels * (1 + NEAR)
    wide = [c for (_, c), n in counts([(None, c) for c in cols], False).items() if n > low]
    found = counts([(k, c) for k in range(len(conditions)) for c in wide], False)
    found |= counts([pair for pair, n in found.items() if low < n < high], True)
    return [[c for c in cols if found.get((k, c), 0) <= max_levels] for k in range(len(conditions))]


def forest_importance(train: DataFrame, label: str, features: Sequence[str],
                      categorical: Sequence[str] = (), *, num_trees: int = 100, min_leaf: int = 50,
                      max_leaves: int = 50, seed: int = 123, id_col: str | None = None) -> DataFrame:
    """L2: mean decrease of Gini impurity per original column over a forest
    of 100 trees with at most 50 leaves of at least 50 rows, all classes
    weighing the same (:mod:`attrition.operators.forest`).  Bootstrap draws go
    by the hash of ``id_col`` (None: of the whole row)."""
    gains, _ = forest_gains(train, label, features, categorical, num_trees=num_trees, min_leaf=min_leaf,
                            max_leaves=max_leaves, seed=seed, id_col=id_col)
    return train.sparkSession.createDataFrame(list(gains.items()), "feature string, importance double")


def cumulative_select(importance: DataFrame, share: float = 0.95, score: str = "importance",
                      name: str = "feature") -> DataFrame:
    """Features by importance (ties by name), keeping the shortest
    prefix whose cumulative share reaches ``share``.  The table has one row
    per feature, so the global window is over metadata-sized data."""
    w = Window.orderBy(F.desc(score), F.asc(name))
    total = F.sum(score).over(Window.partitionBy())
    cum = F.sum(score).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # An all-zero score table has no shares (null); every feature is kept.
    d = importance.select(name, score, F.row_number().over(w).cast("bigint").alias("rank"),
                          F.when(total > 0, cum / total).alias("cumulative_share"))
    prev = F.lag("cumulative_share", 1, 0.0).over(Window.orderBy("rank"))
    return d.withColumn("_prev", prev).filter(F.coalesce(F.col("_prev") < share, F.lit(True))).drop("_prev")


def top_importance(importance: DataFrame, n: int = 20, score: str = "importance",
                   name: str = "feature") -> DataFrame:
    """The ``n`` most important features (a top-k report)."""
    return importance.orderBy(F.desc(score), F.asc(name)).limit(n)
