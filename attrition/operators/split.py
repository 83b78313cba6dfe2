"""Exact stratified split, stratified folds and class weights.

Rows are ordered inside each class by ``md5(id:seed)`` (then id).  The
position of a row in that order is computed with ``bucketed_running`` on
the first hash characters, so the majority class (a third of the data or
more) is numbered by thousands of tasks, not one.  The split is exact:
the training part of class c has ``ceil(p * n_c)`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.exprs import md5_key
from attrition.operators.ordering import bucketed_running, hash_prefix_bucket

SEED = 123


def class_positions(df: DataFrame, label: str = "target", id_col: str = "id",
                    seed: int | str = SEED, digits: int = 3) -> DataFrame:
    """Add ``_pos`` (1-based position in the hashed order within the class)
    and ``_n_class``."""
    h = md5_key(F.col(id_col), F.lit(":"), F.lit(str(seed)))
    d = df.withColumn("_h", h)
    d = bucketed_running(d, [label], hash_prefix_bucket(F.col("_h"), digits), ["_h", id_col],
                         row_number="_pos", key_count="_n_class")
    return d.drop("_h")


def stratified_split(df: DataFrame, label: str = "target", id_col: str = "id", p: float = 0.8,
                     seed: int | str = SEED, out: str = "is_train") -> DataFrame:
    """``out`` is true for the first ``ceil(p * n_c)`` rows of each class."""
    d = class_positions(df, label, id_col, seed)
    return d.withColumn(out, F.col("_pos") <= F.ceil(F.col("_n_class") * F.lit(float(p)))) \
            .drop("_pos", "_n_class")


def stratified_folds(df: DataFrame, label: str = "target", id_col: str = "id", k: int = 5,
                     seed: int | str = SEED, out: str = "fold") -> DataFrame:
    """Balanced folds 1..k within each class: ``(position - 1) mod k + 1``."""
    d = class_positions(df, label, id_col, f"{seed}:folds")
    return d.withColumn(out, ((F.col("_pos") - 1) % k + 1).cast("int")).drop("_pos", "_n_class")


def class_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """``(class, n, weight)`` with weight = N / (K * n_c)."""
    c = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window
    w = Window.partitionBy()
    return c.withColumn("weight", F.sum("n").over(w).cast("double")
                        / (F.count(F.lit(1)).over(w).cast("double") * F.col("n").cast("double")))


def attach_weights(df: DataFrame, weights: DataFrame, label: str = "target",
                   out: str = "weight") -> DataFrame:
    """Map each row's class to its weight.  ``weights`` has one row per
    class (bounded by the class count), so it is broadcast."""
    w = weights.select(F.col("class").alias("_wc"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), F.col(label).eqNullSafe(F.col("_wc")), "left").drop("_wc")


def complement(df: DataFrame, flag: str = "is_train") -> DataFrame:
    """The rows outside the training part (from the split flag, one pass;
    equivalent to a left-anti join on the key)."""
    return df.filter(~F.col(flag))
