"""Descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def share_of_total(counts: DataFrame, count_col: str = "count", out: str = "percentage",
                   within: Sequence[str] = ()) -> DataFrame:
    """Percent of ``count_col`` over all rows of an *aggregated* table
    (or within ``within`` groups).  The window runs over group rows only."""
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    return counts.withColumn(out, F.col(count_col).cast("double") * F.lit(100.0)
                             / F.sum(count_col).over(w).cast("double"))


def class_distribution(df: DataFrame, label: str = "target") -> DataFrame:
    """A1: count and percent per class."""
    c = df.groupBy(F.col(label).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return share_of_total(c)


def cohort_stats(df: DataFrame, tenure: str = "tenure", charge: str = "charge") -> DataFrame:
    """A2: size, mean tenure, mean monthly charge (nulls skipped)."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg(F.col(tenure).cast("double")).alias("avg_tenure"),
                  F.avg(F.col(charge)).alias("avg_charge"))


def conditional_counts(df: DataFrame, phone: str, lines: str) -> DataFrame:
    """A3: phone & lines Yes, phone Yes & lines No, no phone (nulls not counted)."""
    p, m = F.col(phone), F.col(lines)
    return df.agg(F.count_if((p == "Yes") & (m == "Yes")).alias("phone_yes_lines_yes"),
                  F.count_if((p == "Yes") & (m == "No")).alias("phone_yes_lines_no"),
                  F.count_if(p == "No").alias("phone_no"))


def category_bar(df: DataFrame, label: str = "target") -> DataFrame:
    """A4: category counts, largest first (bar-chart data)."""
    return (df.groupBy(F.col(label).alias("category")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "category"))


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 8) -> DataFrame:
    """Pearson correlation of every ordered pair of columns on rows with
    no null in any of them (R ``use="complete.obs"``), long form, one
    aggregation for all pairs.  Diagonal is exactly 1; a constant column
    gives null (R's NA) instead of a division by zero."""
    cols = list(cols)
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    sds = [F.stddev_samp(f"c{i}") for i in range(len(cols))]
    aggs = [F.when((sds[i] > 0) & (sds[j] > 0),
                   F.covar_samp(f"c{i}", f"c{j}") / (sds[i] * sds[j])).alias(f"r{i}_{j}")
            for i in range(len(cols)) for j in range(i + 1, len(cols))]
    wide = d.agg(*aggs) if aggs else d.agg(F.count(F.lit(1)).alias("_n"))
    entries = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                v = F.lit(1.0)
            else:
                v = F.round(F.col(f"r{min(i, j)}_{max(i, j)}"), digits)
            entries.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), v.alias("r")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def high_corr_pairs(corr: DataFrame, lo: float = 0.8, hi: float = 1.0) -> DataFrame:
    """Pairs with lo < |r| < hi; both orders are listed, as in the matrix."""
    return corr.filter((F.abs("r") > lo) & (F.abs("r") < hi))


def score_histogram(df: DataFrame, score: str, by: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """Equal-width histogram of ``score`` over its full range with
    ``bins`` bins centred on the minimum (the plotting default: width =
    range / (bins - 1)), counts per bin and group."""
    mn = df.agg(F.min(score)).scalar()
    mx = df.agg(F.max(score)).scalar()
    width = (mx - mn) / F.lit(float(bins - 1))
    idx = F.when(width > 0, F.floor((F.col(score) - mn) / width + F.lit(0.5))).otherwise(F.lit(0))
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(score).isNotNull())
            .groupBy(*by, idx.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("bin_center", F.round(mn + F.col("bin") * width, 10)))


def score_trend(df: DataFrame, x: str, score: str, digits: int = 10) -> DataFrame:
    """Mean score per x value (replaces the scatter smoother)."""
    return (df.groupBy(F.col(x).alias(x))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), digits).alias("avg_score")))
