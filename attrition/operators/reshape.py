"""Set operations, reshaping and ordered reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Append result rows by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def wide_to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 name: str = "variable", value: str = "value") -> DataFrame:
    """Columns -> (name, value) rows (``DataFrame.unpivot``)."""
    return df.unpivot(list(ids), list(values), name, value)


def long_to_wide(df: DataFrame, row: str, col: str, value: str, levels: Sequence[str],
                 fill=0) -> DataFrame:
    """(row, col, value) -> one column per given level (pivot with the
    values listed, so Spark skips the distinct-values pass)."""
    p = df.groupBy(row).pivot(col, list(levels)).agg(F.first(value))
    return p.fillna(fill, subset=list(levels)) if fill is not None else p


def topk_global(df: DataFrame, k: int, order: Sequence) -> DataFrame:
    """``orderBy(...).limit(k)``: Spark plans it as a per-partition
    top-k followed by a merge (TakeOrderedAndProject), never a full sort."""
    return df.orderBy(*order).limit(k)


def rank_first(df: DataFrame, metric: str, out: str = "rank", descending: bool = True,
               tiebreak: str | None = None) -> DataFrame:
    """Rank with ties broken by position (R ``rank(-x, ties="first")``);
    for small result tables (one row per alpha, class, ...)."""
    o = [F.desc(metric) if descending else F.asc(metric)]
    if tiebreak:
        o.append(F.asc(tiebreak))
    return df.withColumn(out, F.row_number().over(Window.orderBy(*o)).cast("bigint"))


def running_share(df: DataFrame, value: str, order: Sequence, out: str = "cumulative_share") -> DataFrame:
    """Cumulative sum / total along ``order`` for a small table."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w) / F.sum(value).over(Window.partitionBy()))


def reorder_levels(df: DataFrame, stat: str, descending: bool = True, name: str | None = None) -> DataFrame:
    """Order categories by a statistic (ties by name)."""
    o = [F.desc(stat) if descending else F.asc(stat)]
    if name:
        o.append(F.asc(name))
    return df.orderBy(*o)
