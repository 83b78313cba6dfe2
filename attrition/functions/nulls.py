"""R-style null semantics as Spark Column expressions.

Spark's three-valued logic differs from the R verbs the analysis is written
in; each helper states the R behaviour it reproduces.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else_null(cond: Column, a, b) -> Column:
    """R ``ifelse(cond, a, b)``: a null condition gives null (Spark's
    ``when(c, a).otherwise(b)`` would give ``b``)."""
    return F.when(cond, a).when(~cond, b)


def in_set(col: Column, values: Iterable) -> Column:
    """R ``x %in% set``: null x is FALSE, never null."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_in(col: Column, values: Iterable) -> Column:
    """R ``!(x %in% set)``: null x is TRUE, so the row is kept by a filter
    (SQL ``NOT IN`` would drop it)."""
    return ~in_set(col, values)


def pmin(*cols: Column) -> Column:
    """R ``pmin``: null if any input is null (``least`` skips nulls)."""
    any_null = _any_null(cols)
    return F.when(~any_null, F.least(*cols))


def pmax(*cols: Column) -> Column:
    """R ``pmax``: null if any input is null (``greatest`` skips nulls)."""
    any_null = _any_null(cols)
    return F.when(~any_null, F.greatest(*cols))


def count_equal(cols: Iterable[Column], value) -> Column:
    """R ``rowSums(df == value, na.rm = TRUE)``: a null cell counts 0."""
    terms = [F.when(c == F.lit(value), F.lit(1)).otherwise(F.lit(0)) for c in cols]
    if not terms:
        return F.lit(0)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _any_null(cols) -> Column:
    flag = F.lit(False)
    for c in cols:
        flag = flag | c.isNull()
    return flag
