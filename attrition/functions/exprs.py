"""Scalar helpers: bins, deterministic hash keys, Yes/No flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "0123456789abcdef"


def cut_right_closed(x: Column, breaks: Sequence[float], labels: Sequence[str],
                     include_lowest: bool = True) -> Column:
    """R ``cut(x, breaks, labels, include.lowest=TRUE)``: bins are
    ``(b[i], b[i+1]]``, the first also closed on the left; values outside
    the breaks (and null) give null.  ``Bucketizer`` is left-closed, so
    this is a ``CASE WHEN`` chain instead."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per bin")
    expr = None
    for i, label in enumerate(labels):
        lo, hi = breaks[i], breaks[i + 1]
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        if i == 0 and include_lowest:
            cond = (x >= F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def md5_key(*parts) -> Column:
    """md5 hex of the parts joined as strings; identical in Spark and DuckDB
    (``md5(cast(k as string) || ':' || seed)``)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat(*[c.cast("string") for c in cols]))


def hex_digits_value(hex_col: Column, start: int, n: int) -> Column:
    """Integer value of ``n`` hex digits starting at 1-based ``start``.
    Built from ``instr`` so that the SQL twin is portable (no ``conv``)."""
    total = F.lit(0).cast("bigint")
    for k in range(n):
        digit = F.instr(F.lit(_HEX), F.substring(hex_col, start + k, 1)) - F.lit(1)
        total = total * F.lit(16) + digit.cast("bigint")
    return total


def yes_no(cond: Column) -> Column:
    """Boolean to the "Yes"/"No" strings the analysis uses (null stays null)."""
    return F.when(cond, F.lit("Yes")).when(~cond, F.lit("No"))
