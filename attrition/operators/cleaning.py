"""Missing-value profiling and rule-based fills (M1-M3, M8, P5-P10)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.nulls import if_else_null

# The services whose null means "no internet service".
# (column names normalised to snake_case at load)
INTERNET_COLS = ("internet_type", "online_security", "online_backup", "device_protection_plan",
                 "premium_tech_support", "streaming_tv", "streaming_movies",
                 "streaming_music", "unlimited_data")
NO_INTERNET = "No Internet Service"


def _q(c: str) -> str:
    return f"`{c}`"


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long ``(variable, missing_count, total_count)`` from ONE aggregation
    over all columns (not one pass per column)."""
    cols = list(cols or df.columns)
    aggs = [F.sum(F.col(_q(c)).isNull().cast("bigint")).alias(f"m{i}") for i, c in enumerate(cols)]
    wide = df.agg(F.count(F.lit(1)).alias("total_count"), *aggs)
    # stack() keeps the column names as data; values are all bigint.
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(cols))
    return wide.selectExpr("total_count", f"stack({len(cols)}, {pairs}) AS (variable, missing_count)") \
        .select("variable", F.coalesce("missing_count", F.lit(0)).cast("bigint").alias("missing_count"),
                F.col("total_count").cast("bigint").alias("total_count"))


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """M1: columns with at least one null, with count, total and percent,
    most missing first."""
    m = missing_by_variable(df, cols)
    return m.filter(F.col("missing_count") > 0).orderBy(F.desc("missing_percentage"), "variable")


def missing_by_variable(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """M2: percent null of every column."""
    return null_counts(df, cols).withColumn(
        "missing_percentage",
        F.col("missing_count").cast("double") * F.lit(100.0) / F.col("total_count").cast("double"))


def missing_pattern(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """M3: row-level null patterns (one bit per column, in column order) and
    how many rows share each; replaces the clustered heat-map."""
    cols = list(cols or df.columns)
    bits = F.concat(*[F.when(F.col(_q(c)).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    nnull = sum((F.col(_q(c)).isNull().cast("int") for c in cols), F.lit(0))
    return (df.select(bits.alias("pattern"), nnull.alias("n_missing"))
            .groupBy("pattern", "n_missing").agg(F.count(F.lit(1)).alias("n_rows")))


def null_total(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """M8: total null cells (one row)."""
    return null_counts(df, cols).agg(F.sum("missing_count").cast("bigint").alias("null_cells"))


def sparse_columns(df: DataFrame, threshold_pct: float = 50.0,
                   cols: Sequence[str] | None = None) -> list[str]:
    """Names of columns with more than ``threshold_pct`` percent null.
    The result has one row per column: metadata-sized, safe to collect."""
    m = missing_by_variable(df, cols).filter(F.col("missing_percentage") > threshold_pct)
    return [r["variable"] for r in m.select("variable").collect()]


def drop_sparse_columns(df: DataFrame, threshold_pct: float = 50.0) -> DataFrame:
    """P5: drop columns with more than ``threshold_pct`` percent null."""
    drop = sparse_columns(df, threshold_pct)
    return df.drop(*drop) if drop else df


def level_flags(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long ``(variable, single_level)``: a column has one level when all
    its values are equal and not mixed with nulls, or when it is all null
    (null counts as a value, R ``length(unique(x)) == 1``).  One pass of
    min/max/null-count; no distinct counting."""
    cols = list(cols or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        col = F.col(_q(c))
        aggs += [F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}"),
                 F.sum(col.isNull().cast("bigint")).alias(f"nn{i}")]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    flags = []
    for i, c in enumerate(cols):
        lo, hi, nn = F.col(f"lo{i}"), F.col(f"hi{i}"), F.col(f"nn{i}")
        single = (nn == F.col("n")) | ((nn == 0) & (lo == hi))
        flags.append(F.struct(F.lit(c).alias("variable"), F.coalesce(single, F.lit(False)).alias("single_level")))
    return wide.select(F.explode(F.array(*flags)).alias("f")).select("f.*")


def drop_single_level(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop columns that hold exactly one value (k rows collected)."""
    drop = [r["variable"] for r in level_flags(df, cols).filter("single_level").collect()]
    return df.drop(*drop) if drop else df


def conditional_fill(df: DataFrame, col: str, when_col: str, when_value, fill) -> DataFrame:
    """Null ``col`` where ``when_col == when_value`` becomes ``fill``
    (R ``ifelse(is.na(x) & t == 0, 0, x)``; a null test keeps null)."""
    if col not in df.columns:
        return df
    cond = F.col(col).isNull() & (F.col(when_col) == F.lit(when_value))
    return df.withColumn(col, if_else_null(cond, F.lit(fill).cast(df.schema[col].dataType), F.col(col)))


def service_fill(df: DataFrame, cols: Iterable[str] = INTERNET_COLS, value: str = NO_INTERNET) -> DataFrame:
    """Nulls in the listed service columns that exist become ``value``."""
    present = [c for c in cols if c in df.columns]
    return df.fillna(value, subset=present) if present else df


def lines_to_binary(df: DataFrame, phone: str, lines: str) -> DataFrame:
    """No phone -> No; phone and Yes -> Yes; phone and No -> No;
    anything else (nulls) -> No."""
    p, m = F.col(phone), F.col(lines)
    out = (F.when(p == "No", F.lit("No"))
           .when((p == "Yes") & (m == "Yes"), F.lit("Yes"))
           .when((p == "Yes") & (m == "No"), F.lit("No"))
           .otherwise(F.lit("No")))
    return df.withColumn(lines, out)


# Contract spellings.
CONTRACT_RELABEL = {"Month-to-Month": "Month to Month", "One Year": "One Year", "Two Year": "Two Year"}


def relabel_contract(df: DataFrame, col: str = "contract",
                     mapping: dict[str, str] = CONTRACT_RELABEL) -> DataFrame:
    """P10: rename contract levels; unknown values become null (R
    ``case_when`` without a default)."""
    expr = None
    for k, v in mapping.items():
        cond = F.col(col) == k
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return df.withColumn(col, expr)
