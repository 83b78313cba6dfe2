"""CSV scan with several null tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The null tokens of the analysis' CSV reader.
NULL_TOKENS = ("", "NA", " ", "NULL")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             null_tokens: Iterable[str] = NULL_TOKENS, header: bool = True, snake_case: bool = False) -> DataFrame:
    """Read CSV with a header; every cell equal to one of ``null_tokens``
    becomes null.  Spark's ``nullValue`` takes one token, so all columns
    are read as strings, tokens are nulled, then cast to ``schema`` (or to
    inferred numeric types by :func:`infer_numeric`).  ``snake_case`` turns
    headers such as "Online Security" into ``online_security``."""
    tokens = list(null_tokens)
    raw = (spark.read.option("header", header).option("inferSchema", False)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .option("nullValue", "\u0000never\u0000").option("emptyValue", "")
           .csv(path))
    # CRLF files leave a trailing '\r' on the last header name.
    names = [c.rstrip("\r") for c in raw.columns]
    raw = raw.toDF(*([snake_name(c) for c in names] if snake_case else names))
    cells = [F.col(f"`{c}`") for c in raw.columns]
    df = raw.select(*[F.when(~v.isin(tokens), v).alias(c) for v, c in zip(cells, raw.columns)])
    if schema is not None:
        return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
    return df


def snake_name(name: str) -> str:
    """Lower case, every run of other characters than letters and digits one
    underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def infer_numeric(df: DataFrame) -> DataFrame:
    """Cast string columns whose every non-null value parses as a number
    (one aggregation pass over all columns)."""
    checks = [F.min(F.when(F.col(f"`{c}`").isNull(), F.lit(1))
                    .otherwise(F.col(f"`{c}`").try_cast("double").isNotNull().cast("int"))).alias(c)
              for c in df.columns]
    ints = [F.min(F.when(F.col(f"`{c}`").isNull(), F.lit(1))
                  .otherwise(F.col(f"`{c}`").rlike(r"^-?[0-9]+$").cast("int"))).alias(c)
            for c in df.columns]
    row = df.agg(F.struct(*checks).alias("num"), F.struct(*ints).alias("int")).first()
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if row["int"][c] == 1 and row["num"][c] == 1:
            out.append(col.cast("long").alias(c))
        elif row["num"][c] == 1:
            out.append(col.cast("double").alias(c))
        else:
            out.append(col)
    return df.select(*out)
