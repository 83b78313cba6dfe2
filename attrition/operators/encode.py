"""Categorical encoding, design matrix, scaling.

The fitted state of a design is small: the level list of each categorical
feature (bounded by the cardinality guard, L1) and the mean / sd of each
design column.  It is learned with one aggregation each and applied as
plain Column expressions, so scoring is a narrow projection.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted non-null levels of each column from one distinct-pairs job
    (map-side partial aggregation, then a bounded collect)."""
    cols = list(cols)
    if not cols:
        return {}
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in cols)
    long = df.selectExpr(f"stack({len(cols)}, {pairs}) AS (variable, level)").filter("level IS NOT NULL")
    rows = long.groupBy("variable").agg(F.sort_array(F.collect_set("level")).alias("levels")).collect()
    found = {r["variable"]: list(r["levels"]) for r in rows}
    return {c: found.get(c, []) for c in cols}


def encode_levels(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Categorical codes in alphabetical level order (0-based), null
    stays null; a fitted ``StringIndexer`` with ``alphabetAsc``."""
    out = out or f"{col}_code"
    idx = StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc",
                        handleInvalid="keep").fit(df)
    return idx.transform(df).withColumn(out, F.when(F.col(col).isNotNull(), F.col(out).cast("int")))


@dataclass
class Design:
    """A fitted main-effects design (R ``model.matrix(~ a + b - 1)``).

    ``features`` in formula order; ``levels[c]`` for categorical ones.  The
    first categorical feature keeps a column for every level, later ones
    drop their first (alphabetical) level.  ``means``/``sds`` are the
    training statistics of the design columns (L6)."""
    features: list[str]
    levels: dict[str, list[str]]
    columns: list[tuple[str, str, str | None]] = field(default_factory=list)  # (name, feature, level)
    means: dict[str, float] = field(default_factory=dict)
    sds: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [c[0] for c in self.columns]

    def expr(self, name: str) -> Column:
        _, feat, level = next(c for c in self.columns if c[0] == name)
        x = F.col(f"`{feat}`")
        if level is None:
            return x.cast("double")
        return F.when(x == F.lit(level), F.lit(1.0)).otherwise(F.lit(0.0))

    def raw_columns(self) -> list[Column]:
        return [self.expr(n).alias(n) for n in self.names]

    def scaled_columns(self) -> list[Column]:
        """(x - mean) / sd with training statistics; sd 0 (or unknown)
        leaves the column unscaled, as the reference does."""
        out = []
        for n in self.names:
            e, m, s = self.expr(n), self.means.get(n), self.sds.get(n)
            out.append((((e - F.lit(m)) / F.lit(s)) if (s is not None and s > 0) else e).alias(n))
        return out

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "levels": self.levels,
                           "columns": self.columns, "means": self.means, "sds": self.sds})

    @staticmethod
    def from_json(s: str) -> "Design":
        d = json.loads(s)
        return Design(d["features"], d["levels"], [tuple(c) for c in d["columns"]], d["means"], d["sds"])


def fit_design(train: DataFrame, features: Sequence[str], categorical: Sequence[str] | None = None,
               scale: bool = True) -> Design:
    """L5 + L6 fit: levels from the training rows, first-factor rule,
    then one aggregation for every column's mean and sample sd."""
    features = list(features)
    if categorical is None:
        categorical = [f for f in features if dict(train.dtypes)[f] == "string"]
    categorical = [f for f in features if f in set(categorical)]
    levels = fit_levels(train, categorical)
    cols: list[tuple[str, str, str | None]] = []
    first_factor = True
    for f in features:
        if f in levels:
            lv = levels[f] if first_factor else levels[f][1:]
            first_factor = False
            cols += [(f"{f}{lv_}", f, lv_) for lv_ in lv]
        else:
            cols.append((f, f, None))
    design = Design(features, levels, cols)
    if scale:
        design.means, design.sds = column_stats(train.select(*design.raw_columns()), design.names)
    return design


def column_stats(df: DataFrame, cols: Sequence[str]) -> tuple[dict, dict]:
    """Means and sample sds of many columns in ONE aggregation."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(f"`{c}`").alias(f"m{i}"), F.stddev_samp(f"`{c}`").alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return ({c: r[f"m{i}"] for i, c in enumerate(cols)}, {c: r[f"s{i}"] for i, c in enumerate(cols)})


def scaling_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long ``(feature, mean, sd)`` of the given (design) columns, from
    one aggregation."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"),
                 F.stddev_samp(F.col(f"`{c}`").cast("double")).alias(f"s{i}")]
    wide = df.agg(*aggs)
    entries = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd"))
               for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def design_long(df: DataFrame, design: Design, id_col: str = "id", scaled: bool = False) -> DataFrame:
    """Sparse long form ``(id, design_column, value)`` of the non-zero cells
    (what a SparseVector stores); unseen levels give no cell (all zeros)."""
    cols = design.scaled_columns() if scaled else design.raw_columns()
    entries = F.array(*[F.struct(F.lit(n).alias("design_column"), c.alias("value"))
                        for n, c in zip(design.names, cols)])
    return (df.select(F.col(id_col).alias(id_col), F.explode(entries).alias("e"))
            .select(id_col, "e.design_column", "e.value")
            .filter(F.col("value").isNotNull() & (F.col("value") != 0)))


def assemble(df: DataFrame, design: Design, keep: Sequence[str] = (), scaled: bool = True,
             out: str = "features", invalid: str = "skip") -> DataFrame:
    """Design vector column for Spark ML.  Rows with a null design value are
    left out (``skip``), stay with NaN in the vector (``keep``), or stop the
    job (``error``)."""
    cols = design.scaled_columns() if scaled else design.raw_columns()
    names = [f"__x{i}" for i in range(len(cols))]
    wide = df.select(*keep, *[c.cast("double").alias(n) for c, n in zip(cols, names)])
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid=invalid).transform(wide) \
        .select(*keep, out)


def align_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Add design columns missing from ``df`` as 0 and put them in
    training order."""
    have = set(df.columns)
    return df.select(*keep, *[(F.col(f"`{c}`") if c in have else F.lit(0.0)).alias(c) for c in columns])


def prob_columns(df: DataFrame, classes: Sequence[str], probs: str = "probability",
                 keep: Sequence[str] = ()) -> DataFrame:
    """A probability vector (or array) -> one ``Prob_<class>`` column
    per class, in class-index order."""
    arr = F.col(probs)
    if dict(df.dtypes).get(probs, "").startswith("vector") or dict(df.dtypes).get(probs) == "vector":
        arr = vector_to_array(arr)
    return df.select(*keep, *[arr[i].alias(f"Prob_{c}") for i, c in enumerate(classes)])
