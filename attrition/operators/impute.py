"""Chained-equation predictive mean matching (M4) and its donor step (M5).

Each round refits every incomplete column in turn.  One aggregation gives the
Gramian of all columns over the rows in which the target is known (one Gramian
per completed set, all sets in the same pass); coefficients and residual
variance follow on the driver.  As in the reference's imputation library a
round draws the coefficients and the variance from their posterior (Cholesky
factor of the covariance, normals seeded by set, round and column): rows with
a known value are predicted by the fitted coefficients, rows without by the
drawn ones, and a row takes the value of one of its ``k`` donors nearest in
prediction, chosen by a hash of its id.

String columns take part like number columns: as a target a column's level
codes (alphabetical) are predicted and the donor's level is taken; as a
predictor it is one indicator column per level but the first.  Columns with
more than ``MAX_LEVELS`` levels, or with no known value, are left out.

Matching (:mod:`attrition.operators.pmm`) takes one range exchange per step and
no join; each step's rows are written to the shared checkpoint folder, so the
next step's lineage is one table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.operators.path import _summed
from attrition.operators.pmm import hashed_pick, matched
from attrition.session import materialize, python_workers

MAX_LEVELS = 53
#: Share of a column's variance added to the Gramian's diagonal, so that
#: collinear columns have a solution.
RIDGE = 1e-5


def pmm_donor_match(scored: DataFrame, id_col: str, yhat: str, value: str, k: int = 5, seed: str = "123") -> DataFrame:
    """M5: ``(id, imputed)`` for rows with null ``value``: the observed value
    of one of the k donors nearest in ``yhat`` (ties by donor id), chosen
    by ``md5(id:seed)``.  ``scored`` has id, yhat and value (null = recipient)."""
    d = scored.select(F.col(id_col), F.col(yhat).cast("double").alias("__yhat"), F.col(value).isNotNull().alias("__donor"),
                      F.col(value).alias("__value"))
    got = matched(d, id_col, ["__value"], k, hashed_pick(id_col, seed), ["imputed"])
    return got.where("__value IS NULL").select(id_col, "imputed")


def mode_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """String nulls -> the column's most frequent level (ties by name); one
    grouped aggregation per column, a handful of values collected."""
    fills = {c: v for c, v in ((c, mode_of(df, c)) for c in cols) if v is not None}
    return df.fillna(fills) if fills else df


def mode_of(df: DataFrame, c: str):
    r = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
         .orderBy(F.desc("n"), F.asc(c)).limit(1).collect())
    return r[0][c] if r else None


def gramian(rows: DataFrame, n_sets: int, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Per set: cross-products of (1, columns, target) over the rows with a
    known target, and their number.  ``rows`` has ``set``, ``x`` and ``y``
    (null: unknown)."""
    p = n_columns + 2

    def work(batches):
        total = np.zeros((n_sets, p, p))
        for batch in batches:
            known = batch.column("y").is_valid().to_numpy(zero_copy_only=False)
            if not known.any():
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(known), n_columns)[known]
            y = batch.column("y").to_numpy(zero_copy_only=False)[known]
            s = batch.column("set").to_numpy(zero_copy_only=False)[known]
            m = np.concatenate([np.ones((len(y), 1)), x, y[:, None].astype(float)], axis=1)
            for k in range(n_sets):
                part = m[s == k]
                total[k] += part.T @ part
        return total.ravel()

    got = _summed(rows, work, n_sets * p * p).reshape(n_sets, p, p)
    return got, got[:, 0, 0]


def normals(n: int, *seed) -> np.random.Generator:
    """Generator seeded by a hash of what it is for."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, seed)).encode()).digest()[:8], "big"))


def draw(gram: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(fitted, drawn) coefficients of the last column on the others from the
    cross-products of one set: the posterior draw of Bayesian linear regression
    with a flat prior."""
    n, a, b, c = gram[0, 0], gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    # a column that is 0 in all rows has no cross-products: its coefficient stays 0
    a = a + np.diag(np.where(np.diag(a) > 0, RIDGE * np.diag(a), 1.0))
    fitted = np.linalg.solve(a, b)
    rss = max(c - 2 * fitted @ b + fitted @ gram[:-1, :-1] @ fitted, 0.0)
    sigma = np.sqrt(rss / rng.chisquare(max(n - len(fitted), 1.0)))
    root = np.linalg.cholesky(np.linalg.inv(a))
    return fitted, fitted + sigma * root @ rng.standard_normal(len(fitted))


class Plan:
    """Which columns take part and how they enter a regression."""

    def __init__(self, df: DataFrame, targets: Sequence[str], predictors: Sequence[str]):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        names = [*targets, *[p for p in predictors if p not in targets]]
        self.strings = [c for c in names if isinstance(kinds[c], T.StringType)]
        numbers = [c for c in names if c not in self.strings]
        aggs = [F.count("*").alias("_n")]
        for i, c in enumerate(numbers):
            x = F.col(f"`{c}`").cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s{i}")]
        aggs += [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(self.strings)]
        row = df.agg(*aggs).first()
        few = [c for i, c in enumerate(self.strings) if 0 < row[f"d{i}"] <= 1.2 * MAX_LEVELS]
        self.levels: dict[str, list[str]] = {c: [] for c in self.strings}
        if few:     # bounded: columns with few levels only
            found = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(f"l{i}") for i, c in enumerate(few)]).first()
            self.levels |= {c: list(found[f"l{i}"]) for i, c in enumerate(few) if len(found[f"l{i}"]) <= MAX_LEVELS}
        self.mean = {c: row[f"m{i}"] for i, c in enumerate(numbers)}
        self.sd = {c: row[f"s{i}"] or 1.0 for i, c in enumerate(numbers)}
        usable = [c for c in names if (self.levels.get(c) if c in self.strings else self.mean[c] is not None)]
        self.targets = [c for c in targets if c in usable]
        self.predictors = [c for c in usable if c not in targets]
        self.start = {c: mode_of(df, c) if c in self.strings else self.mean[c] for c in usable}

    def enter(self, c: str) -> list[Column]:
        """A column as predictor: scaled, or an indicator for each level but the first."""
        if c in self.strings:
            return [F.when(F.col(f"`{c}`") == v, 1.0).otherwise(0.0) for v in self.levels[c][1:]]
        return [(F.col(f"`{c}`") - F.lit(self.mean[c])) / F.lit(self.sd[c])]

    def code(self, c: str) -> Column:
        """A column as target: its value, scaled, or its level's number."""
        if c in self.strings:
            return (F.array_position(F.array(*[F.lit(v) for v in self.levels[c]]), F.col(f"`{c}`")) - 1).cast("double")
        return self.enter(c)[0]


def impute_sets(df: DataFrame, id_col: str, targets: Sequence[str], predictors: Sequence[str], *, m: int = 5, k: int = 5,
                max_iter: int = 5, seed: str = "123") -> DataFrame:
    """M4: ``m`` completed sets, long: ``set`` (0-based), the id, predictors
    and targets.  All sets are drawn in the same passes.  A null predictor
    counts as its column's mean or most frequent level; so does a null target
    until its first round."""
    plan = Plan(df, targets, predictors)
    python_workers(df.sparkSession)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [*plan.predictors, *plan.targets]
    miss = {t: f"__miss_{i}" for i, t in enumerate(plan.targets)}

    def start(c: str) -> Column:
        x = F.col(f"`{c}`") if c in plan.strings else F.col(f"`{c}`").cast("double")
        return F.coalesce(x, F.lit(plan.start[c])).alias(c)

    every = df.select(F.col(id_col), *[F.col(f"`{t}`").isNull().alias(x) for t, x in miss.items()], *[start(c) for c in names])
    gaps = F.array_contains(F.array(F.lit(False), *[F.col(x) for x in miss.values()]), True)
    # rows without a gap are the same in all sets and rounds: they are kept once, and only lend their values
    whole = materialize(every.where(~gaps).select(id_col, *names), "impute-whole")
    cur = every.where(gaps).select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("set"), "*")
    cur = materialize(cur, "impute")
    entries = {c: plan.enter(c) for c in names}
    codes = [t for t in plan.targets if t in plan.strings]
    columns = [e for c in names for e in entries[c]] + [plan.code(t) for t in codes]
    whole_gram = gramian(whole.select(F.lit(0).alias("set"), F.array(*columns).cast("array<double>").alias("x"), F.lit(0.0).alias("y")),
                         1, len(columns))[0][0] if plan.targets and max_iter else None
    places, at = {}, 1
    for c in names:
        places[c] = list(range(at, at + len(entries[c])))
        at += len(entries[c])
    code_at = {t: at + i for i, t in enumerate(codes)}

    def predicted(xs: Sequence[Column], coefficients: Sequence[Column]) -> Column:
        total = F.lit(0.0) + F.lit(1.0) * coefficients[0]
        for x, b in zip(xs, coefficients[1:]):
            total = total + x * b
        return total

    # a target without a gap has nothing to draw; every draw has a seed of its own, so the others stay as they are
    some = cur.agg(F.lit(0), *[F.max(F.col(x)) for x in miss.values()]).first()[1:]
    drawn_for = [t for t, gap in zip(plan.targets, some) if gap]
    for turn in range(1, max_iter + 1):
        for t in drawn_for:
            xs = [e for c in names if c != t for e in entries[c]]
            x = F.array(*xs).alias("x") if xs else F.array().cast("array<double>").alias("x")
            known = ~F.col(miss[t])
            own = [0, *[i for c in names if c != t for i in places[c]], code_at.get(t, places[t][0] if places[t] else 0)]
            gram = gramian(cur.select("set", x, F.when(known, plan.code(t)).alias("y")), m, len(xs))[0] + whole_gram[np.ix_(own, own)]
            both = [draw(gram[s], normals(0, seed, s, turn, t)) for s in range(m)]      # m small vectors

            def of_set(values: Sequence[float]) -> Column:
                return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("set") + 1) if m > 1 else F.lit(float(values[0]))

            fitted, drawn = ([of_set([b[which][j] for b in both]) for j in range(len(xs) + 1)] for which in (0, 1))
            yhat = predicted(xs, [F.when(known, f).otherwise(d) for f, d in zip(fitted, drawn)])
            scored = cur.select("*", yhat.alias("__yhat"), known.alias("__donor"))
            lends = [predicted(xs, [F.lit(float(v)) for v in b[0]]) for b in both]
            lent = whole.select(id_col, t, *([F.lit(0).alias("set"), lends[0].alias("__yhat")] if m == 1 else
                                             [F.posexplode(F.array(*lends)).alias("set", "__yhat")]))
            pick = hashed_pick(id_col, f"{seed}:{t}:{turn}") if m == 1 else F.when(
                F.col("set") == 0, hashed_pick(id_col, f"{seed}:{t}:{turn}")).otherwise(
                F.pmod(F.xxhash64(F.col(id_col), F.col("set"), F.lit(f"{seed}:{t}:{turn}")), F.lit(1 << 30)))
            filled = matched(scored, id_col, [t], k, pick, ["__fill"], set_col="set", donors=lent)
            cur = filled.withColumn(t, F.coalesce("__fill", F.col(f"`{t}`"))).drop("__fill")
    cur = cur.select("set", id_col, *names).unionByName(
        whole.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("set"), id_col, *names))
    return cur.select("set", id_col, *[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in names])


def impute_pmm(df: DataFrame, id_col: str, targets: Sequence[str], predictors: Sequence[str],
               *, k: int = 5, max_iter: int = 5, seed: str = "123") -> DataFrame:
    """M4: the rows with the null ``targets`` of the first completed set; the
    other sets don't enter it, so they are not drawn here (see
    :func:`impute_sets`).  A target without any known value stays null."""
    done = impute_sets(df, id_col, targets, predictors, m=1, k=k, max_iter=max_iter, seed=seed)
    filled = [t for t in targets if t in done.columns]
    if not filled:
        return df
    fills = done.select(F.col(id_col).alias("__id"), *[F.col(f"`{t}`").alias(f"__f{i}") for i, t in enumerate(filled)])
    out = df.join(fills, F.col(id_col) == F.col("__id"), "left")
    place = {t: i for i, t in enumerate(filled)}
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.col(f"__f{place[c]}")).alias(c) if c in place else F.col(f"`{c}`")
                        for c in df.columns])
