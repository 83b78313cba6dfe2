"""Registered queries: labels, cohorts, cleaning, missing data, outliers,
features, lookups (P*, M*, F1-F10, J1, J5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import cleaning as C
from attrition.operators import features as FE
from attrition.operators import labels as L
from attrition.operators.outliers import winsor_summary, winsorize
from attrition.operators.quantiles import quantile_row
from attrition.plans.base import (ADDONS, LAB_SQL, PHONE, LINES, PROTECTION, RELABEL_SQL,
                                  STREAMING, labeled_df, modeling_df, modeling_table, new_cohort_df, snap_df, with_sql)
from attrition.plans.registry import register
from attrition.sources.fixtures import SNAP_COLUMNS, SNAP_SQL
from attrition.sources.tables import table

SNAP = SNAP_SQL
WINSOR_COLS = ("charge", "total_charges", "qty", "disc", "tenure")


@register("label_fill", with_sql(SNAP, "SELECT * REPLACE (coalesce(churn_category, 'No Churn') AS churn_category) FROM snap"))
def q_label_fill(spark, d):
    """P1"""
    return L.label_fill(snap_df(spark, d), ["churn_category"])


@register("multi_state_label", with_sql(LAB_SQL, "SELECT * FROM lab"))
def q_multi_state_label(spark, d):
    """P2"""
    return labeled_df(spark, d)


@register("cohort_filter_new", with_sql(LAB_SQL, "SELECT * FROM newc"))
def q_cohort_new(spark, d):
    """P3"""
    return new_cohort_df(spark, d)


@register("cohort_filter_model", with_sql(LAB_SQL, "SELECT * FROM mdl"))
def q_cohort_model(spark, d):
    """P4"""
    return modeling_df(spark, d)


@register("drop_sparse_columns", with_sql(SNAP, "SELECT * EXCLUDE (churn_category) FROM snap"))
def q_drop_sparse(spark, d):
    """P5: on the raw snapshot the reason column is > 50 % null."""
    return C.drop_sparse_columns(snap_df(spark, d), 50.0)


@register("drop_single_level", with_sql(LAB_SQL, "SELECT * EXCLUDE (status, churn_category, target) FROM newc"))
def q_drop_single_level(spark, d):
    """In the recently joined cohort status, reason and label are constant."""
    return C.drop_single_level(new_cohort_df(spark, d))


@register("conditional_fill", with_sql(SNAP, "SELECT * REPLACE (CASE WHEN qty IS NULL AND tenure = 0 THEN 0.0 ELSE qty END AS qty) FROM snap"))
def q_conditional_fill(spark, d):
    """Usage null with zero tenure -> 0."""
    return C.conditional_fill(snap_df(spark, d), "qty", "tenure", 0, 0.0)


_fill_sql = ", ".join(f"coalesce({c}, 'No Internet Service') AS {c}" for c in ADDONS)


@register("service_fill", with_sql(SNAP, f"SELECT * REPLACE ({_fill_sql}) FROM snap"))
def q_service_fill(spark, d):
    """P8"""
    return C.service_fill(snap_df(spark, d), ADDONS)


@register("lines_to_binary", with_sql(SNAP, f"""SELECT * REPLACE (CASE WHEN {PHONE} = 'No' THEN 'No'
  WHEN {PHONE} = 'Yes' AND {LINES} = 'Yes' THEN 'Yes' WHEN {PHONE} = 'Yes' AND {LINES} = 'No' THEN 'No'
  ELSE 'No' END AS {LINES}) FROM snap"""))
def q_lines_to_binary(spark, d):
    """P9"""
    return C.lines_to_binary(snap_df(spark, d), PHONE, LINES)


@register("relabel_contract", with_sql(SNAP, f"SELECT * REPLACE ({RELABEL_SQL} AS contract) FROM snap"))
def q_relabel_contract(spark, d):
    """P10"""
    return C.relabel_contract(snap_df(spark, d))


def _null_count_sql(src: str, cols) -> str:
    parts = [f"SELECT '{c}' AS variable, CAST(count(*) - count({c}) AS BIGINT) AS missing_count, "
             f"CAST(count(*) AS BIGINT) AS total_count FROM {src}" for c in cols]
    return " UNION ALL ".join(parts)


@register("missing_summary", with_sql(SNAP, f"""SELECT variable, missing_count, total_count,
  missing_count * 100.0::DOUBLE / total_count AS missing_percentage
FROM ({_null_count_sql('snap', SNAP_COLUMNS)}) WHERE missing_count > 0"""))
def q_missing_summary(spark, d):
    """M1"""
    return C.missing_summary(snap_df(spark, d))


@register("missing_by_variable", with_sql(LAB_SQL, f"""SELECT variable, missing_count, total_count,
  missing_count * 100.0::DOUBLE / total_count AS missing_percentage
FROM ({_null_count_sql('mdl', SNAP_COLUMNS + ('target',))})"""))
def q_missing_by_variable(spark, d):
    """M2: after the label fill, on the modelling cohort."""
    return C.missing_by_variable(modeling_df(spark, d))


_PATTERN_COLS = ("population", "n_lines", "qty", "disc", "has_standard", "churn_category")
_bits = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _PATTERN_COLS)
_nn = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in _PATTERN_COLS)


@register("missing_pattern", with_sql(SNAP, f"""SELECT {_bits} AS pattern, {_nn} AS n_missing,
  count(*) AS n_rows FROM snap GROUP BY 1, 2"""))
def q_missing_pattern(spark, d):
    """M3"""
    return C.missing_pattern(snap_df(spark, d), _PATTERN_COLS)


@register("null_total", with_sql(SNAP, f"""SELECT CAST(sum(missing_count) AS BIGINT) AS null_cells
FROM ({_null_count_sql('snap', SNAP_COLUMNS)})"""))
def q_null_total(spark, d):
    """M8"""
    return C.null_total(snap_df(spark, d))


def _bounds_sql(src: str, cols, lo: float, hi: float) -> str:
    return ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {lo}) AS {c}_lo, "
                     f"quantile_cont(CAST({c} AS DOUBLE), {hi}) AS {c}_hi" for c in cols) + f" FROM {src}"


_cap = ", ".join(
    f"round(CASE WHEN m.{c} IS NULL THEN NULL ELSE least(greatest(CAST(m.{c} AS DOUBLE), b.{c}_lo), b.{c}_hi) END, 6) AS {c}"
    for c in WINSOR_COLS)


@register("winsorize", with_sql(LAB_SQL, f""", b AS (SELECT {_bounds_sql('mdl', WINSOR_COLS, 0.01, 0.99)})
SELECT m.id, {_cap} FROM mdl m, b"""))
def q_winsorize(spark, d):
    """M6: caps at the 1st/99th percentiles (values rounded to 6 dp in the report)."""
    m = modeling_table(spark, d)
    w = winsorize(m, WINSOR_COLS)
    return w.select("id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in WINSOR_COLS])


@register("winsor_summary", with_sql(LAB_SQL, " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, round(min(CAST({c} AS DOUBLE)), 2) AS original_min,
  round(max(CAST({c} AS DOUBLE)), 2) AS original_max,
  round((SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) FROM mdl), 2) AS p1,
  round((SELECT quantile_cont(CAST({c} AS DOUBLE), 0.99) FROM mdl), 2) AS p99,
  CAST(count(*) FILTER (WHERE {c} < (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.01) FROM mdl)) AS BIGINT) AS n_capped_low,
  CAST(count(*) FILTER (WHERE {c} > (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.99) FROM mdl)) AS BIGINT) AS n_capped_high
FROM mdl""" for c in WINSOR_COLS)))
def q_winsor_summary(spark, d):
    """M7"""
    return winsor_summary(modeling_table(spark, d), WINSOR_COLS)


def _features_frame(spark, d):
    m = C.relabel_contract(modeling_table(spark, d))
    return FE.derive_features(m, addons=ADDONS, streaming=STREAMING, protection=PROTECTION)


def _yes_sum(cols):
    return " + ".join(f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END" for c in cols)


FEATURES_SQL = LAB_SQL + f""",
feat_in AS (SELECT * REPLACE ({RELABEL_SQL} AS contract) FROM mdl),
feat AS (
  SELECT id,
    CASE WHEN tenure <= 6 THEN 'New' WHEN tenure <= 24 THEN 'Growing' WHEN tenure <= 60 THEN 'Mature'
         ELSE 'Loyal' END AS tenure_group,
    CASE WHEN tenure > 0 THEN total_charges / tenure WHEN NOT (tenure > 0) THEN charge END AS avg_revenue_per_month,
    {_yes_sum(ADDONS)} AS service_count,
    CASE WHEN tenure > 0 THEN total_charges / tenure WHEN NOT (tenure > 0) THEN 0.0 END AS revenue_tenure_ratio,
    CASE WHEN {_yes_sum(STREAMING)} > 0 THEN 'Yes' ELSE 'No' END AS has_streaming,
    CASE WHEN {_yes_sum(PROTECTION)} > 0 THEN 'Yes' ELSE 'No' END AS has_protection,
    CASE WHEN age < 30 THEN 'Young' WHEN age < 50 THEN 'Middle' ELSE 'Senior' END AS age_group,
    CASE WHEN contract = 'Month to Month' AND tenure < 12 THEN 'High Risk'
         WHEN contract = 'Month to Month' THEN 'Medium Risk' ELSE 'Low Risk' END AS contract_tenure_risk
  FROM feat_in)"""

_FEATURE_KEYS = {
    "tenure_group": "tenure_group", "avg_revenue": "avg_revenue_per_month",
    "service_count": "service_count", "revenue_tenure_ratio": "revenue_tenure_ratio",
    "has_streaming": "has_streaming", "has_protection": "has_protection",
    "age_group": "age_group", "contract_tenure_risk": "contract_tenure_risk",
}


def _make_feature_query(key: str, col: str):
    @register(key, with_sql(FEATURES_SQL, f"SELECT id, {col} FROM feat"))
    def q(spark, d):
        return _features_frame(spark, d).select("id", col)
    q.__doc__ = f"F: {col} derived on the modelling cohort"
    return q


for _k, _c in _FEATURE_KEYS.items():
    _make_feature_query(_k, _c)


@register("derive_features", with_sql(FEATURES_SQL, "SELECT * FROM feat"))
def q_derive_features(spark, d):
    """F1-F8 in one projection."""
    f = _features_frame(spark, d)
    return f.select("id", *_FEATURE_KEYS.values())


@register("tenure_segment", with_sql(LAB_SQL, """SELECT id, CASE
  WHEN tenure >= 0 AND tenure <= 6 THEN 'New (0-6m)' WHEN tenure > 6 AND tenure <= 24 THEN 'Growing (6-24m)'
  WHEN tenure > 24 AND tenure <= 60 THEN 'Mature (24-60m)' WHEN tenure > 60 THEN 'Loyal (60m+)' END AS tenure_segment
FROM mdl"""))
def q_tenure_segment(spark, d):
    """F9"""
    return modeling_df(spark, d).select("id", FE.tenure_segment(F.col("tenure")).alias("tenure_segment"))


@register("value_segment", with_sql(LAB_SQL, """, q AS (SELECT quantile_cont(charge, 0.0) AS q0,
  quantile_cont(charge, 0.33) AS q33, quantile_cont(charge, 0.67) AS q67, quantile_cont(charge, 1.0) AS q100 FROM mdl)
SELECT id, CASE WHEN charge >= q0 AND charge <= q33 THEN 'Economy' WHEN charge > q33 AND charge <= q67 THEN 'Standard'
  WHEN charge > q67 AND charge <= q100 THEN 'Premium' END AS value_segment FROM mdl, q""".replace("\n", "\n", 1)))
def q_value_segment(spark, d):
    """cut points are exact percentiles of the monthly charge."""
    m = modeling_table(spark, d)
    q = quantile_row(m, ["charge"], [0.0, 0.33, 0.67, 1.0])
    cuts = [F.lit(q[("charge", p)]) for p in (0.0, 0.33, 0.67, 1.0)]
    return m.select("id", FE.value_segment(F.col("charge"), *cuts).alias("value_segment"))


def zip_lookup(spark, d):
    """The zip-population lookup played by suppliers per nation."""
    return (table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("zip_code"))
            .agg(F.count(F.lit(1)).alias("population")))


def enrich_left(df, lookup, key: str, suffix: str = "_zip"):
    """Left equi-join to a lookup; lookup columns that collide with the
    left side get ``suffix``.  The lookup side is left to AQE, which
    broadcasts it when its measured size is small and otherwise keeps a
    shuffle join (its size is data-dependent, so no unchecked hint)."""
    ren = [F.col(c).alias(c + suffix) if c in df.columns and c != key else F.col(c)
           for c in lookup.columns]
    return df.join(lookup.select(*ren), key, "left")


@register("enrich_left", with_sql(SNAP, """SELECT snap.*, z.population AS population_zip FROM snap
LEFT JOIN (SELECT s_nationkey AS zip_code, count(*) AS population FROM supplier GROUP BY 1) z USING (zip_code)"""))
def q_enrich_left(spark, d):
    """J1"""
    return enrich_left(snap_df(spark, d), zip_lookup(spark, d), "zip_code")


def join_back_by_key(left, right, key: str = "id"):
    """Recombine two column groups of the same rows by the stable key
    (the reference pastes them by position, which Spark has no notion of)."""
    return left.join(right, key, "inner")


@register("join_back_by_key", with_sql(LAB_SQL, "SELECT * FROM mdl"))
def q_join_back(spark, d):
    """Split the cohort into label columns and the rest, join back."""
    m = modeling_df(spark, d)
    excluded = ["status", "churn_category", "target"]
    left = m.select("id", *excluded)
    right = m.select(*[c for c in m.columns if c not in excluded])
    return join_back_by_key(left, right).select(*m.columns)
