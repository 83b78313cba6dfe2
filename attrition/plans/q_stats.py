"""Registered queries: distributions, box statistics, correlation, splits,
weights (A1-A7, A15, A16, T1-T3, J2, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import split as S
from attrition.operators import stats as ST
from attrition.operators.outliers import box_stats
from attrition.plans.base import (LAB_SQL, LINES, PHONE, SCORED_SQL, labeled_df, modeling_df, modeling_table,
                                  new_cohort_df, scored_df, snap_df, with_sql)
from attrition.plans.registry import register
from attrition.sources.fixtures import SNAP_SQL

CORR_COLS = ("tenure", "charge", "total_charges", "qty", "disc", "n_lines", "age", "population")


@register("class_distribution", with_sql(LAB_SQL, """SELECT target AS category, count(*) AS count,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percentage FROM lab GROUP BY target"""))
def q_class_distribution(spark, d):
    """A1: all labels including the recently joined."""
    return ST.class_distribution(labeled_df(spark, d))


@register("cohort_stats", with_sql(LAB_SQL, """SELECT count(*) AS n, round(avg(CAST(tenure AS DOUBLE)), 10) AS avg_tenure,
  round(avg(charge), 6) AS avg_charge FROM newc"""))
def q_cohort_stats(spark, d):
    """A2: the recently joined cohort."""
    return ST.cohort_stats(new_cohort_df(spark, d)).select(
        "n", F.round("avg_tenure", 10).alias("avg_tenure"), F.round("avg_charge", 6).alias("avg_charge"))




@register("conditional_counts", with_sql(SNAP_SQL, f"""SELECT
  count(*) FILTER (WHERE {PHONE} = 'Yes' AND {LINES} = 'Yes') AS phone_yes_lines_yes,
  count(*) FILTER (WHERE {PHONE} = 'Yes' AND {LINES} = 'No') AS phone_yes_lines_no,
  count(*) FILTER (WHERE {PHONE} = 'No') AS phone_no FROM snap"""))
def q_conditional_counts(spark, d):
    """A3"""
    return ST.conditional_counts(snap_df(spark, d), PHONE, LINES)


@register("category_bar", with_sql(LAB_SQL, "SELECT target AS category, count(*) AS count FROM mdl GROUP BY 1 ORDER BY 2 DESC, 1"))
def q_category_bar(spark, d):
    """A4"""
    return ST.category_bar(modeling_df(spark, d))


@register("box_stats", with_sql(LAB_SQL, """, q AS (SELECT target, quantile_cont(charge, 0.25) AS q1,
  quantile_cont(charge, 0.5) AS median, quantile_cont(charge, 0.75) AS q3 FROM mdl GROUP BY target),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT m.target, count(*) AS n, round(any_value(f.q1), 6) AS q1, round(any_value(f.median), 6) AS median,
  round(any_value(f.q3), 6) AS q3,
  min(CASE WHEN charge >= lo AND charge <= hi THEN charge END) AS whisker_low,
  max(CASE WHEN charge >= lo AND charge <= hi THEN charge END) AS whisker_high,
  CAST(count(*) FILTER (WHERE NOT (charge >= lo AND charge <= hi)) AS BIGINT) AS n_outliers
FROM mdl m JOIN f USING (target) GROUP BY m.target"""))
def q_box_stats(spark, d):
    """A5: monthly charge by class (quartiles reported to 6 dp)."""
    b = box_stats(modeling_table(spark, d), "charge", by=["target"])
    return b.select("target", "n", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"),
                    F.round("q3", 6).alias("q3"), "whisker_low", "whisker_high", "n_outliers")


def _corr_sql() -> str:
    cols = CORR_COLS
    parts = []
    cc = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, 1.0::DOUBLE AS r")
            else:
                v = (f"CASE WHEN stddev_samp(CAST({a} AS DOUBLE)) > 0 AND stddev_samp(CAST({b} AS DOUBLE)) > 0 "
                     f"THEN round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8) END")
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {v} AS r FROM mdl WHERE {cc}")
    return " UNION ALL ".join(parts)


CORR_SQL = LAB_SQL + ", cm AS (" + _corr_sql() + ")"


@register("corr_matrix", with_sql(CORR_SQL, "SELECT * FROM cm"))
def q_corr_matrix(spark, d):
    """A6"""
    return ST.corr_matrix(modeling_df(spark, d), CORR_COLS)


@register("high_corr_pairs", with_sql(CORR_SQL, "SELECT * FROM cm WHERE abs(r) > 0.8 AND abs(r) < 1"))
def q_high_corr_pairs(spark, d):
    """A7"""
    return ST.high_corr_pairs(ST.corr_matrix(modeling_df(spark, d), CORR_COLS))


@register("score_histogram", with_sql(SCORED_SQL, """, r AS (SELECT min(composite_risk_score) AS mn,
  max(composite_risk_score) AS mx FROM scored),
b AS (SELECT risk_category, CAST(least(greatest(CASE WHEN (mx - mn) / 29.0::DOUBLE > 0
    THEN floor((composite_risk_score - mn) / ((mx - mn) / 29.0::DOUBLE) + 0.5) ELSE 0 END, 0), 29) AS INTEGER) AS bin,
  mn, mx FROM scored, r WHERE composite_risk_score IS NOT NULL)
SELECT risk_category, bin, count(*) AS count,
  round(any_value(mn) + bin * ((any_value(mx) - any_value(mn)) / 29.0::DOUBLE), 10) AS bin_center
FROM b GROUP BY risk_category, bin"""))
def q_score_histogram(spark, d):
    """30 bins of the composite score by risk level."""
    return ST.score_histogram(scored_df(spark, d), "composite_risk_score", by=["risk_category"])


@register("score_trend", with_sql(SCORED_SQL, """SELECT tenure, count(*) AS n,
  round(avg(composite_risk_score), 10) AS avg_score FROM scored GROUP BY tenure"""))
def q_score_trend(spark, d):
    """A16"""
    return ST.score_trend(scored_df(spark, d), "tenure", "composite_risk_score")


SPLIT_SQL = LAB_SQL + """,
sp AS (SELECT id, target,
  row_number() OVER (PARTITION BY target ORDER BY md5(CAST(id AS VARCHAR) || ':' || '123'), id) AS pos,
  count(*) OVER (PARTITION BY target) AS n_class FROM mdl),
split AS (SELECT id, target, pos <= ceil(n_class * 0.8) AS is_train FROM sp)"""


@register("stratified_split", with_sql(SPLIT_SQL, "SELECT * FROM split"))
def q_stratified_split(spark, d):
    """Exact 80/20 per class."""
    return S.stratified_split(modeling_table(spark, d)).select("id", "target", "is_train")


@register("stratified_folds", with_sql(LAB_SQL, """SELECT id, target, CAST((row_number() OVER (PARTITION BY target
  ORDER BY md5(CAST(id AS VARCHAR) || ':' || '123:folds'), id) - 1) % 5 + 1 AS INTEGER) AS fold FROM mdl"""))
def q_stratified_folds(spark, d):
    """Five folds balanced within each class."""
    return S.stratified_folds(modeling_table(spark, d)).select("id", "target", "fold")


WEIGHTS_SQL = SPLIT_SQL + """,
cw AS (SELECT target AS class, count(*) AS n FROM split WHERE is_train GROUP BY 1),
weights AS (SELECT class, n, sum(n) OVER () * 1.0::DOUBLE / (count(*) OVER () * n) AS weight FROM cw)"""


@register("class_weights", with_sql(WEIGHTS_SQL, "SELECT * FROM weights"))
def q_class_weights(spark, d):
    """On the training part."""
    tr = S.stratified_split(modeling_table(spark, d)).filter("is_train")
    return S.class_weights(tr)


@register("weight_lookup", with_sql(WEIGHTS_SQL, """SELECT s.id, s.target, w.weight FROM split s
  LEFT JOIN weights w ON w.class = s.target WHERE s.is_train"""))
def q_weight_lookup(spark, d):
    """Each training row gets its class weight."""
    tr = S.stratified_split(modeling_table(spark, d)).filter("is_train")
    return S.attach_weights(tr, S.class_weights(tr)).select("id", "target", "weight")


@register("complement", with_sql(SPLIT_SQL, "SELECT id, target FROM split WHERE NOT is_train"))
def q_complement(spark, d):
    """The test part."""
    return S.complement(S.stratified_split(modeling_table(spark, d))).select("id", "target")
