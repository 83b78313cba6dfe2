"""Registered queries: risk scoring and business roll-ups (B1-B5, B8,
A8-A14, A19, J6, J7).  The flagship query is ``risk_summary``."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import risk as R
from attrition.plans.base import SCORED_NEW_SQL, SCORED_SQL, scored_df, scored_new_df, with_sql
from attrition.plans.registry import register

MONEY = "CAST(charge AS DECIMAL(18,2))"
HIGH = "risk_category IN ('High', 'Critical')"


@register("base_risk", with_sql(SCORED_SQL, "SELECT id, base_risk FROM scored"))
def q_base_risk(spark, d):
    """B1"""
    return scored_df(spark, d).select("id", "base_risk")


@register("risk_multipliers", with_sql(SCORED_SQL, "SELECT id, tenure_multiplier, contract_multiplier, payment_multiplier FROM scored"))
def q_risk_multipliers(spark, d):
    """B2"""
    return scored_df(spark, d).select("id", "tenure_multiplier", "contract_multiplier", "payment_multiplier")


@register("composite_risk", with_sql(SCORED_SQL, "SELECT id, composite_risk_score FROM scored"))
def q_composite_risk(spark, d):
    """B3"""
    return scored_df(spark, d).select("id", "composite_risk_score")


@register("risk_category", with_sql(SCORED_SQL, "SELECT id, risk_category FROM scored"))
def q_risk_category(spark, d):
    """B4"""
    return scored_df(spark, d).select("id", "risk_category")


@register("new_cohort_risk", with_sql(SCORED_NEW_SQL, "SELECT * FROM scored_new"))
def q_new_cohort_risk(spark, d):
    """The recently joined cohort, tenure multiplier fixed at 1.5."""
    return scored_new_df(spark, d)


def _risk_summary_sql(src: str, with_tenure: bool = True) -> str:
    ten = ("CAST(sum(tenure) AS DOUBLE) / CAST(count(tenure) AS DOUBLE) AS avg_tenure," if with_tenure else "")
    return f"""SELECT risk_category, count(*) AS count,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percentage,
  CAST(sum({MONEY}) AS DOUBLE) / CAST(count(charge) AS DOUBLE) AS avg_monthly_revenue,
  {ten}
  CAST(sum({MONEY}) AS DOUBLE) AS total_monthly_revenue,
  round(avg(composite_risk_score), 10) AS avg_risk_score
FROM {src} GROUP BY risk_category"""


@register("risk_summary", with_sql(SCORED_SQL, _risk_summary_sql("scored")))
def q_risk_summary(spark, d):
    """A8 (flagship): count, share, revenue, tenure and score per risk level."""
    return R.risk_summary(scored_df(spark, d))


@register("new_cohort_risk_summary", with_sql(SCORED_NEW_SQL, _risk_summary_sql("scored_new", False)))
def q_new_cohort_summary(spark, d):
    """A8 on the new cohort (no tenure column, as in the reference)."""
    return R.risk_summary(scored_new_df(spark, d), with_tenure=False)


@register("revenue_at_risk", with_sql(SCORED_SQL, f"""SELECT count(*) AS total_customers,
  count(*) FILTER (WHERE {HIGH}) AS high_risk_customers,
  count(*) FILTER (WHERE {HIGH}) * 100.0::DOUBLE / count(*) AS high_risk_pct,
  CAST(sum({MONEY}) AS DOUBLE) / CAST(count(charge) AS DOUBLE) AS avg_monthly_revenue,
  CAST(coalesce(sum({MONEY}) FILTER (WHERE {HIGH}), 0) AS DOUBLE) AS monthly_revenue_at_risk,
  CAST(coalesce(sum({MONEY}) FILTER (WHERE {HIGH}) * 12, 0) AS DOUBLE) AS annual_revenue_at_risk,
  CAST(coalesce(sum({MONEY}) FILTER (WHERE {HIGH}) * 12 * CAST(0.15 AS DECIMAL(3,2)), 0) AS DOUBLE) AS recommended_budget
FROM scored"""))
def q_revenue_at_risk(spark, d):
    """A9"""
    return R.revenue_at_risk(scored_df(spark, d))


TENURE_SEG_SQL = """CASE WHEN tenure >= 0 AND tenure <= 6 THEN 'New (0-6m)' WHEN tenure > 6 AND tenure <= 24 THEN 'Growing (6-24m)'
  WHEN tenure > 24 AND tenure <= 60 THEN 'Mature (24-60m)' WHEN tenure > 60 THEN 'Loyal (60m+)' END"""
GRID_SQL = """(SELECT unnest(['New (0-6m)', 'Growing (6-24m)', 'Mature (24-60m)', 'Loyal (60m+)']) AS tenure_segment) t
  CROSS JOIN (SELECT unnest(['Low', 'Medium', 'High', 'Critical']) AS risk_category) r"""


@register("segment_risk", with_sql(SCORED_SQL, f""", g AS (SELECT {TENURE_SEG_SQL} AS tenure_segment, risk_category,
  count(*) AS count, round(avg(composite_risk_score), 10) AS avg_risk, CAST(sum({MONEY}) AS DOUBLE) AS total_revenue
  FROM scored GROUP BY 1, 2)
SELECT t.tenure_segment, r.risk_category, CAST(coalesce(g.count, 0) AS BIGINT) AS count,
  coalesce(g.avg_risk, 0.0::DOUBLE) AS avg_risk, coalesce(g.total_revenue, 0.0::DOUBLE) AS total_revenue
FROM {GRID_SQL} LEFT JOIN g ON g.tenure_segment = t.tenure_segment AND g.risk_category = r.risk_category"""))
def q_segment_risk(spark, d):
    """A10: tenure segment x risk level on the complete grid."""
    return R.segment_risk(scored_df(spark, d))


@register("complete_grid", with_sql(SCORED_SQL, f""", g AS (SELECT {TENURE_SEG_SQL} AS tenure_segment, risk_category,
  count(*) AS count FROM scored GROUP BY 1, 2)
SELECT t.tenure_segment, r.risk_category, CAST(coalesce(g.count, 0) AS BIGINT) AS count
FROM {GRID_SQL} LEFT JOIN g ON g.tenure_segment = t.tenure_segment AND g.risk_category = r.risk_category"""))
def q_complete_grid(spark, d):
    """Counts completed over every segment x level pair."""
    from attrition.operators.features import TENURE_LABELS, tenure_segment
    g = (scored_df(spark, d).groupBy(tenure_segment(F.col("tenure")).alias("tenure_segment"), "risk_category")
         .agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    return R.complete_grid(g, {"tenure_segment": TENURE_LABELS, "risk_category": R.RISK_LEVELS}, {"count": 0})


@register("high_risk_share", with_sql(SCORED_SQL, f"""SELECT
  avg(CASE WHEN tenure < 6 THEN CASE WHEN {HIGH} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END) AS new_customer_high_risk_pct,
  avg(CASE WHEN contract = 'Month to Month' THEN CASE WHEN {HIGH} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END END) AS monthly_contract_high_risk_pct
FROM scored"""))
def q_high_risk_share(spark, d):
    """A11"""
    return R.high_risk_share(scored_df(spark, d))


@register("high_risk_share_by", with_sql(SCORED_SQL, f"""SELECT payment,
  avg(CASE WHEN {HIGH} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) AS high_risk_pct, count(*) AS count
FROM scored GROUP BY payment ORDER BY 2 DESC, 1"""))
def q_high_risk_share_by(spark, d):
    """By payment method."""
    return R.high_risk_share_by(scored_df(spark, d), "payment")


@register("revenue_by_risk", with_sql(SCORED_SQL, f"""SELECT risk_category,
  CAST(sum({MONEY}) AS DOUBLE) AS total_monthly_revenue FROM scored GROUP BY 1"""))
def q_revenue_by_risk(spark, d):
    """A13"""
    return R.revenue_by_risk(scored_df(spark, d))


@register("risk_share_in_group", with_sql(SCORED_SQL, """SELECT contract, risk_category, count(*) AS count,
  CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY contract) AS DOUBLE) AS share
FROM scored GROUP BY 1, 2"""))
def q_risk_share_in_group(spark, d):
    """By contract."""
    return R.risk_share_in_group(scored_df(spark, d), "contract")


@register("risk_counts", with_sql(SCORED_SQL, """SELECT risk_category, count(*) AS count,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percentage FROM scored GROUP BY 1"""))
def q_risk_counts(spark, d):
    """A19"""
    return R.risk_counts(scored_df(spark, d))


def _actions_sql() -> str:
    cols = ("risk_category", "risk_level", "recommended_actions", "contact_frequency",
            "retention_budget_priority")
    sel = []
    for a in R.ACTIONS:
        vals = ", ".join("'" + v.replace("'", "''") + "' AS " + c for v, c in zip(a, cols))
        sel.append("SELECT " + vals)
    return " UNION ALL ".join(sel)


@register("action_join", with_sql(SCORED_SQL, f""", plan AS ({_actions_sql()}),
cnt AS (SELECT risk_category, count(*) AS customer_count FROM scored GROUP BY 1)
SELECT plan.*, CAST(coalesce(cnt.customer_count, 0) AS BIGINT) AS customer_count
FROM plan LEFT JOIN cnt USING (risk_category)"""))
def q_action_join(spark, d):
    """J7"""
    return R.action_plan(scored_df(spark, d))


@register("impact_summary", with_sql(SCORED_SQL, f""", b AS (SELECT count(*) AS total_customers,
  count(*) FILTER (WHERE {HIGH}) AS high_risk_customers,
  count(*) FILTER (WHERE {HIGH}) * 100.0::DOUBLE / count(*) AS high_risk_pct,
  CAST(coalesce(sum({MONEY}) FILTER (WHERE {HIGH}), 0) AS DOUBLE) AS m,
  CAST(coalesce(sum({MONEY}) FILTER (WHERE {HIGH}) * 12, 0) AS DOUBLE) AS a,
  CAST(coalesce(sum({MONEY}) FILTER (WHERE {HIGH}) * 12 * CAST(0.15 AS DECIMAL(3,2)), 0) AS DOUBLE) AS bud FROM scored)
SELECT total_customers, high_risk_customers, round(high_risk_pct, 2) AS high_risk_percentage,
  round(m, 0) AS monthly_revenue_at_risk, round(a, 0) AS annual_revenue_at_risk, round(bud, 0) AS recommended_budget FROM b"""))
def q_impact_summary(spark, d):
    """Business part of the final summary record."""
    return R.impact_summary(scored_df(spark, d))
