"""Registered queries: sources and sinks (S1, S3, S4) and reshaping /
ordered reports (U1-U3, W3-W6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import metrics as M
from attrition.operators import reshape as RS
from attrition.operators import risk as R
from attrition.plans.base import (BOTH_SCORED_SQL, SCORED_SQL, preds_df, scored_df, scored_new_df,
                                  snap_df, with_sql)
from attrition.plans.q_eval import CONF_SQL
from attrition.plans.registry import register
from attrition.session import scratch_path
from attrition.sources.csv import scan_csv
from attrition.sources.fixtures import SNAP_COLUMNS, SNAP_SQL
from attrition.sources.sinks import sink_csv


@register("scan_csv", with_sql(SNAP_SQL, "SELECT * FROM snap"))
def q_scan_csv(spark, d):
    """S4 + S1: write the snapshot as CSV part-files (nulls as "NA") to the
    shared checkpoint folder, read it back with the multi-token null reader
    and the declared schema."""
    s = snap_df(spark, d)
    path = sink_csv(s, scratch_path(spark, "snap-csv"))
    return scan_csv(spark, path, schema=s.schema)


@register("sink_csv", with_sql(SCORED_SQL, "SELECT * FROM scored"))
def q_sink_csv(spark, d):
    """The test score frame written as CSV part-files under the shared
    checkpoint folder (never one file through one task), read back."""
    s = scored_df(spark, d)
    path = sink_csv(s, scratch_path(spark, "scores-csv"))
    return scan_csv(spark, path, schema=s.schema)


@register("profile_shape", with_sql(SNAP_SQL, f"""SELECT count(*) AS n_rows, {len(SNAP_COLUMNS)} AS n_cols,
  '{", ".join(SNAP_COLUMNS[:10])}' AS first_columns FROM snap"""))
def q_profile_shape(spark, d):
    """S3: rows, columns and the first ten column names."""
    s = snap_df(spark, d)
    return s.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(s.columns)).alias("n_cols"), F.lit(", ".join(s.columns[:10])).alias("first_columns"))


def _union_sql() -> str:
    from attrition.plans.q_risk import _risk_summary_sql
    a = _risk_summary_sql("scored")
    b = _risk_summary_sql("scored_new", False)
    return (f"SELECT *, 'modelling' AS cohort FROM ({a}) UNION ALL BY NAME "
            f"SELECT *, 'recently joined' AS cohort FROM ({b})")


@register("union_by_name", with_sql(BOTH_SCORED_SQL, _union_sql()))
def q_union_by_name(spark, d):
    """The two cohorts' risk summaries in one table (the new cohort has
    no tenure column, so it is null there)."""
    a = R.risk_summary(scored_df(spark, d)).withColumn("cohort", F.lit("modelling"))
    b = R.risk_summary(scored_new_df(spark, d), with_tenure=False).withColumn("cohort", F.lit("recently joined"))
    return RS.union_by_name(a, b)


@register("wide_to_long", with_sql(SCORED_SQL, """, r AS (SELECT CAST(count(*) AS DOUBLE) AS total_customers,
  CAST(count(*) FILTER (WHERE risk_category IN ('High', 'Critical')) AS DOUBLE) AS high_risk_customers,
  CAST(sum(CAST(charge AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue FROM scored)
SELECT 'total_customers' AS metric, total_customers AS value FROM r
UNION ALL SELECT 'high_risk_customers', high_risk_customers FROM r
UNION ALL SELECT 'total_revenue', total_revenue FROM r"""))
def q_wide_to_long(spark, d):
    """A one-row report unpivoted to (metric, value)."""
    s = scored_df(spark, d)
    wide = s.agg(F.count(F.lit(1)).cast("double").alias("total_customers"),
                 F.count_if(F.col("risk_category").isin("High", "Critical")).cast("double").alias("high_risk_customers"),
                 F.sum(F.col("charge").cast("decimal(18,2)")).cast("double").alias("total_revenue"))
    return RS.wide_to_long(wide, [], ["total_customers", "high_risk_customers", "total_revenue"], "metric", "value")


_CLASSES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "No Churn")


@register("long_to_wide", with_sql(CONF_SQL, "SELECT predicted, " + ", ".join(
    f"CAST(coalesce(max(count) FILTER (WHERE actual = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in _CLASSES)
    + " FROM conf GROUP BY predicted"))
def q_long_to_wide(spark, d):
    """The confusion table as a predicted x actual matrix."""
    conf = M.confusion_long(preds_df(spark, d))
    levels = sorted(r[0] for r in conf.select("actual").distinct().collect())
    w = RS.long_to_wide(conf, "predicted", "actual", "count", levels)
    return w.select("predicted", *[F.col(f"`{c}`").cast("bigint").alias(c) for c in levels])


@register("rank_first", with_sql(CONF_SQL, """SELECT class, f1_score,
  row_number() OVER (ORDER BY f1_score DESC NULLS LAST, class) AS rank FROM pcm"""))
def q_rank_first(spark, d):
    """Classes ranked by F1, ties first by name."""
    pc = M.per_class_metrics(M.confusion_long(preds_df(spark, d)))
    return RS.rank_first(pc.select("class", "f1_score"), "f1_score", tiebreak="class")


@register("running_share", with_sql(SCORED_SQL, """, r AS (SELECT risk_category,
  CAST(sum(CAST(charge AS DECIMAL(18,2))) AS DOUBLE) AS total_monthly_revenue FROM scored GROUP BY 1)
SELECT *, sum(total_monthly_revenue) OVER (ORDER BY total_monthly_revenue DESC, risk_category
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(total_monthly_revenue) OVER () AS cumulative_share FROM r"""))
def q_running_share(spark, d):
    """Cumulative revenue share over risk levels, largest first."""
    r = R.revenue_by_risk(scored_df(spark, d))
    return RS.running_share(r, "total_monthly_revenue", [F.desc("total_monthly_revenue"), F.asc("risk_category")])


@register("share_of_total", with_sql(SCORED_SQL, """SELECT payment, count(*) AS count,
  count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percentage FROM scored GROUP BY 1"""))
def q_share_of_total(spark, d):
    """Customers per payment method and their share."""
    from attrition.operators.stats import share_of_total
    c = scored_df(spark, d).groupBy("payment").agg(F.count(F.lit(1)).alias("count"))
    return share_of_total(c)


@register("reorder_levels", with_sql(CONF_SQL, "SELECT class, f1_score FROM pcm ORDER BY f1_score DESC, class"))
def q_reorder_levels(spark, d):
    """Classes ordered by F1 (bar-chart order)."""
    pc = M.per_class_metrics(M.confusion_long(preds_df(spark, d)))
    return RS.reorder_levels(pc.select("class", "f1_score"), "f1_score", name="class")
