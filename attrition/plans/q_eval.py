"""Registered queries: evaluation on pseudo class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import metrics as M
from attrition.operators import split as S
from attrition.plans.base import PROBS_SQL, eval_frames, modeling_table, preds_df, probs_df, with_sql
from attrition.plans.registry import register
from attrition.session import materialize
from attrition.sources.fixtures import with_class_probabilities

CONF_SQL = PROBS_SQL + """,
lvl AS (SELECT actual AS class FROM preds UNION SELECT predicted FROM preds),
cnt AS (SELECT predicted, actual, count(*) AS c FROM preds GROUP BY 1, 2),
conf AS (SELECT a.class AS predicted, b.class AS actual, CAST(coalesce(c, 0) AS BIGINT) AS count
  FROM lvl a CROSS JOIN lvl b LEFT JOIN cnt ON cnt.predicted = a.class AND cnt.actual = b.class),
marg AS (SELECT l.class,
  (SELECT sum(count) FROM conf WHERE predicted = l.class) AS pred_n,
  (SELECT sum(count) FROM conf WHERE actual = l.class) AS act_n,
  (SELECT sum(count) FROM conf WHERE actual = l.class AND predicted = l.class) AS tp FROM lvl l),
overall AS (SELECT CAST(sum(act_n) AS BIGINT) AS n, CAST(sum(tp) AS BIGINT) AS correct,
  sum(tp) * 1.0::DOUBLE / sum(act_n) AS accuracy,
  (sum(tp) * 1.0::DOUBLE / sum(act_n) - sum(CAST(pred_n AS DOUBLE) * CAST(act_n AS DOUBLE)) / (CAST(sum(act_n) AS DOUBLE) * CAST(sum(act_n) AS DOUBLE)))
  / (1.0::DOUBLE - sum(CAST(pred_n AS DOUBLE) * CAST(act_n AS DOUBLE)) / (CAST(sum(act_n) AS DOUBLE) * CAST(sum(act_n) AS DOUBLE))) AS kappa
  FROM marg),
pcm0 AS (SELECT class, tp, pred_n - tp AS fp, act_n - tp AS fn,
  (SELECT sum(act_n) FROM marg) - pred_n - act_n + tp AS tn FROM marg),
pcm1 AS (SELECT class,
  CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS sensitivity,
  CASE WHEN tn + fp <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END AS specificity,
  CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision FROM pcm0),
pcm AS (SELECT *, CASE WHEN precision + sensitivity > 0 THEN 2.0::DOUBLE * precision * sensitivity / (precision + sensitivity) END AS f1_score,
  (sensitivity + specificity) / 2.0::DOUBLE AS balanced_accuracy FROM pcm1),
macro AS (SELECT avg(precision) AS macro_precision, avg(sensitivity) AS macro_recall, avg(f1_score) AS macro_f1 FROM pcm),
auc_cnt AS (SELECT class, prob, sum(CASE WHEN actual = class THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN actual = class THEN 0 ELSE 1 END) AS neg FROM probs GROUP BY 1, 2),
auc_run AS (SELECT *, sum(neg) OVER (PARTITION BY class ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM auc_cnt),
auc AS (SELECT class, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (2 * (neg_cum - neg) + neg)) AS DOUBLE)
    / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS auc FROM auc_run GROUP BY class),
ll AS (SELECT avg(-ln(greatest(least(prob, 1.0::DOUBLE - 1e-15::DOUBLE), 1e-15::DOUBLE))) AS log_loss FROM probs WHERE class = actual)"""


@register("confusion_long", with_sql(CONF_SQL, "SELECT * FROM conf"))
def q_confusion_long(spark, d):
    """E1"""
    return M.confusion_long(preds_df(spark, d))


@register("confusion_row_pct", with_sql(CONF_SQL, """SELECT *, CASE WHEN sum(count) OVER (PARTITION BY predicted) <> 0
  THEN count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY predicted) END AS row_pct FROM conf"""))
def q_confusion_row_pct(spark, d):
    """E2"""
    return M.confusion_row_pct(M.confusion_long(preds_df(spark, d)))


@register("overall_metrics", with_sql(CONF_SQL, "SELECT * FROM overall"))
def q_overall_metrics(spark, d):
    """E3"""
    return M.overall_metrics(M.confusion_long(preds_df(spark, d)))


@register("accuracy_ci", with_sql(CONF_SQL, """, w AS (SELECT correct * 1.0::DOUBLE / n AS p, CAST(n AS DOUBLE) AS nn FROM overall),
c AS (SELECT (p + 3.841458820694124::DOUBLE / (2.0::DOUBLE * nn)) / (1.0::DOUBLE + 3.841458820694124::DOUBLE / nn) AS centre,
  1.959963984540054::DOUBLE * sqrt(p * (1.0::DOUBLE - p) / nn + 3.841458820694124::DOUBLE / (4.0::DOUBLE * nn * nn)) / (1.0::DOUBLE + 3.841458820694124::DOUBLE / nn) AS half FROM w)
SELECT round(centre - half, 10) AS ci_lower, round(centre + half, 10) AS ci_upper FROM c"""))
def q_accuracy_ci(spark, d):
    """Wilson interval of the accuracy (reported to 10 dp)."""
    o = M.overall_metrics(M.confusion_long(preds_df(spark, d)))
    lo, hi = M.accuracy_ci(F.col("correct"), F.col("n"))
    return o.select(F.round(lo, 10).alias("ci_lower"), F.round(hi, 10).alias("ci_upper"))


@register("per_class_metrics", with_sql(CONF_SQL, "SELECT * FROM pcm"))
def q_per_class(spark, d):
    """E5"""
    return M.per_class_metrics(M.confusion_long(preds_df(spark, d)))


@register("macro_metrics", with_sql(CONF_SQL, "SELECT round(macro_precision, 12) AS macro_precision, round(macro_recall, 12) AS macro_recall, round(macro_f1, 12) AS macro_f1 FROM macro"))
def q_macro(spark, d):
    """E6 (means over classes reported to 12 dp)."""
    m = M.macro_metrics(M.per_class_metrics(M.confusion_long(preds_df(spark, d))))
    return m.select(*[F.round(c, 12).alias(c) for c in m.columns])


@register("auc_ovr", with_sql(CONF_SQL, "SELECT * FROM auc"))
def q_auc_ovr(spark, d):
    """Exact one-vs-rest AUC per class."""
    return M.auc_ovr(probs_df(spark, d))


@register("macro_auc", with_sql(CONF_SQL, "SELECT round(avg(auc), 12) AS macro_auc FROM auc"))
def q_macro_auc(spark, d):
    """E7 macro."""
    return M.macro_auc(M.auc_ovr(probs_df(spark, d))).select(F.round("macro_auc", 12).alias("macro_auc"))


@register("roc_points", with_sql(CONF_SQL, """, rc AS (SELECT class, prob,
  sum(pos) OVER (PARTITION BY class ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
  sum(neg) OVER (PARTITION BY class ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
  sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n FROM auc_cnt)
SELECT class, prob AS threshold, CASE WHEN p <> 0 THEN CAST(tp AS DOUBLE) / CAST(p AS DOUBLE) END AS tpr,
  CASE WHEN n <> 0 THEN CAST(fp AS DOUBLE) / CAST(n AS DOUBLE) END AS fpr FROM rc"""))
def q_roc_points(spark, d):
    """E8"""
    return M.roc_points(probs_df(spark, d))


@register("auc_binary", with_sql(CONF_SQL, """, bs AS (SELECT id, actual, 1.0::DOUBLE - prob AS s FROM probs WHERE class = 'No Churn'),
bc AS (SELECT s, sum(CASE WHEN actual <> 'No Churn' THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN actual <> 'No Churn' THEN 0 ELSE 1 END) AS neg FROM bs GROUP BY s),
br AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum FROM bc)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
  CAST(sum(pos * (2 * (neg_cum - neg) + neg)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc FROM br"""))
def q_auc_binary(spark, d):
    """Churn vs no churn."""
    return M.auc_binary(probs_df(spark, d))


@register("log_loss", with_sql(CONF_SQL, "SELECT round(log_loss, 12) AS log_loss FROM ll"))
def q_log_loss(spark, d):
    """E10 (reported to 12 dp)."""
    return M.log_loss(probs_df(spark, d)).select(F.round("log_loss", 12).alias("log_loss"))


@register("evaluation_summary", with_sql(CONF_SQL, """, v AS (
  SELECT 'Overall Accuracy' AS metric, (SELECT accuracy FROM overall) AS value
  UNION ALL SELECT 'Cohen''s Kappa', (SELECT kappa FROM overall)
  UNION ALL SELECT 'Macro F1-Score', (SELECT macro_f1 FROM macro)
  UNION ALL SELECT 'Macro AUC', (SELECT avg(auc) FROM auc)
  UNION ALL SELECT 'Log Loss', (SELECT log_loss FROM ll))
SELECT metric, round(value, 10) AS value, CASE WHEN metric = 'Overall Accuracy'
  THEN CAST(round(value * 100.0::DOUBLE, 2) AS VARCHAR) || '%' ELSE CAST(round(value, 4) AS VARCHAR) END AS display FROM v"""))
def q_evaluation_summary(spark, d):
    """Five metric rows (value to 10 dp, display as printed)."""
    preds, p = eval_frames(spark, d)
    conf = materialize(M.confusion_long(preds), "confusion")       # K x K rows, read twice
    s = M.evaluation_summary(M.overall_metrics(conf), M.macro_metrics(M.per_class_metrics(conf)),
                             M.macro_auc(M.auc_ovr(p)), M.log_loss(p))
    return s.select("metric", F.round("value", 10).alias("value"), "display")


@register("fold_accuracy", with_sql(PROBS_SQL, """, f AS (SELECT id, CAST((row_number() OVER (PARTITION BY target
  ORDER BY md5(CAST(id AS VARCHAR) || ':' || '123:folds'), id) - 1) % 5 + 1 AS INTEGER) AS fold FROM mdl)
SELECT fold, count(*) AS n, round(avg(CASE WHEN predicted = actual THEN 1.0 ELSE 0.0 END), 12) AS accuracy
FROM preds JOIN f USING (id) GROUP BY fold"""))
def q_fold_accuracy(spark, d):
    """Accuracy of the pseudo predictions per stratified fold."""
    m = S.stratified_folds(modeling_table(spark, d))
    v = with_class_probabilities(m).select("fold", F.col("target").alias("actual"), "predicted")
    return M.fold_accuracy(v, ["fold"]).select("fold", "n", F.round("accuracy", 12).alias("accuracy"))
