"""Shared inputs of the registered queries and their SQL twins.

``snap`` (fixtures) plays the customer table; ``labeled`` adds the target;
``modeling`` is the cohort the model is built on; ``scored`` carries
pseudo class probabilities (a hash of the key, never model output) through
the risk scoring, so every evaluation and business operator has an exact
SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attrition.operators.cleaning import relabel_contract
from attrition.operators.labels import cohort_model, cohort_new, labeled
from attrition.operators.risk import base_risk, score_new_cohort, score_risk
from attrition.session import materialize
from attrition.sources.fixtures import (SERVICE_COLS, SNAP_SQL, class_probabilities,
                                        class_probabilities_sql, snap, with_class_probabilities)

# snap's six Yes/No part-type flags play the service columns.
ADDONS = SERVICE_COLS
STREAMING = SERVICE_COLS[:3]
PROTECTION = SERVICE_COLS[3:]
PHONE, LINES = "has_standard", "has_economy"
NUMERIC = ("tenure", "charge", "total_charges", "population", "n_lines", "qty", "disc", "age")
# Market segments that play the payment methods the payment rule names.
SNAP_PAYMENT_RULE = (("AUTOMOBILE", "machinery"), 1.1)


def snap_df(spark: SparkSession, d: str) -> DataFrame:
    return snap(spark, d)


def labeled_df(spark: SparkSession, d: str) -> DataFrame:
    return labeled(snap(spark, d))


def modeling_df(spark: SparkSession, d: str) -> DataFrame:
    return cohort_model(labeled_df(spark, d))


def new_cohort_df(spark: SparkSession, d: str) -> DataFrame:
    return cohort_new(labeled_df(spark, d))


def modeling_table(spark: SparkSession, d: str) -> DataFrame:
    """The modelling cohort written once to the shared checkpoint folder:
    queries that read it twice (level list, then rows) do not rebuild the
    snapshot's windows and joins for each read."""
    return materialize(modeling_df(spark, d), "modeling")


def probs_df(spark: SparkSession, d: str) -> DataFrame:
    """Long ``(id, actual, class, prob)`` over the modelling cohort."""
    return class_probabilities(modeling_table(spark, d))


def preds_df(spark: SparkSession, d: str) -> DataFrame:
    v = with_class_probabilities(modeling_table(spark, d))
    return v.select("id", F.col("target").alias("actual"), "predicted")


def eval_frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(preds, long probs) from ONE written modelling cohort."""
    v = with_class_probabilities(modeling_table(spark, d))
    preds = v.select("id", F.col("target").alias("actual"), "predicted")
    probs = (v.select("id", F.col("target").alias("actual"), F.explode(F.arrays_zip("classes", "probs")).alias("_p"))
             .select("id", "actual", F.col("_p.classes").alias("class"), F.col("_p.probs").alias("prob")))
    return preds, probs


def scored_df(spark: SparkSession, d: str) -> DataFrame:
    """Score frame of the modelling cohort: base risk from the probability
    vector, multipliers, composite score, level."""
    m = relabel_contract(modeling_table(spark, d))
    v = with_class_probabilities(m)
    v = v.withColumn("base_risk", base_risk(F.col("classes"), F.col("probs")))
    s = score_risk(v, payment_rule=SNAP_PAYMENT_RULE)
    return s.select("id", F.col("target").alias("actual"), "predicted", "base_risk", "tenure", "charge",
                    "contract", "payment", "tenure_multiplier", "contract_multiplier",
                    "payment_multiplier", "composite_risk_score", "risk_category")


def scored_new_df(spark: SparkSession, d: str) -> DataFrame:
    """B5 score frame of the recently joined cohort (classes of the
    modelling cohort, tenure multiplier fixed)."""
    lab = materialize(labeled_df(spark, d), "labeled")
    m = cohort_model(lab)
    n = relabel_contract(cohort_new(lab))
    v = with_class_probabilities(n, levels_from=m)
    v = v.withColumn("base_risk", base_risk(F.col("classes"), F.col("probs")))
    s = score_new_cohort(v, payment_rule=SNAP_PAYMENT_RULE)
    return s.select("id", "base_risk", "tenure", "charge", "contract", "payment",
                    "tenure_multiplier", "contract_multiplier", "payment_multiplier",
                    "composite_risk_score", "risk_category")


# ---------------------------------------------------------------- SQL twins
LAB_SQL = SNAP_SQL + """,
lab AS (
  SELECT * REPLACE (coalesce(churn_category, 'No Churn') AS churn_category),
    CASE WHEN status = 'Stayed' THEN 'No Churn'
         WHEN status = 'Churned' THEN coalesce(churn_category, 'No Churn')
         WHEN status = 'Joined' THEN 'Recently Joined'
         ELSE 'Unknown' END AS target
  FROM snap),
mdl AS (SELECT * FROM lab WHERE target IS NULL OR target NOT IN ('Recently Joined', 'Unknown')),
newc AS (SELECT * FROM lab WHERE target = 'Recently Joined')"""

RELABEL_SQL = ("CASE contract WHEN 'Month-to-Month' THEN 'Month to Month' WHEN 'One Year' THEN 'One Year' "
               "WHEN 'Two Year' THEN 'Two Year' END")


def _score_sql(src: str, tenure_mult: str) -> str:
    return f"""
  SELECT s.*, least(base_risk * tenure_multiplier * contract_multiplier * payment_multiplier, 1.0::DOUBLE)
      AS composite_risk_score FROM (
    SELECT b.*,
      CAST({tenure_mult} AS DOUBLE) AS tenure_multiplier,
      CAST(CASE WHEN contract = 'Month to Month' THEN 1.3 ELSE 1.0 END AS DOUBLE) AS contract_multiplier,
      CAST(CASE WHEN lower(payment) IN ('automobile', 'machinery') THEN 1.1 ELSE 1.0 END AS DOUBLE)
        AS payment_multiplier
    FROM {src} b) s"""


RISK_CUT_SQL = """CASE WHEN composite_risk_score >= 0 AND composite_risk_score <= 0.25 THEN 'Low'
    WHEN composite_risk_score > 0.25 AND composite_risk_score <= 0.5 THEN 'Medium'
    WHEN composite_risk_score > 0.5 AND composite_risk_score <= 0.75 THEN 'High'
    WHEN composite_risk_score > 0.75 AND composite_risk_score <= 1.0 THEN 'Critical' END"""

TENURE_MULT_SQL = ("CASE WHEN tenure < 6 THEN 1.4 WHEN tenure < 12 THEN 1.2 WHEN tenure < 24 THEN 1.1 "
                   "ELSE 1.0 END")

PROBS_SQL = LAB_SQL + "," + class_probabilities_sql("mdl")

SCORED_SQL = PROBS_SQL + f""",
sbase AS (
  SELECT m.id, m.target AS actual, p.predicted,
    1.0 - (SELECT prob FROM probs q WHERE q.id = m.id AND q.class = 'No Churn') AS base_risk,
    m.tenure, m.charge, {RELABEL_SQL} AS contract, m.payment
  FROM mdl m JOIN preds p ON p.id = m.id),
scomp AS ({_score_sql("sbase", TENURE_MULT_SQL)}),
scored AS (
  SELECT id, actual, predicted, base_risk, tenure, charge, contract, payment, tenure_multiplier,
    contract_multiplier, payment_multiplier, composite_risk_score, {RISK_CUT_SQL} AS risk_category
  FROM scomp)"""

NEWPROBS_SQL = LAB_SQL + "," + class_probabilities_sql("newc", levels_from="mdl", prefix="n_")

SCORED_NEW_SQL = NEWPROBS_SQL + f""",
nbase AS (
  SELECT n.id, 1.0 - (SELECT prob FROM n_probs q WHERE q.id = n.id AND q.class = 'No Churn') AS base_risk,
    n.tenure, n.charge, {RELABEL_SQL} AS contract, n.payment
  FROM newc n),
ncomp AS ({_score_sql("nbase", "1.5")}),
scored_new AS (
  SELECT id, base_risk, tenure, charge, contract, payment, tenure_multiplier, contract_multiplier,
    payment_multiplier, composite_risk_score, {RISK_CUT_SQL} AS risk_category
  FROM ncomp)"""


def with_sql(prefix: str, body: str) -> str:
    return "WITH " + prefix + "\n" + body

# Both cohorts' score frames in one statement (shared label CTEs).
BOTH_SCORED_SQL = SCORED_SQL + SCORED_NEW_SQL[len(LAB_SQL):]
