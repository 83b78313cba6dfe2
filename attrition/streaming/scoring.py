"""Apply the fitted model and the risk rules to a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.operators.modeling import FittedModel, predict
from attrition.operators.risk import PAYMENT_RULE, base_risk, score_new_cohort, score_risk


def score_stream(rows: DataFrame, fitted: FittedModel, *, new_cohort: bool = False,
                 payment_rule=PAYMENT_RULE, keep=("tenure", "charge", "contract", "payment")) -> DataFrame:
    """Predict and score each incoming (prepared) customer row.  Stateless:
    works for batch and streaming DataFrames alike (design expressions,
    ``LogisticRegressionModel.transform``, Column arithmetic)."""
    p = predict(fitted, rows, keep=list(keep))
    p = p.withColumn("base_risk", base_risk(F.col("classes"), F.col("probs")))
    scorer = score_new_cohort if new_cohort else score_risk
    return scorer(p, payment_rule=payment_rule)
