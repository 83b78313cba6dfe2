"""Target definition and cohort split."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.functions.nulls import not_in

# Label vocabulary of the analysis.
NO_CHURN = "No Churn"
RECENTLY_JOINED = "Recently Joined"
UNKNOWN = "Unknown"
STATUS_STAYED, STATUS_CHURNED, STATUS_JOINED = "Stayed", "Churned", "Joined"


def label_fill(df: DataFrame, cols: Iterable[str], value: str = NO_CHURN) -> DataFrame:
    """Null label/reason columns become ``value``."""
    present = [c for c in cols if c in df.columns]
    return df.fillna(value, subset=present) if present else df


def multi_state_label(df: DataFrame, status: str = "status", reason: str = "churn_category",
                      out: str = "target") -> DataFrame:
    """Stayed -> No Churn, Churned -> its reason, Joined -> Recently
    Joined, anything else (null included) -> Unknown."""
    s = F.col(status)
    label = (F.when(s == STATUS_STAYED, F.lit(NO_CHURN))
             .when(s == STATUS_CHURNED, F.col(reason))
             .when(s == STATUS_JOINED, F.lit(RECENTLY_JOINED))
             .otherwise(F.lit(UNKNOWN)))
    return df.withColumn(out, label)


def cohort_new(df: DataFrame, label: str = "target") -> DataFrame:
    """The recently joined customers, scored later but never trained on."""
    return df.filter(F.col(label) == RECENTLY_JOINED)


def cohort_model(df: DataFrame, label: str = "target",
                 exclude: Iterable[str] = (RECENTLY_JOINED, UNKNOWN)) -> DataFrame:
    """The modelling cohort; a null label is kept (R ``!%in%``)."""
    return df.filter(not_in(F.col(label), list(exclude)))


def labeled(df: DataFrame, status: str = "status", reason: str = "churn_category",
            out: str = "target") -> DataFrame:
    """P1 then P2 as in the analysis: fill the reason, then label."""
    return multi_state_label(label_fill(df, [reason]), status, reason, out)
