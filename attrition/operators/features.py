"""Row-level feature derivation (F1-F11).  All pure Column expressions,
so they stay inside whole-stage codegen and work on streams too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions.exprs import cut_right_closed
from attrition.functions.nulls import count_equal, if_else_null

# Service column groups (snake_case names of the analysis).
ADDON_SERVICES = ("online_security", "online_backup", "device_protection_plan",
                  "premium_tech_support", "streaming_tv", "streaming_movies",
                  "streaming_music", "unlimited_data")
STREAMING_SERVICES = ("streaming_tv", "streaming_movies", "streaming_music")
PROTECTION_SERVICES = ("online_security", "online_backup", "device_protection_plan")
MONTHLY = "Month to Month"


def tenure_group(tenure: Column) -> Column:
    """<=6 New, <=24 Growing, <=60 Mature, otherwise (null too) Loyal."""
    return (F.when(tenure <= 6, F.lit("New")).when(tenure <= 24, F.lit("Growing"))
            .when(tenure <= 60, F.lit("Mature")).otherwise(F.lit("Loyal")))


def avg_revenue(total: Column, tenure: Column, monthly: Column) -> Column:
    """total / tenure for tenure > 0, else the monthly charge; null
    tenure gives null (R ``ifelse``)."""
    return if_else_null(tenure > 0, total / tenure, monthly)


def service_count(df: DataFrame, cols: Sequence[str] = ADDON_SERVICES) -> Column:
    """number of "Yes" among the listed columns that exist."""
    return count_equal([F.col(c) for c in cols if c in df.columns], "Yes")


def revenue_tenure_ratio(total: Column, tenure: Column) -> Column:
    """total / tenure for tenure > 0, else 0; null tenure gives null."""
    return if_else_null(tenure > 0, total / tenure, F.lit(0.0))


def any_yes(df: DataFrame, cols: Sequence[str]) -> Column:
    """"Yes" when any listed column is "Yes", else "No"."""
    return F.when(count_equal([F.col(c) for c in cols if c in df.columns], "Yes") > 0,
                  F.lit("Yes")).otherwise(F.lit("No"))


def age_group(age: Column) -> Column:
    """<30 Young, <50 Middle, otherwise (null too) Senior."""
    return F.when(age < 30, F.lit("Young")).when(age < 50, F.lit("Middle")).otherwise(F.lit("Senior"))


def contract_tenure_risk(contract: Column, tenure: Column) -> Column:
    """F8: monthly and tenure < 12 High Risk; monthly Medium Risk; else Low
    Risk (expects relabelled contracts, P10)."""
    monthly = contract == MONTHLY
    return (F.when(monthly & (tenure < 12), F.lit("High Risk"))
            .when(monthly, F.lit("Medium Risk")).otherwise(F.lit("Low Risk")))


# Reporting tenure segments (right-closed, lowest included).
TENURE_BREAKS = (0.0, 6.0, 24.0, 60.0, float("inf"))
TENURE_LABELS = ("New (0-6m)", "Growing (6-24m)", "Mature (24-60m)", "Loyal (60m+)")


def tenure_segment(tenure: Column) -> Column:
    """right-closed bins 0,6,24,60,Inf."""
    return cut_right_closed(tenure, TENURE_BREAKS, TENURE_LABELS)


VALUE_LABELS = ("Economy", "Standard", "Premium")


def value_segment(charge: Column, q0: Column, q33: Column, q67: Column, q100: Column) -> Column:
    """right-closed bins at the 0/33/67/100 percentiles (pass the
    cut points as Columns, e.g. from :func:`outliers.quantile_row`)."""
    return (F.when((charge >= q0) & (charge <= q33), F.lit(VALUE_LABELS[0]))
            .when((charge > q33) & (charge <= q67), F.lit(VALUE_LABELS[1]))
            .when((charge > q67) & (charge <= q100), F.lit(VALUE_LABELS[2])))


def odds_ratio_cols(coef: Column) -> list[Column]:
    """odds ratio, direction text and percent change in odds."""
    o = F.exp(coef)
    return [o.alias("odds_ratio"),
            F.when(coef > 0, F.lit("increases")).otherwise(F.lit("decreases")).alias("direction"),
            F.abs((o - F.lit(1.0)) * F.lit(100.0)).alias("pct_change")]


def derive_features(df: DataFrame, *, tenure: str = "tenure", total: str = "total_charges",
                    monthly: str = "charge", age: str = "age", contract: str = "contract",
                    addons: Sequence[str] = ADDON_SERVICES,
                    streaming: Sequence[str] = STREAMING_SERVICES,
                    protection: Sequence[str] = PROTECTION_SERVICES) -> DataFrame:
    """The analysis' feature block in one projection (F1-F8).  ``contract``
    must already be relabelled (P10)."""
    t = F.col(tenure)
    return df.select(
        "*",
        tenure_group(t).alias("tenure_group"),
        avg_revenue(F.col(total), t, F.col(monthly)).alias("avg_revenue_per_month"),
        service_count(df, addons).alias("service_count"),
        revenue_tenure_ratio(F.col(total), t).alias("revenue_tenure_ratio"),
        any_yes(df, streaming).alias("has_streaming"),
        any_yes(df, protection).alias("has_protection"),
        age_group(F.col(age)).alias("age_group"),
        contract_tenure_risk(F.col(contract), t).alias("contract_tenure_risk"),
    )
