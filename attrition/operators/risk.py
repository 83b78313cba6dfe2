"""Business risk scoring and roll-ups.

A score frame has one row per customer with ``base_risk`` (1 - P(no
churn)), tenure, monthly charge, contract and payment method.  Scores are
row expressions; every roll-up is one aggregation over the score frame.
Money is summed as decimal(18,2) so totals are exact and order-free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.functions.exprs import cut_right_closed
from attrition.functions.nulls import in_set, pmin
from attrition.operators.features import TENURE_LABELS, tenure_segment
from attrition.operators.metrics import level_grid

# The scoring rules of the analysis.
TENURE_RULES = ((6, 1.4), (12, 1.2), (24, 1.1))   # tenure < bound -> multiplier, else 1.0
CONTRACT_RULE = ("Month to Month", 1.3)
PAYMENT_RULE = (("Bank withdrawal", "Mailed check"), 1.1)
NEW_COHORT_TENURE_MULTIPLIER = 1.5
RISK_BREAKS = (0.0, 0.25, 0.5, 0.75, 1.0)
RISK_LEVELS = ("Low", "Medium", "High", "Critical")
HIGH_LEVELS = ("High", "Critical")
ANNUAL_MONTHS = 12
BUDGET_SHARE = 0.15
# The action framework per risk level.
ACTIONS = (
    ("Low", " Low (0-25%)", "Quarterly satisfaction surveys, loyalty rewards program", "Quarterly", "Low"),
    ("Medium", " Medium (25-50%)", "Monthly check-ins, personalized service recommendations", "Monthly", "Medium"),
    ("High", " High (50-75%)", "Bi-weekly proactive outreach, special retention offers", "Bi-weekly", "High"),
    ("Critical", " Critical (75-100%)", "IMMEDIATE executive intervention, dedicated account manager",
     "Weekly", "Maximum"),
)


def base_risk(classes: Column, probs: Column, reference: str = "No Churn") -> Column:
    """B1: 1 - P(reference) from aligned class/probability arrays; when the
    reference class is absent, the sum of all probabilities (as the
    reference does)."""
    pos = F.array_position(classes, reference)
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    return F.when(pos > 0, F.lit(1.0) - F.element_at(probs, pos.cast("int"))).otherwise(total)


def tenure_multiplier(tenure: Column, rules=TENURE_RULES) -> Column:
    expr = None
    for bound, m in rules:
        cond = tenure < bound
        expr = F.when(cond, F.lit(m)) if expr is None else expr.when(cond, F.lit(m))
    return expr.otherwise(F.lit(1.0))


def contract_multiplier(contract: Column, rule=CONTRACT_RULE) -> Column:
    return F.when(contract == rule[0], F.lit(rule[1])).otherwise(F.lit(1.0))


def payment_multiplier(payment: Column, rule=PAYMENT_RULE, exact: bool = False) -> Column:
    """Payment rule; by default case-insensitive, because the rule's
    "Mailed check" never equals the data level "Mailed Check" exactly
    (``exact=True`` reproduces the reference's exact match)."""
    values, m = rule
    if exact:
        hit = in_set(payment, values)
    else:
        hit = in_set(F.lower(payment), [v.lower() for v in values])
    return F.when(hit, F.lit(m)).otherwise(F.lit(1.0))


def risk_category(score: Column) -> Column:
    """[0,.25] Low, (.25,.5] Medium, (.5,.75] High, (.75,1] Critical."""
    return cut_right_closed(score, RISK_BREAKS, RISK_LEVELS)


def score_risk(df: DataFrame, *, base: str = "base_risk", tenure: str = "tenure",
               contract: str = "contract", payment: str = "payment",
               payment_rule=PAYMENT_RULE, exact_payment: bool = False,
               fixed_tenure_multiplier: float | None = None) -> DataFrame:
    """B2-B4 (and B5 with ``fixed_tenure_multiplier``): multipliers,
    composite score min(product, 1) with nulls propagating, risk level."""
    tm = (F.lit(fixed_tenure_multiplier) if fixed_tenure_multiplier is not None
          else tenure_multiplier(F.col(tenure)))
    d = df.select("*", tm.alias("tenure_multiplier"),
                  contract_multiplier(F.col(contract)).alias("contract_multiplier"),
                  payment_multiplier(F.col(payment), payment_rule, exact_payment).alias("payment_multiplier"))
    comp = pmin(F.col(base) * F.col("tenure_multiplier") * F.col("contract_multiplier")
                * F.col("payment_multiplier"), F.lit(1.0))
    d = d.withColumn("composite_risk_score", comp)
    return d.withColumn("risk_category", risk_category(F.col("composite_risk_score")))


def score_new_cohort(df: DataFrame, **kw) -> DataFrame:
    """New-cohort scoring; tenure multiplier fixed at 1.5."""
    return score_risk(df, fixed_tenure_multiplier=NEW_COHORT_TENURE_MULTIPLIER, **kw)


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _share(count: Column) -> Column:
    from pyspark.sql import Window
    return count.cast("double") * F.lit(100.0) / F.sum(count).over(Window.partitionBy()).cast("double")


def risk_summary(scored: DataFrame, charge: str = "charge", tenure: str = "tenure",
                 with_tenure: bool = True, digits: int = 10) -> DataFrame:
    """Per risk level count, percent, mean and total monthly revenue,
    mean tenure, mean composite score."""
    aggs = [F.count(F.lit(1)).alias("count"),
            F.sum(_money(charge)).alias("_rev"), F.count(charge).alias("_nrev"),
            F.round(F.avg("composite_risk_score"), digits).alias("avg_risk_score")]
    if with_tenure:
        aggs += [F.sum(tenure).alias("_ten"), F.count(tenure).alias("_nten")]
    g = scored.groupBy("risk_category").agg(*aggs)
    cols = ["risk_category", F.col("count").cast("bigint").alias("count"),
            _share(F.col("count")).alias("percentage"),
            (F.col("_rev").cast("double") / F.col("_nrev").cast("double")).alias("avg_monthly_revenue")]
    if with_tenure:
        cols.append((F.col("_ten").cast("double") / F.col("_nten").cast("double")).alias("avg_tenure"))
    cols += [F.col("_rev").cast("double").alias("total_monthly_revenue"), "avg_risk_score"]
    return g.select(*cols)


def revenue_at_risk(scored: DataFrame, charge: str = "charge") -> DataFrame:
    """One row of executive figures: customers, high-risk count and
    percent, mean revenue, monthly / annual revenue at risk, budget."""
    high = in_set(F.col("risk_category"), HIGH_LEVELS)
    g = scored.agg(F.count(F.lit(1)).alias("total_customers"),
                   F.count_if(high).alias("high_risk_customers"),
                   F.sum(_money(charge)).alias("_rev"), F.count(charge).alias("_nrev"),
                   F.sum(F.when(high, _money(charge))).alias("_risk"))
    annual = F.col("_risk") * F.lit(ANNUAL_MONTHS)
    return g.select(
        F.col("total_customers").cast("bigint").alias("total_customers"),
        F.col("high_risk_customers").cast("bigint").alias("high_risk_customers"),
        (F.col("high_risk_customers").cast("double") * F.lit(100.0)
         / F.col("total_customers").cast("double")).alias("high_risk_pct"),
        (F.col("_rev").cast("double") / F.col("_nrev").cast("double")).alias("avg_monthly_revenue"),
        F.coalesce(F.col("_risk"), F.lit(0)).cast("double").alias("monthly_revenue_at_risk"),
        F.coalesce(annual, F.lit(0)).cast("double").alias("annual_revenue_at_risk"),
        F.coalesce(annual * F.lit(BUDGET_SHARE).cast("decimal(3,2)"), F.lit(0)).cast("double")
        .alias("recommended_budget"))


def complete_grid(df: DataFrame, dims: dict[str, Sequence[str]], fill: dict) -> DataFrame:
    """Add every missing combination of the given fixed levels with
    ``fill`` values (R ``tidyr::complete``); the grid is generated."""
    grid = level_grid(df.sparkSession, **{k: F.array(*[F.lit(v) for v in vals]) for k, vals in dims.items()})
    keys = list(dims)
    j = grid.join(df, keys, "left")
    return j.select(*keys, *[F.coalesce(F.col(c), F.lit(v)).cast(df.schema[c].dataType).alias(c)
                             for c, v in fill.items()])


def segment_risk(scored: DataFrame, tenure: str = "tenure", charge: str = "charge",
                 digits: int = 10) -> DataFrame:
    """A10: tenure segment x risk level: count, mean score, revenue, over the
    complete 4 x 4 grid (absent cells zero)."""
    g = (scored.withColumn("tenure_segment", tenure_segment(F.col(tenure)))
         .groupBy("tenure_segment", "risk_category")
         .agg(F.count(F.lit(1)).cast("bigint").alias("count"),
              F.round(F.avg("composite_risk_score"), digits).alias("avg_risk"),
              F.sum(_money(charge)).cast("double").alias("total_revenue")))
    return complete_grid(g, {"tenure_segment": TENURE_LABELS, "risk_category": RISK_LEVELS},
                         {"count": 0, "avg_risk": 0.0, "total_revenue": 0.0})


def high_risk_share(scored: DataFrame, tenure: str = "tenure", contract: str = "contract",
                    new_months: int = 6, monthly: str = "Month to Month") -> DataFrame:
    """Percent high/critical among new customers and among monthly
    contracts (one pass, conditional means)."""
    flag = in_set(F.col("risk_category"), HIGH_LEVELS).cast("double") * F.lit(100.0)
    return scored.agg(
        F.avg(F.when(F.col(tenure) < new_months, flag)).alias("new_customer_high_risk_pct"),
        F.avg(F.when(F.col(contract) == monthly, flag)).alias("monthly_contract_high_risk_pct"))


def high_risk_share_by(scored: DataFrame, by: str = "payment") -> DataFrame:
    """Percent high/critical and count per group, highest first."""
    flag = in_set(F.col("risk_category"), HIGH_LEVELS).cast("double") * F.lit(100.0)
    return (scored.groupBy(by).agg(F.avg(flag).alias("high_risk_pct"),
                                   F.count(F.lit(1)).cast("bigint").alias("count"))
            .orderBy(F.desc("high_risk_pct"), by))


def revenue_by_risk(scored: DataFrame, charge: str = "charge") -> DataFrame:
    """Total monthly revenue per risk level."""
    return scored.groupBy("risk_category").agg(
        F.sum(_money(charge)).cast("double").alias("total_monthly_revenue"))


def risk_share_in_group(scored: DataFrame, group: str = "contract") -> DataFrame:
    """Count per group x level and its share within the group."""
    from pyspark.sql import Window
    g = scored.groupBy(group, "risk_category").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return g.withColumn("share", F.col("count").cast("double")
                        / F.sum("count").over(Window.partitionBy(group)).cast("double"))


def risk_counts(scored: DataFrame) -> DataFrame:
    """Count and percent per risk level."""
    g = scored.groupBy("risk_category").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return g.withColumn("percentage", _share(F.col("count")))


def action_plan(scored: DataFrame) -> DataFrame:
    """The action framework with the customer count per level (levels
    without customers get 0).  The framework is four fixed rows."""
    counts = scored.groupBy("risk_category").agg(F.count(F.lit(1)).cast("bigint").alias("customer_count"))
    rows = F.array(*[F.struct(F.lit(a).alias("risk_category"), F.lit(b).alias("risk_level"),
                              F.lit(c).alias("recommended_actions"), F.lit(d).alias("contact_frequency"),
                              F.lit(e).alias("retention_budget_priority")) for a, b, c, d, e in ACTIONS])
    plan = scored.sparkSession.range(1).select(F.explode(rows).alias("a")).select("a.*")
    # counts has one row per risk level (at most five): broadcast.
    return (plan.join(F.broadcast(counts), "risk_category", "left")
            .withColumn("customer_count", F.coalesce("customer_count", F.lit(0)).cast("bigint")))


def impact_summary(scored: DataFrame, charge: str = "charge", model_info: dict | None = None,
                   performance: DataFrame | None = None) -> DataFrame:
    """One record with model info, performance and business impact;
    each figure is a scalar subquery (no cross join of one-row frames)."""
    biz = revenue_at_risk(scored, charge)
    cols = []
    for k, v in (model_info or {}).items():
        cols.append(F.lit(v).alias(k))
    if performance is not None:
        for c in performance.columns:
            cols.append(F.round(performance.select(c).scalar(), 4).alias(c))
    cols += [biz.select("total_customers").scalar().alias("total_customers"),
             biz.select("high_risk_customers").scalar().alias("high_risk_customers"),
             F.round(biz.select("high_risk_pct").scalar(), 2).alias("high_risk_percentage"),
             F.round(biz.select("monthly_revenue_at_risk").scalar(), 0).alias("monthly_revenue_at_risk"),
             F.round(biz.select("annual_revenue_at_risk").scalar(), 0).alias("annual_revenue_at_risk"),
             F.round(biz.select("recommended_budget").scalar(), 0).alias("recommended_budget")]
    return scored.sparkSession.range(1).select(*cols)
