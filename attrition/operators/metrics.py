"""Classification evaluation.

Inputs are a predictions frame ``(actual, predicted)`` and long class
probabilities ``(id, actual, class, prob)``.  Everything is computed from
aggregates: the confusion table has at most K*K rows, the AUC first groups
rows by (class, score) and then takes exact prefix sums with
``bucketed_running`` (no global single-partition sort of raw rows).
"""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.operators.ordering import bucketed_running, with_quantile_bucket

Z95 = 1.959963984540054
LOG_EPS = 1e-15


def _safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null (R gives NaN there)."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def class_levels(preds: DataFrame, actual: str = "actual", predicted: str = "predicted") -> Column:
    """Sorted distinct classes of both columns, as a scalar-subquery array
    (one bounded aggregation)."""
    return preds.agg(F.sort_array(F.array_union(F.collect_set(actual), F.collect_set(predicted)))).scalar()


def level_grid(spark: SparkSession, **dims: Column) -> DataFrame:
    """J6 helper: every combination of the given level arrays, generated by
    ``explode`` (K1*K2 rows, bounded by the level counts; no join)."""
    g = spark.range(1)
    for name, levels in dims.items():
        g = g.select("*", F.explode(levels).alias(name))
    return g.drop("id")


def confusion_long(preds: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``(predicted, actual, count)`` for every pair of levels, zeros included."""
    levels = class_levels(preds, actual, predicted)
    counts = (preds.groupBy(F.col(predicted).alias("predicted"), F.col(actual).alias("actual"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = level_grid(preds.sparkSession, predicted=levels, actual=levels)
    return (grid.join(counts, ["predicted", "actual"], "left")
            .select("predicted", "actual", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def confusion_row_pct(conf: DataFrame) -> DataFrame:
    """Percent of each cell within its predicted row."""
    tot = F.sum("count").over(Window.partitionBy("predicted"))
    return conf.withColumn("row_pct", _safe_div(F.col("count") * F.lit(100.0), tot))


def class_margins(conf: DataFrame) -> DataFrame:
    """Per class: predicted total, actual total, correct (from <= K*K rows)."""
    parts = F.array(
        F.struct(F.col("predicted").alias("class"), F.col("count").alias("pred_n"),
                 F.lit(0).cast("bigint").alias("act_n"),
                 F.when(F.col("predicted") == F.col("actual"), F.col("count")).otherwise(0).cast("bigint")
                 .alias("tp")),
        F.struct(F.col("actual").alias("class"), F.lit(0).cast("bigint").alias("pred_n"),
                 F.col("count").alias("act_n"), F.lit(0).cast("bigint").alias("tp")))
    return (conf.select(F.explode(parts).alias("m")).select("m.*")
            .groupBy("class").agg(F.sum("pred_n").alias("pred_n"), F.sum("act_n").alias("act_n"),
                                  F.sum("tp").alias("tp")))


def overall_metrics(conf: DataFrame) -> DataFrame:
    """N, correct, accuracy and Cohen's kappa."""
    m = class_margins(conf)
    o = m.agg(F.sum("act_n").alias("n"), F.sum("tp").alias("correct"),
              F.sum(F.col("pred_n").cast("double") * F.col("act_n").cast("double")).alias("_pp"))
    n = F.col("n").cast("double")
    acc = F.col("correct").cast("double") / n
    pe = F.col("_pp") / (n * n)
    return o.select(F.col("n").cast("bigint").alias("n"), F.col("correct").cast("bigint").alias("correct"),
                    acc.alias("accuracy"), ((acc - pe) / (F.lit(1.0) - pe)).alias("kappa"))


def accuracy_ci(correct: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion (the reference prints an
    exact binomial interval; Wilson is the documented replacement)."""
    p = correct.cast("double") / n.cast("double")
    nn = n.cast("double")
    z2 = F.lit(z * z)
    denom = F.lit(1.0) + z2 / nn
    centre = (p + z2 / (F.lit(2.0) * nn)) / denom
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / nn + z2 / (F.lit(4.0) * nn * nn)) / denom
    return centre - half, centre + half


def exact_interval(correct: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval of ``correct`` out of ``n``: the rates at which
    as many or more, and as many or fewer, have probability (1 - level) / 2.
    Two counts of a one-row result, so it runs on the driver."""
    tail = (1 - level) / 2

    def at_least(k: int, p: float) -> float:
        if k <= 0 or p >= 1:
            return 1.0
        if p <= 0:
            return 0.0
        logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1))
        return math.fsum(map(math.exp, logs))

    def solve(k: int, goal: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if at_least(k, mid) < goal else (lo, mid)
        return (lo + hi) / 2

    return (0.0 if correct == 0 else solve(correct, tail),
            1.0 if correct == n else solve(correct + 1, 1 - tail))


def per_class_metrics(conf: DataFrame) -> DataFrame:
    """E5: sensitivity, specificity, precision, F1, balanced accuracy per class
    (one-vs-rest from the confusion margins; 0/0 gives null)."""
    m = class_margins(conf)
    n = F.sum("act_n").over(Window.partitionBy())
    tp, pred_n, act_n = F.col("tp"), F.col("pred_n"), F.col("act_n")
    fp, fn = pred_n - tp, act_n - tp
    tn = n - tp - fp - fn
    sens = _safe_div(tp, tp + fn)
    spec = _safe_div(tn, tn + fp)
    prec = _safe_div(tp, tp + fp)
    d = m.select("class", sens.alias("sensitivity"), spec.alias("specificity"), prec.alias("precision"))
    f1 = F.when((F.col("precision") + F.col("sensitivity")) > 0,
                F.lit(2.0) * F.col("precision") * F.col("sensitivity")
                / (F.col("precision") + F.col("sensitivity")))
    return d.withColumn("f1_score", f1) \
            .withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / F.lit(2.0))


def macro_metrics(per_class: DataFrame) -> DataFrame:
    """Means over classes, nulls skipped."""
    return per_class.agg(F.avg("precision").alias("macro_precision"),
                         F.avg("sensitivity").alias("macro_recall"),
                         F.avg("f1_score").alias("macro_f1"))


def _auc_from_counts(counts: DataFrame, keys: Sequence[str], score: str, buckets: int) -> DataFrame:
    """AUC per key from ``(keys, score, pos, neg)`` rows: the exact
    Mann-Whitney form with average ties, sum(pos * (2*neg_below + neg)) /
    (2 P N), all in integers until the final division.  Prefix sums run in
    (key, score-quantile bucket) partitions, so they stay balanced however
    the scores bunch up."""
    counts = with_quantile_bucket(counts, score, "_sb", buckets)
    run = bucketed_running(counts, keys, F.col("_sb"), [score],
                           sums={"_neg_cum": F.col("neg")}).drop("_sb")
    term = F.col("pos") * (F.lit(2) * (F.col("_neg_cum") - F.col("neg")) + F.col("neg"))
    agg = run.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                                 F.sum(term).alias("_s2"))
    return agg.select(*keys, "n_pos", "n_neg",
                      F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("_s2").cast("double")
                             / (F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
                      .alias("auc"))


def auc_ovr(probs: DataFrame, buckets: int = 1024) -> DataFrame:
    """One-vs-rest AUC per class from long probabilities; the class's
    own probability is the score (no automatic direction flip)."""
    is_pos = (F.col("actual") == F.col("class")).cast("bigint")
    counts = (probs.groupBy("class", "prob")
              .agg(F.sum(is_pos).alias("pos"), F.sum(F.lit(1) - is_pos).alias("neg")))
    return _auc_from_counts(counts, ["class"], "prob", buckets)


def macro_auc(auc: DataFrame) -> DataFrame:
    return auc.agg(F.avg("auc").alias("macro_auc"))


def roc_points(probs: DataFrame, buckets: int = 1024) -> DataFrame:
    """Per class and distinct score s (the threshold), the true and false
    positive rates of "score >= s" (curve data)."""
    is_pos = (F.col("actual") == F.col("class")).cast("bigint")
    counts = (probs.groupBy("class", "prob")
              .agg(F.sum(is_pos).alias("pos"), F.sum(F.lit(1) - is_pos).alias("neg")))
    counts = with_quantile_bucket(counts, "prob", "_sb", buckets)
    run = bucketed_running(counts, ["class"], -F.col("_sb"),
                           [F.desc("prob")], sums={"tp": F.col("pos"), "fp": F.col("neg")})
    # One row per class, so it is broadcast; a window over all points of a
    # class would bring them into one task.
    tot = counts.groupBy(F.col("class").alias("_c")).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return (run.join(F.broadcast(tot), F.col("class").eqNullSafe(F.col("_c")))
            .select("class", F.col("prob").alias("threshold"), _safe_div(F.col("tp"), F.col("_p")).alias("tpr"),
                    _safe_div(F.col("fp"), F.col("_n")).alias("fpr")))


def churn_scores(probs: DataFrame, reference: str = "No Churn") -> DataFrame:
    """``(id, actual, churn_score)``: 1 - P(reference class) (B1 / E9 score)."""
    return (probs.filter(F.col("class") == reference)
            .select("id", "actual", (F.lit(1.0) - F.col("prob")).alias("churn_score")))


def auc_binary(probs: DataFrame, reference: str = "No Churn", buckets: int = 1024) -> DataFrame:
    """Churn (any class but ``reference``) vs no churn, scored by
    1 - P(reference)."""
    s = churn_scores(probs, reference)
    is_pos = (F.col("actual") != reference).cast("bigint")
    counts = (s.groupBy(F.lit("churn").alias("task"), "churn_score")
              .agg(F.sum(is_pos).alias("pos"), F.sum(F.lit(1) - is_pos).alias("neg")))
    return _auc_from_counts(counts, ["task"], "churn_score", buckets).drop("task")


def log_loss(probs: DataFrame, eps: float = LOG_EPS) -> DataFrame:
    """Mean of -log(p(true class)), p clipped to [eps, 1-eps]."""
    p = F.greatest(F.least(F.col("prob"), F.lit(1.0 - eps)), F.lit(eps))
    return (probs.filter(F.col("class") == F.col("actual"))
            .agg(F.avg(-F.log(p)).alias("log_loss")))


def evaluation_summary(overall: DataFrame, macro: DataFrame, mauc: DataFrame, ll: DataFrame) -> DataFrame:
    """Five (metric, value, display) rows; accuracy shown as a percent.
    Each input is one row and turns into its own rows: none is read twice."""
    def rows(one: DataFrame, **named: str) -> DataFrame:
        return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"))
                                              for c, m in named.items()])).alias("r")).select("r.*")

    found = (rows(overall, accuracy="Overall Accuracy", kappa="Cohen's Kappa").unionByName(rows(macro, macro_f1="Macro F1-Score"))
             .unionByName(rows(mauc, macro_auc="Macro AUC")).unionByName(rows(ll, log_loss="Log Loss")))
    value = F.col("value")
    percent = F.concat(F.round(value * F.lit(100.0), 2).cast("string"), F.lit("%"))
    return found.withColumn("display", F.when(F.col("metric") == "Overall Accuracy", percent)
                            .otherwise(F.round(value, 4).cast("string")))


def fold_accuracy(preds: DataFrame, by: Sequence[str] = (), actual: str = "actual",
                  predicted: str = "predicted") -> DataFrame:
    """Share of rows with predicted == actual, per group."""
    hit = (F.col(predicted) == F.col(actual)).cast("double")
    return preds.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))
