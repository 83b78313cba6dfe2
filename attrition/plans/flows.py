"""End-to-end flows of the analysis on Spark.

Flow 1 (training): label -> modelling cohort -> rule fills -> PMM
imputation -> phone/lines cleanup -> winsorising -> derived features ->
single-level drop -> exact stratified split -> nested CV over alpha (forest
selection once per fold, class weights, lambda search) -> final model.
Flow 2 (evaluation): predictions on the test part -> confusion, metrics,
AUC, log loss, coefficients -> score frame -> risk levels.
Flow 3 (new cohort): the recently joined customers through the same fills,
features, fitted design and model, scored with the new-cohort multiplier.

``train`` runs on any customer table whose columns a ``Roles`` names;
``training_flow`` runs it on the snapshot of the given tables and keeps the
result for the application, so several registered queries share one fit.
The driver only loops over hyper-parameters and folds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.operators import cleaning as C
from attrition.operators import features as FE
from attrition.operators import interpret as IN
from attrition.operators import labels as L
from attrition.operators import metrics as M
from attrition.operators import modeling as MD
from attrition.operators import split as S
from attrition.operators.impute import impute_pmm
from attrition.operators.outliers import winsor_bounds, winsorize
from attrition.operators.risk import PAYMENT_RULE, base_risk, risk_summary, score_new_cohort, score_risk
from attrition.plans.base import ADDONS, LINES, PHONE, PROTECTION, SNAP_PAYMENT_RULE, STREAMING
from attrition.session import materialize
from attrition.sources.csv import infer_numeric, scan_csv
from attrition.sources.fixtures import snap
from attrition.sources.sinks import sink_csv

IMPUTE_TARGETS = ("population", "n_lines", "qty", "disc")
IMPUTE_PREDICTORS = ("tenure", "charge", "total_charges", "age")
CAP_COLS = ("tenure", "charge", "total_charges", "qty", "disc", "n_lines", "population", "age")
EXCLUDE = ("id", "target", "status", "churn_category", "zip_code")


@dataclass(frozen=True)
class Roles:
    """Which columns of a customer table play which part; the defaults are the
    headers of the analysis' own table in snake_case.  Of ``targets``,
    ``predictors`` and ``caps`` None means: number columns with nulls, those
    without, and all of them (identifiers and labels left out).  Columns that
    play no part and are null in more than ``sparse_pct`` percent of the rows
    are dropped (None: all stay)."""
    id: str = "customer_id"
    status: str = "customer_status"
    reason: str = "churn_category"
    tenure: str = "tenure_in_months"
    charge: str = "monthly_charge"
    total: str = "total_charges"
    age: str = "age"
    contract: str = "contract"
    payment: str = "payment_method"
    phone: str = "phone_service"
    lines: str = "multiple_lines"
    zip_code: str = "zip_code"
    addons: tuple = FE.ADDON_SERVICES
    streaming: tuple = FE.STREAMING_SERVICES
    protection: tuple = FE.PROTECTION_SERVICES
    targets: tuple | None = None
    predictors: tuple | None = None
    caps: tuple | None = None
    exclude: tuple = ("customer_id", "target", "customer_status", "churn_category", "churn_reason", "churn_label", "zip_code")
    payment_rule: tuple = field(default=PAYMENT_RULE)
    sparse_pct: float | None = 50.0

    def named(self) -> set[str]:
        return {self.id, self.status, self.reason, self.tenure, self.charge, self.total, self.age, self.contract,
                self.payment, self.phone, self.lines, "target", *self.addons, *self.streaming, *self.protection,
                *(self.targets or ()), *(self.predictors or ()), *(self.caps or ())}


SNAP_ROLES = Roles(id="id", status="status", tenure="tenure", charge="charge", payment="payment", phone=PHONE, lines=LINES,
                   addons=ADDONS, streaming=STREAMING, protection=PROTECTION, targets=IMPUTE_TARGETS,
                   predictors=IMPUTE_PREDICTORS, caps=CAP_COLS, exclude=EXCLUDE, payment_rule=SNAP_PAYMENT_RULE, sparse_pct=None)

# The whole search, which the registered queries run; tests pass a smaller one.
WHOLE = MD.ModelConfig()
IMPUTE_ITERATIONS = 5


def read_customers(spark: SparkSession, customers: str, zip_codes: str | None = None, roles: Roles = Roles()) -> DataFrame:
    """The customer table from CSV, headers in snake_case, numbers where every
    value is one; joined with the CSV of zip codes where one is given (a
    repeated zip code counts once, by its smallest values).  A missing column
    among those that the flow reads is an error."""
    df = infer_numeric(scan_csv(spark, customers, snake_case=True))
    missing = [c for c in (roles.id, roles.status, roles.reason, roles.tenure, roles.charge, roles.total, roles.age,
                           roles.contract, roles.payment) if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    if zip_codes is None:
        return df
    z = infer_numeric(scan_csv(spark, zip_codes, snake_case=True))
    z = z.groupBy(roles.zip_code).agg(*[F.min(c).alias(c if c not in df.columns else f"{c}_zip")
                                        for c in z.columns if c != roles.zip_code])
    return df.join(z, roles.zip_code, "left").select(*df.columns, *[c for c in z.columns if c != roles.zip_code])


def number_columns(df: DataFrame, roles: Roles) -> tuple[list[str], list[str]]:
    """Number columns with nulls (some values known), and those without."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in roles.exclude]
    if not names:
        return [], []
    row = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in names]).first()
    return [c for c in names if 0 < row[c] < row["_rows"]], [c for c in names if row[c] == row["_rows"]]


def prepare(df: DataFrame, bounds: dict | None = None, impute_iter: int = 5,
            roles: Roles = SNAP_ROLES) -> tuple[DataFrame, dict]:
    """Rule fills, imputation, cleanup, capping, derived features."""
    d = C.conditional_fill(df, roles.total, roles.tenure, 0, 0.0)
    d = materialize(C.service_fill(d, roles.addons), "filled")
    targets, predictors = roles.targets, roles.predictors
    if targets is None or predictors is None:
        with_nulls, whole = number_columns(d, roles)
        targets, predictors = targets or with_nulls, predictors or whole
    if targets:
        d = impute_pmm(d, roles.id, targets, predictors, max_iter=impute_iter)
    if roles.phone in d.columns and roles.lines in d.columns:
        d = C.lines_to_binary(d, roles.phone, roles.lines)
    if bounds is None:
        bounds = winsor_bounds(d, roles.caps or [c for part in number_columns(d, roles) for c in part])
    d = winsorize(d, [c for c in bounds if c in d.columns], bounds=bounds)
    d = C.relabel_contract(d, roles.contract)
    d = FE.derive_features(d, tenure=roles.tenure, total=roles.total, monthly=roles.charge, age=roles.age,
                           contract=roles.contract, addons=roles.addons, streaming=roles.streaming,
                           protection=roles.protection)
    return d, bounds


@dataclass
class Training:
    prepared: DataFrame
    train: DataFrame
    test: DataFrame
    new: DataFrame
    classes: list
    results: DataFrame
    cv_preds: DataFrame
    curves: DataFrame
    paths: DataFrame
    best_alpha: float
    fitted: MD.FittedModel
    bounds: dict
    roles: Roles


def train(customers: DataFrame, cfg: MD.ModelConfig = WHOLE, roles: Roles = Roles(),
          impute_iter: int = IMPUTE_ITERATIONS) -> Training:
    """Flow 1 on any customer table."""
    lab = L.labeled(customers, roles.status, roles.reason)
    cohort = materialize(L.cohort_model(lab), "cohort")
    if roles.sparse_pct is not None:
        cohort = cohort.drop(*[c for c in C.sparse_columns(cohort, roles.sparse_pct) if c not in roles.named()])
    prepared, bounds = prepare(cohort, None, impute_iter, roles)
    prepared = materialize(C.drop_single_level(prepared), "prepared")
    many = too_many_labels(prepared, cfg.max_levels)
    if many:
        raise ValueError(f"the label has {many} levels, more than {cfg.max_levels}")
    split = materialize(S.stratified_split(prepared, id_col=roles.id), "split")
    tr, te = split.filter("is_train").drop("is_train"), split.filter("NOT is_train").drop("is_train")
    classes = sorted(r[0] for r in tr.select("target").distinct().collect() if r[0] is not None)
    candidates = [c for c in tr.columns if c not in roles.exclude]
    grid = MD.grid_search(tr, "target", candidates, classes, cfg, roles.id)
    results, cv_preds = materialize(grid.results, "cv-results"), grid.predictions
    curves = materialize(grid.curves, "cv-curves")
    best = MD.best_alpha(MD.alpha_summary(results)).first()["alpha"]
    fitted = MD.fit_final(tr, "target", grid.selected, classes, best, cfg, roles.id)
    return Training(prepared, tr, te, L.cohort_new(lab), classes, results, cv_preds, curves, grid.paths, best, fitted, bounds, roles)


def too_many_labels(df: DataFrame, most: int) -> int:
    """Number of labels where there are more than ``most``, else 0."""
    n = df.agg(F.approx_count_distinct("target", 0.01)).first()[0]
    return n if n > most * 1.1 else 0


_CACHE: dict = {}


def training_flow(spark: SparkSession, sf_dir: str, cfg: MD.ModelConfig = WHOLE) -> Training:
    """Flow 1 on the snapshot of the given tables, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, repr(cfg))
    if key not in _CACHE:
        _CACHE[key] = train(snap(spark, sf_dir), cfg, SNAP_ROLES, IMPUTE_ITERATIONS)
    return _CACHE[key]


def score_test(t: Training) -> DataFrame:
    """The score frame of the test part (actual, predicted, class
    probabilities, attributes, multipliers, composite score, level)."""
    r = t.roles
    p = MD.predict(t.fitted, t.test, r.id, keep=["target", r.tenure, r.charge, r.contract, r.payment])
    p = p.withColumn("base_risk", base_risk(F.col("classes"), F.col("probs")))
    return score_risk(p, tenure=r.tenure, contract=r.contract, payment=r.payment,
                      payment_rule=r.payment_rule).withColumnRenamed("target", "actual")


def score_new(t: Training, impute_iter: int = 5) -> DataFrame:
    """Recently joined customers through the training fills, the
    training caps, the fitted design and model; new-cohort multiplier."""
    r = t.roles
    new, _ = prepare(t.new, t.bounds, impute_iter, r)
    p = MD.predict(t.fitted, new, r.id, keep=[r.tenure, r.charge, r.contract, r.payment])
    p = p.withColumn("base_risk", base_risk(F.col("classes"), F.col("probs")))
    return score_new_cohort(p, tenure=r.tenure, contract=r.contract, payment=r.payment, payment_rule=r.payment_rule)


def test_scores(spark: SparkSession, sf_dir: str, cfg: MD.ModelConfig = WHOLE) -> DataFrame:
    return score_test(training_flow(spark, sf_dir, cfg))


def new_cohort_scores(spark: SparkSession, sf_dir: str, cfg: MD.ModelConfig = WHOLE) -> DataFrame:
    return score_new(training_flow(spark, sf_dir, cfg), IMPUTE_ITERATIONS)


def evaluate(scores: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Flow 2: (per-class metrics, the five summary metrics) of a score frame.
    Rows without a prediction count as wrong."""
    preds = scores.select("actual", F.coalesce("predicted", F.lit("(none)")).alias("predicted"))
    probs = (scores.where("probs IS NOT NULL").select(id_col, "actual", F.explode(F.arrays_zip("classes", "probs")).alias("_p"))
             .select(F.col(id_col).alias("id"), "actual", F.col("_p.classes").alias("class"), F.col("_p.probs").alias("prob")))
    conf = materialize(M.confusion_long(preds), "confusion")
    per_class = M.per_class_metrics(conf)
    return per_class, M.evaluation_summary(M.overall_metrics(conf), M.macro_metrics(per_class),
                                           M.macro_auc(M.auc_ovr(probs)), M.log_loss(probs))


def export_results(t: Training, path: str) -> None:
    """The model bundle, the CV results and the six result tables (CSV with a
    header) under ``path``."""
    scores = materialize(score_test(t), "test-scores")
    per_class, summary = evaluate(scores, t.roles.id)
    MD.save_model(t.fitted, f"{path}/model", t.bounds)
    tables = {"cv_results": t.results,
              "test_results_with_risk_scores": scores.drop("classes", "probs"),
              "recently_joined_risk_scores": score_new(t).drop("classes", "probs"),
              "model_coefficients": IN.odds_ratios(MD.coef_long(t.fitted)),
              "per_class_metrics": per_class,
              "metrics_summary": summary,
              "risk_summary": risk_summary(scores, t.roles.charge, t.roles.tenure)}
    for name, table in tables.items():
        sink_csv(table, f"{path}/{name}")
