"""Class-weighted elastic-net multinomial models.

Spark ML's ``LogisticRegression(family="multinomial")`` minimises the same
objective form as the reference's solver: weighted mean log-loss +
lambda * ((1 - alpha)/2 * ||B||^2 + alpha * ||B||_1), without internal
standardisation (the design is scaled explicitly, L6).  The searches run in
shared passes (:mod:`attrition.operators.path`); the final model is fitted by
Spark ML at the alpha and lambda that they choose.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attrition.operators import path as PA
from attrition.operators import split as S
from attrition.operators.encode import Design, assemble, fit_design
from attrition.operators.forest import forests
from attrition.operators.selection import cumulative_select, within_levels
from attrition.session import materialize, shared_folder
from attrition.sources.sinks import sink_model


@dataclass
class ModelConfig:
    """Knobs of the nested search; the defaults are the analysis' own: eleven
    alphas, five outer and five inner folds, ten folds for the final model's
    lambda, 100 trees, 100 lambdas."""
    alphas: tuple = tuple(i / 10 for i in range(11))
    folds: int = 5
    inner_folds: int = 5
    final_folds: int = 10
    n_lambdas: int = 100
    lambda_ratio: float = 1e-3
    max_iter: int = 100
    tol: float = 1e-5               # how far from the optimality conditions a path's models may be
    parallelism: int = 4            # outer folds whose designs are fitted at once
    seed: int = 123
    share: float = 0.95
    num_trees: int = 100
    min_leaf: int = 50
    max_leaves: int = 50
    max_levels: int = 53
    ledger: str | None = None       # folder of the search ledger; None: under spark.checkpoint.dir


def with_label_index(df: DataFrame, label: str, classes: Sequence[str], out: str = "label") -> DataFrame:
    """Class index in the sorted level list (R factor order)."""
    arr = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out, (F.array_position(arr, F.col(label)) - 1).cast("double"))


def elastic_net(alpha: float, lam: float, max_iter: int = 100) -> LogisticRegression:
    """The estimator."""
    return LogisticRegression(family="multinomial", elasticNetParam=float(alpha), regParam=float(lam),
                              standardization=False, fitIntercept=True, weightCol="weight",
                              labelCol="label", featuresCol="features", maxIter=max_iter, tol=1e-6)


def select_features(train: DataFrame, label: str, candidates: Sequence[str], cfg: ModelConfig, parts: Sequence[Column] = (),
                    id_col: str | None = None) -> list[list[str]]:
    """For each part of the rows (conditions; none: all): forest importance on
    the candidates that pass the cardinality guard, then the cumulative-share
    prefix (L1 -> L2 -> L3).  The parts' forests grow in the same passes."""
    spark, cats = train.sparkSession, [c for c in candidates if dict(train.dtypes)[c] == "string"]
    narrow = within_levels(train, cats, cfg.max_levels, parts) if cats else [[]] * max(1, len(parts))
    features = [[c for c in candidates if c not in cats or c in own] for own in narrow]
    grown = forests(train, label, features, cats, parts, num_trees=cfg.num_trees, min_leaf=cfg.min_leaf,
                    max_leaves=cfg.max_leaves, seed=cfg.seed, id_col=id_col)
    chosen = []
    for gains, _ in grown:                                  # one row a feature
        imp = spark.createDataFrame(list(gains.items()), "feature string, importance double")
        chosen.append([r["feature"] for r in cumulative_select(imp, cfg.share).orderBy("rank").collect()])
    return chosen


@dataclass
class FittedModel:
    model: LogisticRegressionModel
    design: Design
    classes: list[str]
    alpha: float
    lam: float
    selected: list[str]
    lambda_path: list[tuple[float, float]]


@dataclass
class Part:
    """One set of training rows of a search: its design, class weights and the
    column that tells a row's inner fold, validation or neither."""
    design: Design
    weights: dict[str, float]
    parts: Column
    folds: int


def shared_rows(df: DataFrame, label: str, classes: Sequence[str], parts: Sequence[Part], alphas: Sequence[float],
                id_col: str) -> tuple[DataFrame, list[PA.Group], list[list[int]]]:
    """What the shared passes read: every design column of any part once,
    centred and scaled by the first part that has it; per part the scale and
    shift that make them its own standardised columns, and their places."""
    where: dict[tuple, int] = {}
    columns, centre = [], []
    for part in parts:
        for name, feature, level in part.design.columns:
            if (feature, level) not in where:
                where[feature, level] = len(columns)
                m, s = part.design.means[name], part.design.sds[name]
                scaled = s is not None and s > 0
                centre.append((m, s) if scaled else (0.0, 1.0))
                columns.append((part.design.expr(name) - F.lit(centre[-1][0])) / F.lit(centre[-1][1]))
    groups, places = [], []
    for part in parts:
        scale, shift, own = np.zeros(len(columns)), np.zeros(len(columns)), []
        for name, feature, level in part.design.columns:
            j = where[feature, level]
            m, s = part.design.means[name], part.design.sds[name]
            m, s = (m, s) if s is not None and s > 0 else (0.0, 1.0)
            scale[j], shift[j] = centre[j][1] / s, (centre[j][0] - m) / s
            own.append(j)
        groups.append(PA.Group(scale, shift, np.array([part.weights.get(c, 0.0) for c in classes]), part.folds, tuple(alphas)))
        places.append(own)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = PA.rows_of(df.where(F.col(label).isin(list(classes))), id_col, index, [p.parts for p in parts], columns)
    # as many tasks as the cluster takes where the table is small; larger ones stay as they lie
    least = df.sparkSession.sparkContext.defaultParallelism
    return (rows.repartition(least) if rows.rdd.getNumPartitions() < least else rows), groups, places


def part_of(df: DataFrame, label: str, selected: Sequence[str], parts: Column, folds: int) -> Part:
    """Design and class weights of the rows of a part that train."""
    train = df.where(parts >= 0)
    weights = {r["class"]: r["weight"] for r in S.class_weights(train, label).collect()}    # one row for each class
    return Part(fit_design(train, selected), weights, parts, folds)


def fingerprint(df: DataFrame) -> str:
    """Hash of a table's rows in any order."""
    r = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).alias("h")).agg(
        F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{r['n']}:{r['s']}:{r['x']}"


#: Part of every ledger key; raised with each change of the library that changes what a search or a forest finds.
LEDGER_VERSION = 5


def ledger_key(df: DataFrame, cfg: ModelConfig, *what) -> str:
    """Hash of rows and configuration."""
    told = [repr(w) for w in what] + [f"{k}={v!r}" for k, v in sorted(asdict(cfg).items()) if k not in ("ledger", "parallelism")]
    return hashlib.sha256("\n".join([str(LEDGER_VERSION), fingerprint(df), *told]).encode()).hexdigest()[:32]


def ledger_of(df: DataFrame, cfg: ModelConfig, *what) -> PA.Ledger | None:
    """The ledger of a search over these rows with this configuration, in the
    folder that all applications share."""
    path = cfg.ledger or shared_folder(df.sparkSession, "search-ledger")
    return None if path is None else PA.Ledger(df.sparkSession, path, ledger_key(df, cfg, *what))


def recalled_features(df: DataFrame, label: str, candidates: Sequence[str], cfg: ModelConfig, parts: Sequence[Column],
                      id_col: str, held: DataFrame) -> list[list[str]]:
    """:func:`select_features`, read from the ledger where an application has
    written it for the same rows; ``held``: what the selection depends on."""
    spark = df.sparkSession
    path = cfg.ledger or shared_folder(spark, "search-ledger")
    if path is None:
        return select_features(df, label, candidates, cfg, parts, id_col)
    path = f"{path}-features/search={ledger_key(held, cfg, 'features', label, tuple(candidates), len(parts))}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        told = {r["part"]: r["features"] for r in spark.read.schema("part int, features array<string>").parquet(path).collect()}
        return [list(told[k]) for k in range(len(parts))]
    chosen = select_features(df, label, candidates, cfg, parts, id_col)
    spark.createDataFrame(list(enumerate(chosen)), "part int, features array<string>").coalesce(1).write.mode("overwrite").parquet(path)
    return chosen


def fit_final(train: DataFrame, label: str, selected: Sequence[str], classes: Sequence[str], alpha: float,
              cfg: ModelConfig, id_col: str = "id") -> FittedModel:
    """The final model: one alpha, lambda searched over ``final_folds`` (by
    weighted accuracy; ties go to the largest lambda), fitted by Spark ML on all
    training rows.  A row with a null in a selected number column is an error:
    impute first.  Folds go by the hash of the id, so they don't depend on how
    the rows lie in partitions."""
    df = S.stratified_folds(train.select(id_col, label, *selected), label, id_col, cfg.final_folds, f"{cfg.seed}:inner", out="_part")
    df = materialize(df.withColumn("_part", F.col("_part") - 1), "final-folds")
    part = part_of(df, label, selected, F.col("_part"), cfg.final_folds)
    rows, groups, _ = shared_rows(df, label, classes, [part], [alpha], id_col)
    rows = rows.persist()
    try:
        found = PA.search(rows, groups, len(groups[0].scale), len(classes), cfg.n_lambdas, cfg.lambda_ratio, tol=cfg.tol,
                          ledger=ledger_of(df, cfg, "final", label, tuple(selected), tuple(classes), alpha))[0][alpha]
    finally:
        rows.unpersist()
    lam = found.lambdas[found.best()]
    weighted = S.attach_weights(df, S.class_weights(df, label), label)
    vec = assemble(with_label_index(weighted, label, classes), part.design, keep=[id_col, "label", "weight"], invalid="error")
    model = elastic_net(alpha, lam, cfg.max_iter).fit(vec)
    return FittedModel(model, part.design, list(classes), float(alpha), float(lam), list(selected), found.curve())


def save_model(fm: FittedModel, path: str, caps: dict) -> None:
    """Write all that scoring needs: the coefficients, and as one JSON record
    the design, classes, alpha, lambda, features, lambda path and caps."""
    spark = SparkSession.getActiveSession()
    sink_model(fm.model, f"{path}/elastic_net")
    record = {"design": fm.design.to_json(), "classes": fm.classes, "alpha": fm.alpha, "lambda": fm.lam,
              "selected": fm.selected, "lambda_path": fm.lambda_path, "caps": caps}
    spark.createDataFrame([(json.dumps(record),)], "record string").write.mode("overwrite").parquet(f"{path}/record")


def load_model(spark: SparkSession, path: str) -> tuple[FittedModel, dict]:
    """(fitted model, caps) as written by :func:`save_model`."""
    r = json.loads(spark.read.parquet(f"{path}/record").first()["record"])
    model = LogisticRegressionModel.load(f"{path}/elastic_net")
    return (FittedModel(model, Design.from_json(r["design"]), r["classes"], r["alpha"], r["lambda"], r["selected"],
                        [tuple(p) for p in r["lambda_path"]]), {c: tuple(b) for c, b in r["caps"].items()})


def predict(fm: FittedModel, df: DataFrame, id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Predicted class and class probabilities (array aligned with
    ``fm.classes``) for new rows, through the fitted design.  Every row comes
    back; one with a null design value has a null prediction."""
    vec = assemble(df, fm.design, keep=[id_col, *keep], invalid="keep")
    out = fm.model.transform(vec).withColumn("_p", vector_to_array("probability"))
    known = ~F.exists(vector_to_array("features"), F.isnan)
    classes = F.array(*[F.lit(c) for c in fm.classes])
    return out.select(id_col, *keep,
                      F.when(known, F.element_at(classes, (F.col("prediction") + 1).cast("int"))).alias("predicted"),
                      F.when(known, F.col("_p")).alias("probs"), classes.alias("classes"))


@dataclass
class GridSearch:
    """Nested cross-validation: results ``(alpha, fold, accuracy, lambda,
    n_features)``, predictions ``(alpha, fold, id, actual, predicted)``, the
    inner curves ``(alpha, fold, lambda, cv_accuracy, cv_sd)`` and the outer
    folds' whole coefficient paths ``(alpha, fold, lambda, feature, class,
    coefficient)``.  ``selected``: the features of a forest over all rows."""
    results: DataFrame
    predictions: DataFrame
    curves: DataFrame
    paths: DataFrame
    selected: list[str]


def grid_search(train: DataFrame, label: str, candidates: Sequence[str], classes: Sequence[str],
                cfg: ModelConfig, id_col: str = "id") -> GridSearch:
    """Nested CV over alpha x outer stratified folds.  The forests of all
    outer folds, and the one over all rows, grow in the same passes; weights,
    levels, scaling and design are done once per outer fold; all outer folds,
    alphas and inner folds then run in the same passes too
    (:mod:`attrition.operators.path`).  Every validation row is scored once for
    each alpha."""
    spark, n = train.sparkSession, cfg.folds
    tf = materialize(S.stratified_folds(train, label, id_col, n, cfg.seed), "folds")
    # inner folds of the rows outside each outer fold, numbered in one go
    inner = tf.select(id_col, label, "fold", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_k")).where("fold <> _k")
    inner = inner.withColumn("_class", F.concat_ws(":", F.col("_k").cast("string"), F.col(label)))
    inner = S.stratified_folds(inner, "_class", id_col, cfg.inner_folds, f"{cfg.seed}:inner", out="_inner")
    inner = inner.groupBy(F.col(id_col).alias("_id")).agg(*[
        F.coalesce(F.max(F.when(F.col("_k") == k, F.col("_inner") - 1)), F.lit(PA.VALIDATION)).alias(f"_part{k}") for k in range(1, n + 1)])
    tf = materialize(tf.join(inner, F.col(id_col) == F.col("_id")).drop("_id"), "folds")
    columns = [F.col(f"_part{k}") for k in range(1, n + 1)]
    *chosen, selected = recalled_features(tf, label, candidates, cfg, [*[c >= 0 for c in columns], F.lit(True)], id_col,
                                          tf.select(id_col, label, *candidates, *columns))
    with ThreadPoolExecutor(max(1, cfg.parallelism)) as pool:      # one outer fold's jobs beside another's
        parts = list(pool.map(lambda own, c: part_of(tf, label, own, c, cfg.inner_folds), chosen, columns))
    rows, groups, places = shared_rows(tf, label, classes, parts, cfg.alphas, id_col)
    rows = rows.persist()
    try:
        width = len(groups[0].scale)
        ledger = ledger_of(tf.select(id_col, label, *candidates), cfg, "grid", label, tuple(classes), tuple(map(tuple, chosen)))
        found = PA.search(rows, groups, width, len(classes), cfg.n_lambdas, cfg.lambda_ratio, tol=cfg.tol, ledger=ledger)
        best = [(g, a, PA.shared_coefficients(groups[g], f.coefficients[f.best()])) for g in range(n) for a, f in found[g].items()]
        preds = PA.predictions(rows, best, classes, len(groups), width, dict(train.dtypes)[id_col])
        preds = materialize(preds.select("alpha", (F.col("group") + 1).alias("fold"), F.col("id").alias(id_col), "actual",
                                         "predicted"), "fold-predictions")
    finally:
        rows.unpersist()
    hit = F.coalesce((F.col("actual") == F.col("predicted")).cast("double"), F.lit(0.0))
    got = {(r["alpha"], r["fold"]): r["accuracy"] for r in      # one row for each fit
           preds.groupBy("alpha", "fold").agg(F.avg(hit).alias("accuracy")).collect()}
    every = [(a, g + 1, f) for g in range(n) for a, f in found[g].items()]
    results = [(a, fold, got.get((a, fold), 0.0), float(f.lambdas[f.best()]), len(chosen[fold - 1])) for a, fold, f in every]
    curves = [(a, fold, *point) for a, fold, f in every for point in f.curve()]
    # one row for each lambda on the driver; the cells are unrolled by Spark
    names = [[c[0] for c in p.design.columns] for p in parts]
    paths = [(a, fold, float(lam), names[fold - 1], b[1:][places[fold - 1]].tolist()) for a, fold, f in every
             for lam, b in zip(f.lambdas, f.coefficients)]
    paths = spark.createDataFrame(paths, "alpha double, fold int, lambda double, names array<string>, cells array<array<double>>")
    cell = F.explode(F.arrays_zip("names", "cells")).alias("cell")
    paths = paths.select("alpha", "fold", "lambda", cell).select(
        "alpha", "fold", "lambda", F.col("cell.names").alias("feature"),
        F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("class"), F.col("cell.cells").alias("coefficient"))).alias("c"))
    return GridSearch(spark.createDataFrame(results, "alpha double, fold int, accuracy double, lambda double, n_features int"), preds,
                      spark.createDataFrame(curves, "alpha double, fold int, lambda double, cv_accuracy double, cv_sd double"),
                      materialize(paths.select("alpha", "fold", "lambda", "feature", "c.class", "c.coefficient"), "paths"), selected)


def alpha_grid(train: DataFrame, label: str, candidates: Sequence[str], classes: Sequence[str],
               cfg: ModelConfig, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Results and predictions of :func:`grid_search`."""
    g = grid_search(train, label, candidates, classes, cfg, id_col)
    return g.results, g.predictions


def alpha_summary(results: DataFrame) -> DataFrame:
    """L9 roll-up: per alpha mean / sd / min / max accuracy, mean lambda,
    mean number of features."""
    return results.groupBy("alpha").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_samp("accuracy").alias("sd_accuracy"),
        F.min("accuracy").alias("min_accuracy"), F.max("accuracy").alias("max_accuracy"),
        F.avg("lambda").alias("mean_lambda"), F.avg("n_features").alias("mean_n_features"))


def best_alpha(summary: DataFrame) -> DataFrame:
    """First maximum of mean accuracy (smallest alpha on ties)."""
    return summary.orderBy(F.desc("mean_accuracy"), F.asc("alpha")).limit(1)


def fold_macro_f1(preds: DataFrame) -> DataFrame:
    """Macro F1 per (alpha, fold) from stored predictions: confusion cells by
    (alpha, fold, predicted, actual), per-class F1, mean skipping nulls."""
    keys = ["alpha", "fold"]
    cells = preds.groupBy(*keys, "predicted", "actual").agg(F.count(F.lit(1)).alias("count"))
    lv = preds.groupBy(*keys).agg(F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("lv"))
    grid = lv.select(*keys, F.explode("lv").alias("predicted"), "lv").select(*keys, "predicted",
                                                                            F.explode("lv").alias("actual"))
    conf = (grid.join(cells, [*keys, "predicted", "actual"], "left")
            .withColumn("count", F.coalesce("count", F.lit(0)).cast("bigint")))
    parts = F.array(
        F.struct(F.col("predicted").alias("class"), F.col("count").alias("pred_n"), F.lit(0).cast("bigint").alias("act_n"),
                 F.when(F.col("predicted") == F.col("actual"), F.col("count")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("actual").alias("class"), F.lit(0).cast("bigint").alias("pred_n"), F.col("count").alias("act_n"),
                 F.lit(0).cast("bigint").alias("tp")))
    m = (conf.select(*keys, F.explode(parts).alias("m")).select(*keys, "m.*")
         .groupBy(*keys, "class").agg(F.sum("pred_n").alias("pred_n"), F.sum("act_n").alias("act_n"),
                                      F.sum("tp").alias("tp")))
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n"))
    rec = F.when(F.col("act_n") > 0, F.col("tp") / F.col("act_n"))
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return m.withColumn("f1", f1).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def top3_validation(summary: DataFrame, preds: DataFrame, k: int = 3) -> DataFrame:
    """The k best alphas by accuracy, their mean / sd of fold macro-F1
    and fold accuracy from the stored predictions, first-tie ranks by each
    metric, the best alpha by F1 and whether it agrees with accuracy."""
    top = (summary.withColumn("rank_acc_all", F.row_number().over(
        Window.orderBy(F.desc("mean_accuracy"), F.asc("alpha")))).filter(F.col("rank_acc_all") <= k))
    f1 = fold_macro_f1(preds)
    facc = preds.groupBy("alpha", "fold").agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("acc"))
    per = f1.join(facc, ["alpha", "fold"]).groupBy("alpha").agg(
        F.avg("acc").alias("mean_cv_accuracy"), F.avg("macro_f1").alias("mean_cv_f1"),
        F.stddev_samp("macro_f1").alias("f1_sd"))
    t = top.select("alpha", "rank_acc_all").join(per, "alpha")
    # The table has k rows: a global window is metadata-sized.
    t = (t.withColumn("rank_by_accuracy", F.row_number().over(Window.orderBy(F.desc("mean_cv_accuracy"), "rank_acc_all")))
         .withColumn("rank_by_f1", F.row_number().over(Window.orderBy(F.desc("mean_cv_f1"), "rank_acc_all"))))
    best_f1 = t.filter(F.col("rank_by_f1") == 1).select("alpha").scalar()
    return t.select("alpha", "mean_cv_accuracy", "mean_cv_f1", "f1_sd",
                    F.col("rank_by_accuracy").cast("int").alias("rank_by_accuracy"),
                    F.col("rank_by_f1").cast("int").alias("rank_by_f1"),
                    (F.col("rank_acc_all") == 1).alias("best_by_accuracy"),
                    (F.col("alpha") == best_f1).alias("best_by_f1"))


def cv_curve(summary: DataFrame) -> DataFrame:
    """Accuracy +/- sd, lambda and feature count per alpha (plot data)."""
    return summary.select("alpha", "mean_accuracy",
                          (F.col("mean_accuracy") - F.col("sd_accuracy")).alias("lower"),
                          (F.col("mean_accuracy") + F.col("sd_accuracy")).alias("upper"),
                          "sd_accuracy", "mean_lambda", "mean_n_features")


def lambda_curve(path: DataFrame, n_folds: int) -> DataFrame:
    """Misclassification by lambda (1 - mean CV accuracy) with its
    standard error, the minimum and the one-standard-error choice (largest
    lambda whose error is within min + se).  ``path`` has ``(lambda,
    cv_accuracy, cv_sd)`` rows, one per lambda (a small table)."""
    w = Window.partitionBy()
    g = path.select("lambda", (F.lit(1.0) - F.col("cv_accuracy")).alias("cv_error"),
                    (F.col("cv_sd") / F.lit(math.sqrt(n_folds))).alias("cv_se"))
    mn = F.min("cv_error").over(w)
    g = g.withColumn("_min", mn)
    se_at_min = F.max(F.when(F.col("cv_error") == F.col("_min"), F.col("cv_se"))).over(w)
    g = g.withColumn("_se", se_at_min)
    lam_min = F.max(F.when(F.col("cv_error") == F.col("_min"), F.col("lambda"))).over(w)
    lam_1se = F.max(F.when(F.col("cv_error") <= F.col("_min") + F.coalesce(F.col("_se"), F.lit(0.0)),
                           F.col("lambda"))).over(w)
    return g.select("lambda", "cv_error", "cv_se", (F.col("lambda") == lam_min).alias("is_lambda_min"),
                    (F.col("lambda") == lam_1se).alias("is_lambda_1se"))


def coef_long(fm: FittedModel) -> DataFrame:
    """U4: ``(class, feature, coefficient)`` without intercepts and zeros.
    The K x p matrix is model metadata (size set by the design), so it is
    read on the driver and turned into a DataFrame."""
    mat = fm.model.coefficientMatrix.toArray()
    rows = [(fm.classes[k], fm.design.names[j], float(mat[k][j]))
            for k in range(mat.shape[0]) for j in range(mat.shape[1]) if mat[k][j] != 0.0]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "class string, feature string, coefficient double")
