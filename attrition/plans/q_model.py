"""Registered queries: encoding, selection, CV selection, interpretation,
imputation and the model flows (P13-P16, S6, L1-L13, U4, W1, A17, A18, J3,
F11, M4, M5, B6, B7, S5).

Operators that can be written in SQL run on data-derived inputs and have
an oracle; the model fits themselves (forest, elastic net, lambda and
alpha search, prediction) are checked rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attrition.operators import cleaning as C
from attrition.operators import encode as EN
from attrition.operators import features as FE
from attrition.operators import interpret as IN
from attrition.operators import modeling as MD
from attrition.operators import selection as SE
from attrition.operators import split as S
from attrition.operators.impute import impute_pmm, impute_sets, pmm_donor_match
from attrition.plans import flows
from attrition.plans.base import (ADDONS, LAB_SQL, PROBS_SQL, PROTECTION, RELABEL_SQL, STREAMING, labeled_df,
                                  modeling_df, modeling_table, new_cohort_df, with_sql)
from attrition.plans.q_prep import FEATURES_SQL
from attrition.plans.registry import register
from attrition.sources.fixtures import with_class_probabilities
from attrition.sources.tables import table
from attrition.session import materialize, scratch_path

DESIGN_FEATURES = ("contract_tenure_risk", "tenure", "contract", "age_group")


def _feat(df):
    return FE.derive_features(C.relabel_contract(df), addons=ADDONS, streaming=STREAMING, protection=PROTECTION)


FEAT_ALL_SQL = FEATURES_SQL + """,
fa AS (SELECT fi.*, f.* EXCLUDE (id) FROM feat_in fi JOIN feat f USING (id)),
nfi AS (SELECT * REPLACE (""" + RELABEL_SQL + """ AS contract) FROM newc),
nfa AS (SELECT id, tenure, contract,
    CASE WHEN contract = 'Month to Month' AND tenure < 12 THEN 'High Risk'
         WHEN contract = 'Month to Month' THEN 'Medium Risk' ELSE 'Low Risk' END AS contract_tenure_risk,
    CASE WHEN age < 30 THEN 'Young' WHEN age < 50 THEN 'Middle' ELSE 'Senior' END AS age_group FROM nfi)"""


@register("encode_levels", with_sql(LAB_SQL, """SELECT id, target,
  CAST(dense_rank() OVER (ORDER BY target) - 1 AS INTEGER) AS target_code FROM mdl"""))
def q_encode_levels(spark, d):
    """Alphabetical class codes."""
    return EN.encode_levels(modeling_table(spark, d), "target").select("id", "target", "target_code")


def _design_sql(src: str, fit_src: str) -> str:
    return f"""SELECT id, 'contract_tenure_risk' || contract_tenure_risk AS design_column, 1.0::DOUBLE AS value
  FROM {src} WHERE contract_tenure_risk IN (SELECT contract_tenure_risk FROM {fit_src})
UNION ALL SELECT id, 'tenure', CAST(tenure AS DOUBLE) FROM {src} WHERE tenure <> 0
UNION ALL SELECT id, 'contract' || contract, 1.0::DOUBLE FROM {src}
  WHERE contract IN (SELECT contract FROM {fit_src}) AND contract <> (SELECT min(contract) FROM {fit_src})
UNION ALL SELECT id, 'age_group' || age_group, 1.0::DOUBLE FROM {src}
  WHERE age_group IN (SELECT age_group FROM {fit_src}) AND age_group <> (SELECT min(age_group) FROM {fit_src})"""


@register("one_hot_design", with_sql(FEAT_ALL_SQL, _design_sql("fa", "fa")))
def q_one_hot_design(spark, d):
    """Sparse design cells; the first factor keeps every level, later
    factors drop their first level."""
    f = _feat(modeling_df(spark, d))
    design = EN.fit_design(f, DESIGN_FEATURES, scale=False)
    return EN.design_long(f, design)


@register("encode_with_fitted_levels", with_sql(FEAT_ALL_SQL, _design_sql("nfa", "fa")))
def q_encode_fitted(spark, d):
    """The recently joined cohort encoded with the training levels
    (absent or unseen levels give zeros)."""
    design = EN.fit_design(_feat(modeling_df(spark, d)), DESIGN_FEATURES, scale=False)
    return EN.design_long(_feat(new_cohort_df(spark, d)), design)


ALIGN_COLS = ("contract_tenure_riskHigh Risk", "contract_tenure_riskLow Risk", "contract_tenure_riskMedium Risk",
              "tenure", "contractOne Year", "contractTwo Year", "age_groupSenior", "age_groupYoung")


@register("align_columns", with_sql(FEAT_ALL_SQL, """SELECT id,
  CASE WHEN contract_tenure_risk = 'High Risk' THEN 1.0 ELSE 0.0 END::DOUBLE AS "contract_tenure_riskHigh Risk",
  CASE WHEN contract_tenure_risk = 'Low Risk' THEN 1.0 ELSE 0.0 END::DOUBLE AS "contract_tenure_riskLow Risk",
  CASE WHEN contract_tenure_risk = 'Medium Risk' THEN 1.0 ELSE 0.0 END::DOUBLE AS "contract_tenure_riskMedium Risk",
  CAST(tenure AS DOUBLE) AS tenure,
  CASE WHEN contract = 'One Year' THEN 1.0 ELSE 0.0 END::DOUBLE AS "contractOne Year",
  CASE WHEN contract = 'Two Year' THEN 1.0 ELSE 0.0 END::DOUBLE AS "contractTwo Year",
  CASE WHEN age_group = 'Senior' THEN 1.0 ELSE 0.0 END::DOUBLE AS "age_groupSenior",
  CASE WHEN age_group = 'Young' THEN 1.0 ELSE 0.0 END::DOUBLE AS "age_groupYoung" FROM nfa"""))
def q_align_columns(spark, d):
    """The new cohort's own design (levels it has) aligned to the
    training design columns: missing columns become 0, training order."""
    train_design = EN.fit_design(_feat(modeling_df(spark, d)), DESIGN_FEATURES, scale=False)
    new = _feat(new_cohort_df(spark, d))
    own = EN.fit_design(new, DESIGN_FEATURES, scale=False)
    wide = new.select("id", *own.raw_columns())
    return EN.align_columns(wide, train_design.names, keep=["id"])


def _scaling_sql() -> str:
    exprs = {
        "contract_tenure_riskHigh Risk": "CASE WHEN contract_tenure_risk = 'High Risk' THEN 1.0 ELSE 0.0 END",
        "contract_tenure_riskLow Risk": "CASE WHEN contract_tenure_risk = 'Low Risk' THEN 1.0 ELSE 0.0 END",
        "contract_tenure_riskMedium Risk": "CASE WHEN contract_tenure_risk = 'Medium Risk' THEN 1.0 ELSE 0.0 END",
        "tenure": "tenure",
        "contractOne Year": "CASE WHEN contract = 'One Year' THEN 1.0 ELSE 0.0 END",
        "contractTwo Year": "CASE WHEN contract = 'Two Year' THEN 1.0 ELSE 0.0 END",
        "age_groupSenior": "CASE WHEN age_group = 'Senior' THEN 1.0 ELSE 0.0 END",
        "age_groupYoung": "CASE WHEN age_group = 'Young' THEN 1.0 ELSE 0.0 END",
    }
    return " UNION ALL ".join(
        f"SELECT '{n}' AS feature, round(avg(CAST({e} AS DOUBLE)), 10) AS mean, "
        f"round(stddev_samp(CAST({e} AS DOUBLE)), 10) AS sd FROM fa" for n, e in exprs.items())


@register("scaling_table", with_sql(FEAT_ALL_SQL, _scaling_sql()))
def q_scaling_table(spark, d):
    """Training mean and sample sd of every design column (10 dp)."""
    f = _feat(modeling_df(spark, d))
    design = EN.fit_design(f, DESIGN_FEATURES, scale=False)
    t = EN.scaling_table(f.select(*design.raw_columns()), design.names)
    return t.select("feature", F.round("mean", 10).alias("mean"), F.round("sd", 10).alias("sd"))


@register("standardize", with_sql(LAB_SQL, """, st AS (SELECT avg(CAST(tenure AS DOUBLE)) AS mt, stddev_samp(CAST(tenure AS DOUBLE)) AS st,
  avg(charge) AS mc, stddev_samp(charge) AS sc FROM mdl)
SELECT id, round((CAST(tenure AS DOUBLE) - mt) / st, 8) AS tenure, round((charge - mc) / sc, 8) AS charge FROM mdl, st"""))
def q_standardize(spark, d):
    """(x - mean) / sd with the cohort's statistics (8 dp)."""
    m = modeling_df(spark, d)
    design = EN.fit_design(m, ["tenure", "charge"], categorical=[])
    return m.select("id", *[F.round(c, 8).alias(n) for c, n in zip(design.scaled_columns(), design.names)])


@register("prob_columns", with_sql(PROBS_SQL, """SELECT id,
  max(prob) FILTER (WHERE class = '1-URGENT') AS "Prob_1-URGENT", max(prob) FILTER (WHERE class = '2-HIGH') AS "Prob_2-HIGH",
  max(prob) FILTER (WHERE class = '3-MEDIUM') AS "Prob_3-MEDIUM",
  max(prob) FILTER (WHERE class = '4-NOT SPECIFIED') AS "Prob_4-NOT SPECIFIED",
  max(prob) FILTER (WHERE class = '5-LOW') AS "Prob_5-LOW", max(prob) FILTER (WHERE class = 'No Churn') AS "Prob_No Churn"
FROM probs GROUP BY id"""))
def q_prob_columns(spark, d):
    """One probability column per class from the probability array."""
    m = modeling_table(spark, d)
    v = with_class_probabilities(m)
    classes = sorted(r[0] for r in m.select("target").distinct().collect())
    return EN.prob_columns(v, classes, "probs", keep=["id"])


_STR_COLS = ("status", "churn_category", "contract", "payment", "has_standard", "has_economy", "target")


@register("cardinality_guard", with_sql(LAB_SQL, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_levels, "
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) > 53 AS too_many_levels FROM lab" for c in _STR_COLS)))
def q_cardinality_guard(spark, d):
    """L1: levels per categorical column (null counted) against 53."""
    return SE.cardinality_guard(labeled_df(spark, d), _STR_COLS)


def _brand_importance(spark, d):
    """A score table from the data: quantity sold per part brand."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return (li.join(p, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("feature"))
            .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("importance")))


IMP_SQL = """imp AS (SELECT p_brand AS feature, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS importance
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


@register("cumulative_select", with_sql(IMP_SQL, """, c AS (SELECT feature, importance,
  row_number() OVER (ORDER BY importance DESC, feature) AS rank,
  sum(importance) OVER (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(importance) OVER () AS cumulative_share FROM imp)
SELECT feature, importance, rank, cumulative_share FROM
  (SELECT *, coalesce(lag(cumulative_share) OVER (ORDER BY rank), 0.0) AS prev FROM c) WHERE prev < 0.95"""))
def q_cumulative_select(spark, d):
    """L3: shortest prefix of brands by quantity reaching 95 %."""
    return SE.cumulative_select(_brand_importance(spark, d))


@register("top_importance", with_sql(IMP_SQL, "SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 20"))
def q_top_importance(spark, d):
    """L4: top 20 of the score table."""
    return SE.top_importance(_brand_importance(spark, d), 20)


# --- interpretation on a data-derived coefficient table ---------------------
PROFILE_COLS = ("tenure", "charge", "total_charges", "qty", "disc", "n_lines", "age", "population")


def _profile(spark, d):
    return IN.class_profile_coefficients(modeling_table(spark, d), "target", PROFILE_COLS)


def _profile_sql() -> str:
    o = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS o_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}" for c in PROFILE_COLS)
    parts = " UNION ALL ".join(
        f"SELECT target AS class, '{c}' AS feature, CASE WHEN any_value(s_{c}) > 0 THEN "
        f"round((avg(CAST({c} AS DOUBLE)) - any_value(o_{c})) / any_value(s_{c}), 3) + 0.0::DOUBLE END "
        f"AS coefficient FROM mdl, ov GROUP BY target" for c in PROFILE_COLS)
    return LAB_SQL + f",\nov AS (SELECT {o} FROM mdl),\ncoefs AS ({parts})"


PROFILE_SQL = _profile_sql()


@register("coef_profile", with_sql(PROFILE_SQL, "SELECT * FROM coefs"))
def q_coef_profile(spark, d):
    """Standardised class-mean differences: the coefficient-shaped table
    the interpretation operators are checked on."""
    return _profile(spark, d)


@register("odds_ratio", with_sql(PROFILE_SQL, """SELECT *, round(exp(coefficient), 12) AS odds_ratio,
  CASE WHEN coefficient > 0 THEN 'increases' ELSE 'decreases' END AS direction,
  round(abs((exp(coefficient) - 1.0) * 100.0), 10) AS pct_change FROM coefs"""))
def q_odds_ratio(spark, d):
    """F11 (odds ratio to 12 dp, percent change to 10 dp: exp differs in
    the last bit between engines)."""
    o = IN.odds_ratios(_profile(spark, d))
    return o.withColumn("odds_ratio", F.round("odds_ratio", 12)).withColumn("pct_change", F.round("pct_change", 10))


TOPK = 3  # this table has 8 features per class; the reference uses 15 of 39


@register("topk_per_class", with_sql(PROFILE_SQL, f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY class
  ORDER BY abs(coefficient) DESC, feature) AS rank FROM coefs) WHERE rank <= {TOPK}"""))
def q_topk_per_class(spark, d):
    """W1"""
    return IN.topk_per_class(_profile(spark, d), TOPK)


@register("max_abs_by_feature", with_sql(PROFILE_SQL, "SELECT feature, max(abs(coefficient)) AS max_abs_coef FROM coefs GROUP BY 1"))
def q_max_abs(spark, d):
    """A18"""
    return IN.max_abs_by_feature(_profile(spark, d))


@register("topk_global", with_sql(PROFILE_SQL, """SELECT * FROM coefs ORDER BY abs(coefficient) DESC, class, feature LIMIT 10"""))
def q_topk_global(spark, d):
    """The ten largest |coefficient| cells overall (top-k report;
    Spark plans it as TakeOrderedAndProject, no full sort)."""
    from attrition.operators.reshape import topk_global
    return topk_global(_profile(spark, d), 10, [F.desc(F.abs(F.col("coefficient"))), "class", "feature"])


@register("top_features", with_sql(PROFILE_SQL, """SELECT feature, max(abs(coefficient)) AS max_abs_coef FROM coefs
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def q_top_features(spark, d):
    """Top 5 features by max |coefficient|."""
    return IN.top_features(_profile(spark, d), 5)


@register("semi_top_features", with_sql(PROFILE_SQL, """SELECT * FROM coefs WHERE feature IN (SELECT feature FROM
  (SELECT feature, max(abs(coefficient)) AS m FROM coefs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5))"""))
def q_semi_top(spark, d):
    """J3"""
    c = _profile(spark, d)
    return IN.semi_top_features(c, IN.top_features(c, 5))


@register("feature_frequency", with_sql(PROFILE_SQL, f"""SELECT feature, count(*) AS appears_in_n_categories FROM
  (SELECT *, row_number() OVER (PARTITION BY class ORDER BY abs(coefficient) DESC, feature) AS rank FROM coefs)
  WHERE rank <= {TOPK} GROUP BY 1 HAVING count(*) > 1"""))
def q_feature_frequency(spark, d):
    """A17"""
    return IN.feature_frequency(_profile(spark, d), TOPK)


# --- CV selection operators on per-alpha pseudo predictions -----------------
N_ALPHA = 11  # the reference's grid 0, 0.1, ..., 1


def _cv_preds(spark, d):
    m = S.stratified_folds(modeling_table(spark, d))
    m = m.withColumn("_ai", F.explode(F.sequence(F.lit(0), F.lit(N_ALPHA - 1))))
    v = with_class_probabilities(m, seed=F.concat(F.lit("a"), F.col("_ai").cast("string")))
    return v.select((F.col("_ai").cast("double") / F.lit(10.0)).alias("alpha"), "fold", "id",
                    F.col("target").alias("actual"), "predicted")


def _cv_results(preds):
    """Accuracy per (alpha, fold).  No model is fitted here: the share of rows
    predicted as No Churn stands in for lambda, the number of predicted
    classes for the number of features."""
    return preds.groupBy("alpha", "fold").agg(
        F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"),
        F.avg((F.col("predicted") == "No Churn").cast("double")).alias("lambda"),
        F.countDistinct("predicted").cast("int").alias("n_features"))


_hexv = ("(instr('0123456789abcdef', substr({h}, 1, 1)) - 1) * 256 + "
         "(instr('0123456789abcdef', substr({h}, 2, 1)) - 1) * 16 + "
         "(instr('0123456789abcdef', substr({h}, 3, 1)) - 1)")
CV_SQL = LAB_SQL + f""",
folds AS (SELECT id, target, CAST((row_number() OVER (PARTITION BY target
  ORDER BY md5(CAST(id AS VARCHAR) || ':' || '123:folds'), id) - 1) % 5 + 1 AS INTEGER) AS fold FROM mdl),
lv AS (SELECT DISTINCT target AS class FROM mdl),
cvp AS (SELECT f.id, f.target AS actual, f.fold, a.i AS ai, lv.class,
  1 + {_hexv.format(h="md5(CAST(f.id AS VARCHAR) || ':' || 'a' || CAST(a.i AS VARCHAR) || ':' || lv.class)")}
  + CASE WHEN lv.class = f.target AND instr('0123456789abcdef', substr(md5(CAST(f.id AS VARCHAR) || ':m'), 1, 1)) - 1 < 10
         THEN 8192 ELSE 0 END AS raw
  FROM folds f CROSS JOIN (SELECT unnest(range({N_ALPHA})) AS i) a CROSS JOIN lv),
cvpred AS (SELECT CAST(ai AS DOUBLE) / 10.0::DOUBLE AS alpha, fold, id, actual, class AS predicted FROM
  (SELECT *, row_number() OVER (PARTITION BY ai, id ORDER BY raw DESC, class) AS rk FROM cvp) WHERE rk = 1),
cvres AS (SELECT alpha, fold, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
  avg(CASE WHEN predicted = 'No Churn' THEN 1.0 ELSE 0.0 END)::DOUBLE AS "lambda", count(DISTINCT predicted) AS n_features
  FROM cvpred GROUP BY 1, 2),
asum AS (SELECT alpha, avg(accuracy) AS mean_accuracy, stddev_samp(accuracy) AS sd_accuracy,
  min(accuracy) AS min_accuracy, max(accuracy) AS max_accuracy, avg("lambda") AS mean_lambda,
  avg(n_features) AS mean_n_features FROM cvres GROUP BY alpha)"""


def _r(df, cols, digits=12):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("alpha_summary", with_sql(CV_SQL, """SELECT alpha, round(mean_accuracy, 12) AS mean_accuracy,
  round(sd_accuracy, 12) AS sd_accuracy, round(min_accuracy, 12) AS min_accuracy, round(max_accuracy, 12) AS max_accuracy,
  round(mean_lambda, 12) AS mean_lambda, round(mean_n_features, 12) AS mean_n_features FROM asum"""))
def q_alpha_summary(spark, d):
    """L9 roll-up over per-(alpha, fold) results."""
    s = MD.alpha_summary(_cv_results(_cv_preds(spark, d)))
    return _r(s, {"mean_accuracy", "sd_accuracy", "min_accuracy", "max_accuracy", "mean_lambda", "mean_n_features"})


@register("best_alpha", with_sql(CV_SQL, """SELECT alpha, round(mean_accuracy, 12) AS mean_accuracy FROM asum
  ORDER BY mean_accuracy DESC, alpha LIMIT 1"""))
def q_best_alpha(spark, d):
    """First maximum of mean accuracy."""
    b = MD.best_alpha(MD.alpha_summary(_cv_results(_cv_preds(spark, d))))
    return b.select("alpha", F.round("mean_accuracy", 12).alias("mean_accuracy"))


@register("cv_curve", with_sql(CV_SQL, """SELECT alpha, round(mean_accuracy, 12) AS mean_accuracy,
  round(mean_accuracy - sd_accuracy, 12) AS lower, round(mean_accuracy + sd_accuracy, 12) AS upper,
  round(sd_accuracy, 12) AS sd_accuracy, round(mean_lambda, 12) AS mean_lambda,
  round(mean_n_features, 12) AS mean_n_features FROM asum"""))
def q_cv_curve(spark, d):
    """Accuracy band, lambda and feature count per alpha."""
    c = MD.cv_curve(MD.alpha_summary(_cv_results(_cv_preds(spark, d))))
    return _r(c, {"mean_accuracy", "lower", "upper", "sd_accuracy", "mean_lambda", "mean_n_features"})


@register("top3_validation", with_sql(CV_SQL, """,
lvl AS (SELECT DISTINCT alpha, fold, actual AS class FROM cvpred UNION SELECT DISTINCT alpha, fold, predicted FROM cvpred),
m AS (SELECT l.alpha, l.fold, l.class,
  (SELECT count(*) FROM cvpred p WHERE p.alpha = l.alpha AND p.fold = l.fold AND p.predicted = l.class) AS pred_n,
  (SELECT count(*) FROM cvpred p WHERE p.alpha = l.alpha AND p.fold = l.fold AND p.actual = l.class) AS act_n,
  (SELECT count(*) FROM cvpred p WHERE p.alpha = l.alpha AND p.fold = l.fold AND p.actual = l.class AND p.predicted = l.class) AS tp
  FROM lvl l),
pr AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n END AS precision, CASE WHEN act_n > 0 THEN tp / act_n END AS recall FROM m),
f1 AS (SELECT alpha, fold, avg(CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) END) AS macro_f1
  FROM pr GROUP BY 1, 2),
per AS (SELECT r.alpha, avg(r.accuracy) AS mean_cv_accuracy, avg(f.macro_f1) AS mean_cv_f1, stddev_samp(f.macro_f1) AS f1_sd
  FROM cvres r JOIN f1 f USING (alpha, fold) GROUP BY 1),
top AS (SELECT alpha, row_number() OVER (ORDER BY mean_accuracy DESC, alpha) AS rank_acc_all FROM asum),
t AS (SELECT p.*, top.rank_acc_all FROM per p JOIN top USING (alpha) WHERE rank_acc_all <= 3),
t2 AS (SELECT *, row_number() OVER (ORDER BY mean_cv_accuracy DESC, rank_acc_all) AS rank_by_accuracy,
  row_number() OVER (ORDER BY mean_cv_f1 DESC, rank_acc_all) AS rank_by_f1 FROM t)
SELECT alpha, round(mean_cv_accuracy, 12) AS mean_cv_accuracy, round(mean_cv_f1, 12) AS mean_cv_f1,
  round(f1_sd, 12) AS f1_sd, CAST(rank_by_accuracy AS INTEGER) AS rank_by_accuracy, CAST(rank_by_f1 AS INTEGER) AS rank_by_f1,
  rank_acc_all = 1 AS best_by_accuracy, alpha = (SELECT alpha FROM t2 WHERE rank_by_f1 = 1) AS best_by_f1 FROM t2"""))
def q_top3_validation(spark, d):
    """F1 cross-check of the three best alphas from stored predictions."""
    preds = materialize(_cv_preds(spark, d), "cv-pseudo-preds")
    t = MD.top3_validation(MD.alpha_summary(_cv_results(preds)), preds)
    return _r(t, {"mean_cv_accuracy", "mean_cv_f1", "f1_sd"})


# --- imputation -------------------------------------------------------------
@register("pmm_donor_match", with_sql(LAB_SQL, """, sc AS (SELECT id, charge AS y,
  CASE WHEN id % 7 <> 0 THEN qty END AS v FROM mdl),
don AS (SELECT id AS did, y AS dy, v FROM sc WHERE v IS NOT NULL),
rec AS (SELECT id, y FROM sc WHERE v IS NULL),
nn AS (SELECT r.id, d.v, row_number() OVER (PARTITION BY r.id ORDER BY abs(r.y - d.dy), d.did) AS k
  FROM rec r CROSS JOIN don d),
nn5 AS (SELECT *, count(*) OVER (PARTITION BY id) AS kk FROM nn WHERE k <= 5)
SELECT id, v AS imputed FROM nn5 WHERE k = (
  ((instr('0123456789abcdef', substr(md5(CAST(id AS VARCHAR) || ':' || 'seed'), 1, 1)) - 1) * 4096
 + (instr('0123456789abcdef', substr(md5(CAST(id AS VARCHAR) || ':' || 'seed'), 2, 1)) - 1) * 256
 + (instr('0123456789abcdef', substr(md5(CAST(id AS VARCHAR) || ':' || 'seed'), 3, 1)) - 1) * 16
 + (instr('0123456789abcdef', substr(md5(CAST(id AS VARCHAR) || ':' || 'seed'), 4, 1)) - 1)) % kk) + 1"""))
def q_pmm_donor_match(spark, d):
    """M5: k=5 nearest donors in the predicted value (here the monthly
    charge plays y^, every 7th id's usage is treated as missing)."""
    m = modeling_table(spark, d)
    sc = m.select("id", F.col("charge").alias("y"), F.when(F.col("id") % 7 != 0, F.col("qty")).alias("v"))
    return pmm_donor_match(sc, "id", "y", "v", k=5, seed="seed")


@register("impute_pmm")
def q_impute_pmm(spark, d):
    """M4: chained PMM of the incomplete usage / population columns (rows
    check: every cell filled, values drawn from observed donors)."""
    m = modeling_df(spark, d).select("id", *flows.IMPUTE_PREDICTORS, *flows.IMPUTE_TARGETS)
    m = materialize(m, "impute-input")
    return impute_pmm(m, "id", flows.IMPUTE_TARGETS, flows.IMPUTE_PREDICTORS)


@register("impute_sets")
def q_impute_sets(spark, d):
    """M4: all five completed sets, long, from the same passes (rows check)."""
    m = modeling_df(spark, d).select("id", *flows.IMPUTE_PREDICTORS, *flows.IMPUTE_TARGETS)
    m = materialize(m, "impute-input")
    return impute_sets(m, "id", flows.IMPUTE_TARGETS, flows.IMPUTE_PREDICTORS)


# --- model flows (rows-only) ------------------------------------------------
@register("forest_importance")
def q_forest_importance(spark, d):
    """L2: forest Gini importance on the prepared training part."""
    t = flows.training_flow(spark, d)
    cands = [c for c in t.train.columns if c not in flows.EXCLUDE]
    cats = [c for c in cands if dict(t.train.dtypes)[c] == "string"]
    return SE.forest_importance(t.train, "target", cands, cats, num_trees=flows.WHOLE.num_trees, seed=123, id_col="id")


@register("alpha_grid")
def q_alpha_grid(spark, d):
    """Nested CV results per (alpha, fold)."""
    return flows.training_flow(spark, d).results


@register("alpha_paths")
def q_alpha_paths(spark, d):
    """Inner-CV accuracy by lambda of every (alpha, outer fold)."""
    return flows.training_flow(spark, d).curves


@register("lambda_search")
def q_lambda_search(spark, d):
    """Inner-CV accuracy along the lambda path of the final model."""
    t = flows.training_flow(spark, d)
    return spark.createDataFrame([(float(l), float(a), float(sd)) for l, a, sd in t.fitted.lambda_path],
                                 "lambda double, cv_accuracy double, cv_sd double")


@register("lambda_curve")
def q_lambda_curve(spark, d):
    """Error by lambda with lambda.min and lambda.1se of the final model."""
    return MD.lambda_curve(q_lambda_search(spark, d), flows.WHOLE.final_folds)


@register("coef_long")
def q_coef_long(spark, d):
    """U4: class x design-column coefficients of the final model, zeros and
    intercepts removed."""
    return MD.coef_long(flows.training_flow(spark, d).fitted)


@register("elastic_net_fit")
def q_elastic_net_fit(spark, d):
    """Non-zero coefficients of the final model with odds ratios."""
    return IN.odds_ratios(MD.coef_long(flows.training_flow(spark, d).fitted))


@register("predict")
def q_predict(spark, d):
    """Predictions and probabilities on the test part."""
    t = flows.training_flow(spark, d)
    return MD.predict(t.fitted, t.test, keep=["target"])


@register("score_frame")
def q_score_frame(spark, d):
    """Test score frame with risk levels from the fitted model."""
    return flows.test_scores(spark, d).drop("classes", "probs")


@register("model_risk_summary")
def q_model_risk_summary(spark, d):
    """A8 on the fitted model's test scores."""
    from attrition.operators.risk import risk_summary
    return risk_summary(flows.test_scores(spark, d))


@register("model_evaluation")
def q_model_evaluation(spark, d):
    """Flow 2: the five summary metrics (accuracy, kappa, macro F1, macro
    AUC, log loss) of the fitted model on the test part."""
    return flows.evaluate(flows.test_scores(spark, d))[1]


@register("new_cohort_scoring")
def q_new_cohort_scoring(spark, d):
    """The recently joined cohort through fills, imputation, training
    caps, features, fitted design and model, new-cohort scoring."""
    return flows.new_cohort_scores(spark, d).drop("classes", "probs")


@register("sink_model")
def q_sink_model(spark, d):
    """Write the fitted model, all that scoring needs and the CV results
    under the shared checkpoint folder, load them again and score the test
    part: per predicted class the rows of the live and the loaded model."""
    t = flows.training_flow(spark, d)
    base = scratch_path(spark, "model")
    MD.save_model(t.fitted, base, t.bounds)
    t.results.write.mode("overwrite").parquet(f"{base}/cv_results")
    loaded, _ = MD.load_model(spark, base)
    live = MD.predict(t.fitted, t.test).select("predicted", F.lit(1).alias("live"), F.lit(0).alias("loaded"))
    back = MD.predict(loaded, t.test).select("predicted", F.lit(0).alias("live"), F.lit(1).alias("loaded"))
    return live.unionByName(back).groupBy("predicted").agg(F.sum("live").alias("n_live"), F.sum("loaded").alias("n_loaded"))
