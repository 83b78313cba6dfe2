"""End-to-end training / scoring flow on sf0.001 with a tiny grid, and
the model invariants: probabilities sum to 1, ridge coefficients sum to
~0 over classes for each design column, risk levels only from the four
bins, every test row scored once."""

import pytest
from pyspark.sql import functions as F

from attrition.operators import modeling as MD
from attrition.plans import flows

TINY = MD.ModelConfig(alphas=(0.0,), folds=2, inner_folds=2, n_lambdas=2, num_trees=5)


@pytest.fixture(scope="module")
def trained(spark):
    from conftest import SF0001
    return flows.training_flow(spark, SF0001, TINY)


def test_training_flow(spark, trained):
    t = trained
    assert t.results.count() == len(TINY.alphas) * TINY.folds
    assert t.fitted.alpha == 0.0 and t.fitted.lam > 0
    assert t.fitted.selected
    coefs = MD.coef_long(t.fitted).groupBy("feature").agg(F.sum("coefficient").alias("s"))
    assert coefs.agg(F.max(F.abs("s"))).first()[0] < 1e-3


def test_scores(spark, trained):
    from conftest import SF0001
    s = flows.test_scores(spark, SF0001, TINY)
    n_test = trained.test.count()
    assert s.count() == n_test == s.select("id").distinct().count()
    sums = s.select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("p"))
    assert sums.agg(F.max(F.abs(F.col("p") - 1.0))).first()[0] < 1e-9
    levels = {r[0] for r in s.select("risk_category").distinct().collect()}
    assert levels <= {"Low", "Medium", "High", "Critical"}


def test_registered_queries_run_the_whole_search(spark, monkeypatch):
    from conftest import SF0001
    from attrition.plans.registry import QUERIES, load_all

    class Asked(Exception):
        pass

    def asked(customers, cfg, roles, impute_iter):
        raise Asked(cfg, impute_iter)

    load_all()
    monkeypatch.setattr(flows, "_CACHE", {})
    monkeypatch.setattr(flows, "train", asked)
    for name in ("alpha_grid", "lambda_search", "lambda_curve", "forest_importance", "elastic_net_fit", "coef_long", "predict",
                 "score_frame", "model_risk_summary", "model_evaluation", "new_cohort_scoring", "sink_model"):
        with pytest.raises(Asked) as found:
            QUERIES[name](spark, SF0001)
        assert found.value.args == (MD.ModelConfig(), 5), name
