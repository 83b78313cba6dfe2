"""Ties among donors, null groups, rows with null inputs, the exact interval."""

import math

import pytest


def test_tied_donors_are_taken_by_smallest_id(spark):
    from attrition.operators.impute import pmm_donor_match
    donors = [(i, 1.0, float(i)) for i in range(1, 21)] + [(i, 2.0, float(i)) for i in range(21, 41)]
    rows = donors + [(100 + i, y, None) for i, y in enumerate([0.5, 1.0, 1.2, 1.9, 2.0, 3.0] * 5)]
    got = pmm_donor_match(spark.createDataFrame(rows, "id long, yhat double, v double"), "id", "yhat", "v", k=5).collect()
    y = {i: x for i, x, _ in rows}
    assert len(got) == 30
    for r in got:
        near = sorted((abs(x - y[r["id"]]), i) for i, x, _ in donors)[:5]
        assert r["imputed"] in [i for _, i in near]


def test_box_stats_keeps_the_null_group(spark):
    from attrition.operators.outliers import box_stats
    df = spark.createDataFrame([("a", float(i)) for i in range(9)] + [(None, float(i)) for i in range(5)], "g string, x double")
    got = {r["g"]: (r["n"], r["median"]) for r in box_stats(df, "x", ["g"]).collect()}
    assert got == {"a": (9, 4.0), None: (5, 2.0)}


def test_exact_interval():
    from attrition.operators.metrics import exact_interval
    lo, hi = exact_interval(818, 1316)
    pmf = lambda p, i: math.exp(math.lgamma(1317) - math.lgamma(i + 1) - math.lgamma(1317 - i)
                                + i * math.log(p) + (1316 - i) * math.log(1 - p))
    assert sum(pmf(lo, i) for i in range(818, 1317)) == pytest.approx(0.025, abs=1e-9)
    assert sum(pmf(hi, i) for i in range(0, 819)) == pytest.approx(0.025, abs=1e-9)
    assert exact_interval(0, 10)[0] == 0 and exact_interval(10, 10)[1] == 1


def test_predict_returns_every_row(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.sql import functions as F
    from attrition.operators import modeling as M
    from attrition.operators.encode import assemble

    class Plain:
        names = ["x"]

        def scaled_columns(self):
            return [F.col("x")]

    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "id long, x double").withColumn("y", F.col("x"))
    model = LogisticRegression(featuresCol="features", labelCol="y").fit(assemble(df, Plain(), keep=["id", "y"]))
    fitted = M.FittedModel(model, Plain(), ["a", "b", "c"], 0.0, 0.0, ["x"], None)
    got = M.predict(fitted, spark.createDataFrame([(1, 1.0), (2, None)], "id long, x double")).orderBy("id").collect()
    assert [(r["id"], r["predicted"], r["probs"] is None) for r in got] == [(1, "b", False), (2, None, True)]
