"""The flows on a customer table of one's own: CSV pair with plain headers,
training, scoring, new cohort, exports, a loaded model that scores alike."""

import pytest
from pyspark.sql import functions as F

from attrition.operators import modeling as MD
from attrition.plans import flows

TINY = MD.ModelConfig(alphas=(0.0, 1.0), folds=2, inner_folds=2, final_folds=2, n_lambdas=2, num_trees=5)
HEADER = ("Customer ID,Age,Zip Code,Tenure in Months,Phone Service,Multiple Lines,Online Security,Streaming TV,Contract,"
          "Payment Method,Monthly Charge,Total Charges,Avg Monthly GB Download,Customer Status,Churn Category,Churn Reason")


def customer(i: int) -> str:
    tenure, charge = i * 7 % 60, 20 + i * 13 % 80
    status = "Joined" if i % 11 == 0 else "Churned" if tenure < 20 and i % 4 else "Stayed"
    why = ("Price,Too dear" if charge > 60 else "Competitor,Better offer") if status == "Churned" else "NA,"
    contract = ("Month-to-Month", "One Year", "Two Year")[i % 3]
    online = "Yes,No" if i % 5 else ","
    download = "" if i % 6 == 0 else str(i * 3 % 50)
    return (f"C{i:04d},{18 + i % 60},{90000 + i % 9},{tenure},Yes,{'Yes' if i % 2 else 'No'},{online},{contract},"
            f"{('Bank Withdrawal', 'Credit Card', 'Mailed Check')[i % 3]},{charge},{tenure * charge},{download},{status},{why}")


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("own")
    (folder / "customers.csv").write_text("\r\n".join([HEADER, *map(customer, range(600))]) + "\r\n")
    (folder / "zip.csv").write_text("Zip Code,Population\n" + "".join(f"{90000 + k},{1000 * k + 5}\n" for k in range(8)))
    table = flows.read_customers(spark, str(folder / "customers.csv"), str(folder / "zip.csv"))
    return flows.train(table, TINY, impute_iter=1), folder


def test_columns_are_found_and_filled(trained):
    t, _ = trained
    assert t.prepared.count() == sum(i % 11 != 0 for i in range(600)) == t.train.count() + t.test.count()
    assert set(t.classes) == {"No Churn", "Price", "Competitor"}
    row = t.prepared.agg(F.max("service_count").alias("most"), F.count_if(F.col("avg_monthly_gb_download").isNull()).alias("nulls"),
                         F.count_if(F.col("population").isNull()).alias("places"), F.count("online_security").alias("known")).first()
    assert row["most"] >= 1 and row["nulls"] == 0 and row["places"] == 0 and row["known"] == t.prepared.count()
    assert t.results.count() == 4 and t.cv_preds.count() == 2 * t.train.count()


def test_exports_and_loaded_model(spark, trained):
    t, folder = trained
    out = str(folder / "out")
    flows.export_results(t, out)
    live = {r["customer_id"]: r["probs"] for r in MD.predict(t.fitted, t.test, "customer_id").collect()}
    loaded, caps = MD.load_model(spark, f"{out}/model")
    assert caps == t.bounds and (loaded.alpha, loaded.lam, loaded.selected) == (t.fitted.alpha, t.fitted.lam, t.fitted.selected)
    assert {r["customer_id"]: r["probs"] for r in MD.predict(loaded, t.test, "customer_id").collect()} == live
    rows = {n: spark.read.option("header", True).csv(f"{out}/{n}").count() for n in (
        "test_results_with_risk_scores", "recently_joined_risk_scores", "per_class_metrics", "metrics_summary", "risk_summary")}
    assert rows["test_results_with_risk_scores"] == t.test.count() == len(live)
    assert rows["recently_joined_risk_scores"] == sum(i % 11 == 0 for i in range(600))
    assert rows["per_class_metrics"] == 3 and rows["metrics_summary"] == 5 and 1 <= rows["risk_summary"] <= 4


def test_lambda_folds_do_not_follow_partitions(spark, trained):
    t, _ = trained
    paths = [MD.fit_final(t.train.repartition(n), "target", ["tenure_in_months", "monthly_charge"], t.classes, 0.0, TINY,
                          "customer_id").lambda_path for n in (1, 7)]
    for (l1, a1, s1), (l2, a2, s2) in zip(*paths):
        assert l1 == pytest.approx(l2) and a1 == pytest.approx(a2, abs=0.02) and s1 == pytest.approx(s2, abs=0.02)


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Customer ID,Age\nC1,30\n")
    with pytest.raises(ValueError, match="customer_status"):
        flows.read_customers(spark, str(tmp_path / "c.csv"))
