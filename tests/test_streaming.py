"""The row-level risk operators run unchanged on a stream."""

from pyspark.sql import functions as F

from attrition.operators.risk import base_risk, score_risk


def test_risk_scoring_on_stream(spark, tmp_path):
    rows = [(i, ["A", "No Churn"], [0.1 * (i % 10), 1 - 0.1 * (i % 10)], i % 30, 50.0 + i,
             "Month to Month" if i % 2 else "One Year", "Mailed Check") for i in range(40)]
    batch = spark.createDataFrame(rows, "id long, classes array<string>, probs array<double>, tenure int, "
                                        "charge double, contract string, payment string")
    src = str(tmp_path / "src")
    batch.write.parquet(src)

    def score(df):
        return score_risk(df.withColumn("base_risk", base_risk(F.col("classes"), F.col("probs"))))

    expected = sorted((r.id, r.risk_category) for r in score(batch).collect())
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = (score(stream).select("id", "risk_category").writeStream.format("memory")
         .queryName("risk_stream_test").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted((r.id, r.risk_category) for r in spark.table("risk_stream_test").collect())
    assert got == expected
