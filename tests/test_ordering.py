"""bucketed_running equals the single-partition window, also with one hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from attrition.operators.ordering import bucketed_running


def test_bucketed_matches_plain_window(spark):
    # key 0 holds half of all rows (hot key)
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 7 + 1).alias("k"),
        F.col("id"), ((F.col("id") * 7919) % 1000).alias("o"), (F.col("id") % 13).cast("double").alias("v"))
    got = bucketed_running(df, ["k"], (F.col("o") / 50).cast("int"), ["o", "id"], row_number="rn",
                           key_count="n", sums={"cs": F.col("v")}, nexts={"nx": F.col("v")})
    w = Window.partitionBy("k").orderBy("o", "id")
    exp = df.select("k", "id", F.row_number().over(w).cast("bigint").alias("rn"),
                    F.count(F.lit(1)).over(Window.partitionBy("k")).alias("n"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"),
                    F.lead("v").over(w).alias("nx"))
    a = sorted(tuple(r) for r in got.select("k", "id", "rn", "n", "cs", "nx").collect())
    b = sorted(tuple(r) for r in exp.collect())
    assert a == b


def test_snap_hot_customer_path_matches(spark):
    """The snapshot's per-customer windows give the same rows whether or not
    customers are split by day (threshold 0 forces the split path)."""
    from conftest import SF0001
    from attrition.sources.fixtures import snap
    a = sorted(tuple(r) for r in snap(spark, SF0001).collect())
    b = sorted(tuple(r) for r in snap(spark, SF0001, hot_customer_rows=0).collect())
    assert a == b
