"""R-style null semantics helpers on three-valued inputs."""

from pyspark.sql import functions as F

from attrition.functions.exprs import cut_right_closed, hex_digits_value
from attrition.functions.nulls import count_equal, if_else_null, in_set, not_in, pmax, pmin


def test_null_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, "Yes"), (None, 5.0, None), (3, None, "No")], "a int, b double, s string")
    r = df.select(
        if_else_null(F.col("a") > 1, F.lit("big"), F.lit("small")).alias("ie"),
        in_set(F.col("s"), ["Yes"]).alias("isin"),
        not_in(F.col("s"), ["Yes"]).alias("notin"),
        pmin(F.col("a").cast("double"), F.col("b")).alias("mn"),
        pmax(F.col("a").cast("double"), F.col("b")).alias("mx"),
        count_equal([F.col("s"), F.lit("Yes")], "Yes").alias("cnt"),
    ).collect()
    assert [x.ie for x in r] == ["small", None, "big"]
    assert [x.isin for x in r] == [True, False, False]
    assert [x.notin for x in r] == [False, True, True]        # null kept by !%in%
    assert [x.mn for x in r] == [1.0, None, None]             # pmin propagates null
    assert [x.mx for x in r] == [2.0, None, None]
    assert [x.cnt for x in r] == [2, 1, 1]                    # null counts 0


def test_cut_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.2500001,), (1.0,), (1.2,), (None,)], "x double")
    r = [x[0] for x in df.select(cut_right_closed(F.col("x"), [0, .25, .5, .75, 1.0],
                                                  ["Low", "Medium", "High", "Critical"])).collect()]
    assert r == ["Low", "Low", "Medium", "Critical", None, None]


def test_hex_digits(spark):
    r = spark.range(1).select(hex_digits_value(F.lit("ff0a"), 1, 4).alias("v")).first().v
    assert r == 0xFF0A
