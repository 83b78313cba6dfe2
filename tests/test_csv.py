"""CSV with CRLF line ends and several null tokens."""

from pyspark.sql import types as T

from attrition.sources.csv import infer_numeric, scan_csv


def test_scan_csv_tokens_and_crlf(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_bytes(b"Zip Code,Population,Note\r\n90001,54492,a\r\n90002,NA,\r\n90003, ,NULL\r\nNULL,10,b\r\n")
    schema = T.StructType([T.StructField("Zip Code", T.IntegerType()), T.StructField("Population", T.IntegerType()),
                           T.StructField("Note", T.StringType())])
    rows = sorted(scan_csv(spark, str(p), schema=schema).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r) for r in rows] == [(90001, 54492, "a"), (90002, None, None), (90003, None, None),
                                        (None, 10, "b")]
    inferred = infer_numeric(scan_csv(spark, str(p)))
    assert dict(inferred.dtypes) == {"Zip Code": "bigint", "Population": "bigint", "Note": "string"}
