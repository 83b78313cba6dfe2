"""Exact quantiles equal numpy's linear (type 7) quantiles."""

import numpy as np

from attrition.operators.quantiles import quantiles


def test_quantiles_type7(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.lognormal(3, 1, 5000), 2)
    grp = rng.integers(0, 3, 5000)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, x double")
    df = df.union(spark.createDataFrame([(0, None)], "g int, x double"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.67, 0.99, 1.0]
    got = {(r.g, r.prob): r.value for r in quantiles(df, ["x"], probs, by=["g"], accuracy=200).collect()}
    for g in range(3):
        for p in probs:
            assert np.isclose(got[(g, p)], np.quantile(vals[grp == g], p), rtol=1e-12, atol=1e-9)
