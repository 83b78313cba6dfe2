"""Imputation: Gramian and posterior draw, string columns, sets, donors of
constant predictions spread over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.operators import impute as I
from attrition.operators import pmm


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b = float(rng.normal()), float(rng.normal())
        c = 3 * a - b + 0.1 * float(rng.normal())
        plan = "low" if a < -0.5 else "mid" if a < 0.5 else "high"
        rows.append((f"k{i}", a, b, None if i % 5 == 0 else c, None if i % 7 == 0 else plan, None if i % 11 == 0 else i % 4, None, "x"))
    return spark.createDataFrame(rows, "key string, a double, b double, c double, plan string, n int, nothing double, block string").repartition(4)


def test_no_null_is_left_and_fills_are_observed(table):
    got = I.impute_pmm(table, "key", ["c", "plan", "n", "nothing"], ["a", "b", "block"], max_iter=2)
    assert got.columns == table.columns and got.schema == table.schema
    before, after = {r["key"]: r for r in table.collect()}, {r["key"]: r for r in got.collect()}
    assert len(after) == 600
    for col in ("c", "plan", "n"):
        seen = {r[col] for r in before.values()} - {None}
        for key, r in after.items():
            assert r[col] in seen and before[key][col] in (None, r[col])
    assert all(r["nothing"] is None for r in after.values())
    # a and b explain c: fills lie near what they say
    near = [abs(r["c"] - 3 * r["a"] + r["b"]) for key, r in after.items() if before[key]["c"] is None]
    assert np.mean(near) < 0.5
    hits = [r["plan"] == ("low" if r["a"] < -0.5 else "mid" if r["a"] < 0.5 else "high") for key, r in after.items() if before[key]["plan"] is None]
    assert np.mean(hits) > 0.5


def test_sets_differ_and_the_first_is_returned(table):
    args = (table, "key", ["c", "plan"], ["a", "b"])
    sets = I.impute_sets(*args, m=3, max_iter=1)
    assert sets.count() == 1800 and sets.where("c IS NULL OR plan IS NULL").count() == 0
    per = {(r["set"], r["key"]): r["c"] for r in sets.collect()}
    first = {r["key"]: r["c"] for r in I.impute_pmm(*args, max_iter=1).collect()}
    assert all(per[0, key] == c for key, c in first.items())
    assert any(per[1, key] != per[2, key] for key in first)


def test_gramian_and_draw(spark, table):
    known = table.where("c IS NOT NULL")
    rows = known.select(F.lit(0).alias("set"), F.array("a", "b").alias("x"), F.col("c").alias("y"))
    gram, n = I.gramian(rows.union(table.where("c IS NULL").select(F.lit(0), F.array("a", "b"), F.col("c"))), 1, 2)
    m = np.array([(1.0, r["a"], r["b"], r["c"]) for r in known.collect()])
    assert np.allclose(gram[0], m.T @ m) and n[0] == len(m)
    fitted, _ = I.draw(gram[0], I.normals(0, "x"))
    ols = np.linalg.lstsq(m[:, :3], m[:, 3], rcond=None)[0]
    assert np.abs(fitted - ols).max() < 1e-3
    drawn = np.array([I.draw(gram[0], I.normals(0, "x", k))[1] for k in range(4000)])
    resid = m[:, 3] - m[:, :3] @ ols
    cov = np.linalg.inv(m[:, :3].T @ m[:, :3]) * (resid @ resid) / (len(m) - 3)
    assert np.abs(drawn.mean(axis=0) - ols).max() < 1e-3
    # the standard error of a covariance of 4000 draws is about its variances / 63
    assert np.abs(np.cov(drawn.T) - cov).max() < 5 * np.diag(cov).max() / 63
    assert (I.draw(gram[0], I.normals(0, "x", 7))[1] == drawn[7]).all()


def brute(rows, k):
    donors = [(y, i, v) for i, y, v in rows if v is not None and y is not None]
    return {i: [v for _, _, v in sorted((abs(y - dy), d, v) for dy, d, v in donors)[:k]]
            for i, y, v in rows if v is None and y is not None}


@pytest.mark.parametrize("kind", ["ties", "constant", "few", "spread", "none"])
def test_donors_equal_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    y = {"ties": lambda: float(rng.integers(6)), "constant": lambda: 2.0}.get(kind, lambda: float(rng.normal()))
    rows = [(i, y(), float(i) if (rng.random() < 0.6 if kind not in ("few", "none") else kind == "few" and i < 3) else None) for i in range(500)]
    rows.append((900, None, None))
    want = brute(rows, 5)
    df = spark.createDataFrame(rows, "id long, yhat double, v double").repartition(6)
    got = {r["id"]: r["imputed"] for r in I.pmm_donor_match(df, "id", "yhat", "v", k=5, seed="s").collect()}
    import hashlib
    assert set(got) == {i for i, _, v in rows if v is None}
    for i, near in want.items():
        pick = int(hashlib.md5(f"{i}:s".encode()).hexdigest()[:4], 16)
        assert got[i] == (near[pick % len(near)] if near else None)
    assert got[900] is None
    if kind == "constant":      # rows of one prediction lie in several tasks
        d = df.withColumn("s", F.xxhash64("id")).repartitionByRange(4, "yhat", "s").groupBy(F.spark_partition_id()).count()
        assert d.count() > 2


def nearest_by_hand(asked, donors, k):
    return {d[1] for d in sorted(donors, key=lambda d: (abs(d[0] - asked), d[1]))[:k]}


@pytest.mark.parametrize("spread", [1000, 40, 1])
def test_lent_donors_are_met_across_stretches(spark, spread):
    """Rows that only lend their values don't come back; answers are among the
    k nearest of all donors, also across ends of stretches and equal predictions."""
    rng = np.random.default_rng(spread)
    make = lambda first, n: [(s, first + i, float(rng.integers(0, spread))) for s in (0, 1) for i in range(n)]
    own, lent = make(0, 300), make(1000, 600)
    rows = spark.createDataFrame([(s, i, y, i % 3 == 0, i if i % 3 == 0 else None, f"r{i}") for s, i, y in own],
                                 "set int, id long, __yhat double, __donor boolean, v long, other string").repartition(5)
    more = spark.createDataFrame([(s, i, y, i) for s, i, y in lent], "set int, id long, __yhat double, v long").repartition(5)
    got = pmm.matched(rows, "id", ["v"], 5, F.col("id"), ["got"], set_col="set", donors=more)
    got = {(r["set"], r["id"]): r for r in got.collect()}
    assert len(got) == 600
    for s, i, y in own:
        donors = [(b, j) for t, j, b in own if t == s and j % 3 == 0] + [(b, j) for t, j, b in lent if t == s]
        r = got[s, i]
        assert r["other"] == f"r{i}" and (r["got"] == i if i % 3 == 0 else r["got"] in nearest_by_hand(y, donors, 5))


def test_rows_without_gaps_do_not_travel_whole(spark, table, monkeypatch):
    """Only rows with a gap are drawn once for each set; the others enter a
    step as prediction, id and value."""
    seen, plain = [], I.matched

    def matched(rows, *args, donors=None, **kw):
        seen.append((rows.count(), sorted(donors.columns), donors.count()))
        return plain(rows, *args, donors=donors, **kw)

    monkeypatch.setattr(I, "matched", matched)
    gaps = table.where("c IS NULL OR plan IS NULL").count()
    assert I.impute_sets(table, "key", ["c", "plan"], ["a", "b"], m=2, max_iter=1).count() == 1200
    assert seen == [(2 * gaps, sorted(["__yhat", t, "key", "set"]), 2 * (600 - gaps)) for t in ("c", "plan")]


def test_one_set_lends_its_rows_without_a_list_per_row(table, monkeypatch):
    """Where one set is drawn, a row that lends its value is not unfolded from a
    list of predictions; several sets still are, and lend one row for each."""
    seen, plain = [], I.matched

    def matched(rows, *args, donors=None, **kw):
        unfolded = "Generate" in donors._jdf.queryExecution().optimizedPlan().toString()
        seen.append((unfolded, sorted((r["set"], r["key"]) for r in donors.collect())))
        return plain(rows, *args, donors=donors, **kw)

    monkeypatch.setattr(I, "matched", matched)
    for m in (1, 2):
        I.impute_sets(table, "key", ["c"], ["a", "b"], m=m, max_iter=1)
    whole = sorted(r["key"] for r in table.where("c IS NOT NULL").collect())
    assert seen == [(m > 1, [(s, key) for s in range(m) for key in whole]) for m in (1, 2)]
