"""The shared-pass search against Spark ML's single fits, its ledger and its
stand-in Hessian."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from attrition.operators import path as PA

ALPHAS, FOLDS, LAMBDAS, CLASSES = (0.0, 0.5), 2, 5, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 5))
    x[:, 4] = x[:, 0] + 0.1 * x[:, 4]
    z = x[:, :3] @ rng.normal(size=(3, CLASSES)) + rng.gumbel(size=(2000, CLASSES))
    y = z.argmax(axis=1)
    table = spark.createDataFrame([(i, int(y[i]), i % 2, (i // 2) % FOLDS, x[i].tolist()) for i in range(2000)],
                                  "id long, y int, outer int, inner int, x array<double>")
    parts = F.array(*[F.when(F.col("outer") == g, F.lit(PA.VALIDATION)).otherwise(F.col("inner")) for g in range(2)])
    rows = table.select("id", "y", parts.alias("parts"), "x").repartition(2).persist()
    weights = np.array([1.0, 2.0, 0.5])
    # the second group scales its columns by itself and lacks one
    scale, shift = np.array([1.0, 0.5, 2.0, 0.0, 1.0]), np.array([0.0, 0.3, -1.0, 0.0, 0.0])
    groups = [PA.Group(np.ones(5), np.zeros(5), weights, FOLDS, ALPHAS), PA.Group(scale, shift, weights, FOLDS, ALPHAS)]
    return table, rows, groups


def test_paths_equal_single_fits(data):
    table, rows, groups = data
    found = PA.search(rows, groups, 5, CLASSES, LAMBDAS, 1e-2, tol=1e-7)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in groups[0].weights]), F.col("y") + 1)
    for g, group in enumerate(groups):
        x = np.array([r["x"] for r in table.where(f"outer <> {g}").select("x").collect()])
        own = F.array(*[F.col("x")[j] * float(group.scale[j]) + float(group.shift[j]) for j in range(5)])
        vec = table.where(f"outer <> {g}").select("y", "inner", weight.alias("w"), array_to_vector(own).alias("f")).coalesce(1).persist()
        for alpha in ALPHAS:
            f = found[g][alpha]
            assert len(f.lambdas) == LAMBDAS and f.lambdas[0] / f.lambdas[-1] == pytest.approx(100)
            for k, lam in enumerate(f.lambdas):
                def fit(rows_):
                    return LogisticRegression(family="multinomial", elasticNetParam=alpha, regParam=lam, standardization=False,
                                              labelCol="y", featuresCol="f", weightCol="w", maxIter=300, tol=1e-10).fit(rows_)
                model = fit(vec)
                b = f.coefficients[k]
                assert np.abs(model.coefficientMatrix.toArray().T - b[1:]).max() < 1e-4
                i = model.interceptVector.toArray()
                assert np.abs((i - i.mean()) - (b[0] - b[0].mean())).max() < 1e-4
                if (g, alpha, k) == (1, 0.5, 2):
                    for fold in range(FOLDS):
                        held = fit(vec.where(F.col("inner") != fold)).transform(vec.where(F.col("inner") == fold))
                        hits = held.agg(F.sum(F.when(F.col("prediction") == F.col("y"), F.col("w")).otherwise(0.0)) / F.sum("w")).first()[0]
                        assert hits == pytest.approx(f.accuracy[fold, k], abs=0.02)
        assert len(x)


def test_the_stand_in_hessian_leads_to_the_same_paths(data, monkeypatch):
    _, rows, groups = data
    exact = PA.search(rows, groups, 5, CLASSES, 3, 1e-1, tol=1e-6)[0]
    monkeypatch.setattr(PA, "HESSIAN_BYTES", 0)
    other = PA.search(rows, groups, 5, CLASSES, 3, 1e-1, tol=1e-6)[0]
    for a in ALPHAS:
        assert np.allclose(exact[a].accuracy, other[a].accuracy)
        for b, c in zip(exact[a].coefficients, other[a].coefficients):
            assert np.abs(b[1:] - c[1:]).max() < 1e-4


def test_partial_sums_by_tasks(data, monkeypatch):
    _, rows, groups = data
    want = PA.gramians(rows, groups, 5, CLASSES)
    monkeypatch.setattr(PA, "STRAIGHT", 0)
    got = PA.gramians(rows.repartition(20), groups, 5, CLASSES)
    for (g, w), (h, v) in zip(want, got):
        assert np.allclose(g, h) and np.allclose(w, v)


def test_a_killed_search_goes_on(spark, data, tmp_path, monkeypatch):
    _, rows, groups = data
    whole = PA.search(rows, groups, 5, CLASSES, LAMBDAS, 1e-2, tol=1e-7)
    calls, run = [], PA.one_pass

    def dies(*args, **more):
        calls.append(1)
        if len(calls) == 5:
            raise KeyboardInterrupt
        return run(*args, **more)

    monkeypatch.setattr(PA, "one_pass", dies)
    with pytest.raises(KeyboardInterrupt):
        PA.search(rows, groups, 5, CLASSES, LAMBDAS, 1e-2, tol=1e-7, ledger=PA.Ledger(spark, str(tmp_path / "l"), "s"), flush_seconds=0)
    monkeypatch.setattr(PA, "one_pass", run)
    left = PA.Ledger(spark, str(tmp_path / "l"), "s")
    before = left.read().count()
    assert 0 < before < len(ALPHAS) * (FOLDS + 1) * 2 * LAMBDAS
    again = PA.search(rows, groups, 5, CLASSES, LAMBDAS, 1e-2, tol=1e-7, ledger=left)
    for g in range(2):
        for a in ALPHAS:
            assert np.allclose(again[g][a].accuracy, whole[g][a].accuracy, atol=0.02)
            assert max(np.abs(b - c).max() for b, c in zip(again[g][a].coefficients, whole[g][a].coefficients)) < 1e-4
    # now all is known: no pass beyond the first one
    calls.clear()
    monkeypatch.setattr(PA, "one_pass", lambda *a, **k: calls.append(1) or run(*a, **k))
    PA.search(rows, groups, 5, CLASSES, LAMBDAS, 1e-2, tol=1e-7, ledger=PA.Ledger(spark, str(tmp_path / "l"), "s"))
    assert len(calls) == 1 and PA.Ledger(spark, str(tmp_path / "l"), "other").read() is None


def test_predictions_are_of_validation_rows(spark, data):
    table, rows, groups = data
    b = np.zeros((6, CLASSES))
    b[1, 2] = 5.0       # class 2 where the first column is above 0
    b[0, 1] = 0.1
    got = PA.predictions(rows, [(1, 0.5, PA.shared_coefficients(groups[1], b))], ["a", "b", "c"], 2, 5, "long").collect()
    want = {r["id"]: ("abc"[r["y"]], "c" if 5 * r["x"][0] > 0.1 else "b") for r in table.where("outer = 1").collect()}
    assert {r["id"]: (r["actual"], r["predicted"]) for r in got} == want


def test_null_in_the_design_is_an_error(spark, data):
    _, _, groups = data
    rows = spark.createDataFrame([(1, 0, [0, 0], [1.0, None, 1.0, 1.0, 1.0])], "id long, y int, parts array<int>, x array<double>")
    with pytest.raises(Exception, match="impute first"):
        PA.gramians(rows, groups, 5, CLASSES)


def test_newton_reaches_the_minimum_with_collinear_columns():
    """A column and its near copy: the optimality conditions hold, whatever their correlation."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x[:, 4] = x[:, 3] + 1e-3 * x[:, 4]
    h = np.kron(x.T @ x / 400, np.eye(3)) + 0.2 * np.eye(18)
    g = rng.normal(size=(6, 3))
    b = rng.normal(size=(6, 3)) * (rng.random((6, 3)) < 0.5)
    for alpha in (0.0, 0.5, 1.0):
        got = PA.newton(b, g, h, 0.3, alpha, 1e-10)
        slope = g.ravel() + h @ (got - b).ravel()
        far = PA.residual(got[None], slope.reshape(1, 6, 3), np.array([0.3]), np.array([alpha]))
        assert far[0] < 1e-7


def test_newton_goes_on_where_free_columns_make_up_for_a_zero():
    """A zero violates the conditions by less than what the free columns are
    off together: it must not become free and zero again for ever."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[:, 3] = x[:, 1] + x[:, 2] + 1e-3 * x[:, 3]
    h, until, lam = x.T @ x / 300, 1e-3, 0.3
    b = np.array([[0.0], [1.0], [1.0], [0.0]])
    g = np.array([[0.0], [-lam + 0.9 * until], [-lam + 0.9 * until], [lam + 1.5 * until]])
    got = PA.newton(b, g, h, lam, 1.0, until)
    slope = g.ravel() + h @ (got - b).ravel()
    assert PA.residual(got[None], slope.reshape(1, 4, 1), np.array([lam]), np.array([1.0]))[0] <= until


def test_corrected_hessian_tells_the_last_move():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 6))
    h, true = a.T @ a / 40, a[:20].T @ a[:20] / 20
    moves = [rng.normal(size=6) for _ in range(3)]
    got = PA.corrected(h, [(s, true @ s) for s in moves] + [(np.zeros(6), np.zeros(6)), (moves[0], -moves[0])])
    assert np.allclose(got @ moves[-1], true @ moves[-1])
    assert np.linalg.eigvalsh(got)[0] > 0
    assert np.array_equal(PA.corrected(h, []), h)


def test_a_pass_is_the_sum_over_the_rows(data):
    """Loss, hits on the held-out fold (ties go to the first class), gradient and curvature against sums over collected rows."""
    table, rows, groups = data
    rng = np.random.default_rng(8)
    hold = np.array([PA.NO_FOLD, 1, 0, 0])
    c = rng.normal(size=(4, 6, CLASSES))
    c[3] = 0.0
    got = PA.one_pass(rows, [(1, groups[1].weights, hold, c)], 2, 5, CLASSES)[0]
    every = table.where("outer <> 1").collect()
    x, y = np.array([[1.0, *r["x"]] for r in every]), np.array([r["y"] for r in every])
    w, inner = groups[1].weights[y], np.array([r["inner"] for r in every])
    for m, f in enumerate(hold):
        z, train = x @ c[m], inner != f
        q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        wt = (w * train)[:, None]
        assert got[0][m] == pytest.approx(-(wt[:, 0] * np.log(q[np.arange(len(y)), y])).sum())
        assert got[1][m] == pytest.approx((w * ~train * (z.argmax(axis=1) == y)).sum())
        assert np.allclose(got[2][m], x.T @ (wt * (q - np.eye(CLASSES)[y])))
        assert np.allclose(got[3][m], np.diag((wt * q).sum(axis=0)) - (wt * q).T @ q)


def test_sums_in_single_precision(data):
    """Logits beyond the range of the exponential too; Hessians against sums over collected rows."""
    table, rows, groups = data
    rng = np.random.default_rng(9)
    hold = np.array([PA.NO_FOLD, 1, 0])
    c = rng.normal(size=(3, 6, CLASSES))
    c[2] *= 300
    asked = [(1, groups[1].weights, hold, c)]
    want, got = (PA.one_pass(rows, asked, 2, 5, CLASSES, True, single)[0] for single in (False, True))
    every = table.where("outer <> 1").collect()
    total = groups[1].weights[[r["y"] for r in every]].sum()
    for a, b in zip(want, got):
        assert np.abs(a[:2] - b[:2]).max() / total < 1e-6 and np.allclose(a[2], b[2], rtol=1e-3, atol=1e-3 * total)
    x, y = np.array([[1.0, *r["x"]] for r in every]), np.array([r["y"] for r in every])
    z = x @ c[2]
    w = groups[1].weights[y] * (np.array([r["inner"] for r in every]) != 0)
    assert want[0][2] == pytest.approx((w * (z.max(axis=1) + np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) - z[np.arange(len(y)), y])).sum())
    for single in (False, True):
        h = PA.hessians(rows, asked, 2, 5, CLASSES, single)[0][1]
        q = np.exp(x @ c[1]) / np.exp(x @ c[1]).sum(axis=1, keepdims=True)
        w = groups[1].weights[y] * (np.array([r["inner"] for r in every]) != 1)
        own = np.einsum("r,ri,rk,rj,rl->ikjl", w, x, q, x, -q)
        for k in range(CLASSES):
            own[:, k, :, k] += (x * (w * q[:, k])[:, None]).T @ x
        assert np.abs(h - own).max() < (1e-5 if single else 1e-9) * total


def test_a_search_in_single_precision_finds_the_same_paths(data):
    _, rows, groups = data
    log, exact = [], PA.search(rows, groups, 5, CLASSES, 8, 1e-2, tol=1e-7)
    got = PA.search(rows, groups, 5, CLASSES, 8, 1e-2, tol=1e-6, log=log)
    for g in range(2):
        for a in ALPHAS:
            assert max(np.abs(b[1:] - c[1:]).max() for b, c in zip(got[g][a].coefficients, exact[g][a].coefficients)) < 1e-3
            assert np.allclose(got[g][a].accuracy, exact[g][a].accuracy, atol=0.01)
    assert sum(worse for _, worse, _ in log) <= 0.02 * sum(n for n, _, _ in log)     # rounding makes no step look uphill


def test_a_pass_tries_several_lambdas(data):
    """More trials than models in a pass; the results are those of an exact search."""
    _, rows, groups = data
    log = []
    seen = PA.search(rows, groups, 5, CLASSES, 40, 0.3, tol=1e-5, log=log)[0]
    assert max(n for n, _, _ in log) > 2 * len(ALPHAS) * (FOLDS + 1)
    exact = PA.search(rows, groups, 5, CLASSES, 40, 0.3, tol=1e-7)[0]
    for a in ALPHAS:
        assert all(c is not None for c in seen[a].coefficients)
        assert max(np.abs(b[1:] - c[1:]).max() for b, c in zip(seen[a].coefficients, exact[a].coefficients)) < 1e-3
        assert np.allclose(seen[a].accuracy, exact[a].accuracy, atol=0.01)
