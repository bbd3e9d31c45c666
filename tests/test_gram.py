import numpy as np
import pytest
from helpers import plan_text
from pyspark.sql import functions as F

from hourloom.catalog.queries import _stored_features
from hourloom.models.gram import fold_ridge, series_ridge, with_prediction
from hourloom.models.trainers import fit_ridge
from hourloom.operators.validate import assign_folds


def closed_form(x, y, alpha=1.0):
    mean, sd = x.mean(0), x.std(0)
    sd[x.max(0) == x.min(0)] = np.inf
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return w, y.mean() - w @ mean


@pytest.mark.parametrize("p", [1, 2, 7])
def test_every_series_has_the_closed_form(spark, p):
    rng, rows, data = np.random.default_rng(p), [], {}
    for k in range(40):
        n = 3 + 2 * k
        x = rng.normal(size=(n, p)) * 10.0 ** rng.integers(-3, 4, p) + rng.normal(size=p) * 100
        if k % 5 == 0:
            x[:, 0] = 4.2
        y = x @ rng.normal(size=p) + rng.normal(size=n)
        data[f"s{k}"] = (x, y)
        rows += [(f"s{k}", *map(float, a), float(b)) for a, b in zip(x, y)]
    names = [f"x{i}" for i in range(p)]
    df = spark.createDataFrame(rows + [("s1", *[None] * p, 1.0)], "k string, " + ", ".join(f"{c} double" for c in [*names, "y"]))
    found = series_ridge(df, ["k"], names, "y")
    got = found.collect()
    assert len(got) == 40 and "EvalPython" not in plan_text(found) and "InArrow" not in plan_text(found)
    for r in got:
        w, b = closed_form(*data[r.k])
        assert r.n == len(data[r.k][1])
        np.testing.assert_allclose(r.weights, w, rtol=1e-7, atol=1e-9)
        assert r.intercept == pytest.approx(b, rel=1e-7, abs=1e-7)


def test_constant_target_and_single_row(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("b", 1.0, 7.0)], "k string, x double, y double")
    got = {r.k: (r.weights, r.intercept) for r in series_ridge(df, ["k"], ["x"], "y").collect()}
    assert got == {"a": ([0.0], 5.0), "b": ([0.0], 7.0)}


@pytest.fixture(scope="module")
def folded(spark, folder):
    rows, names = _stored_features(spark, folder)
    return assign_folds(rows), names


def test_folds_from_one_pass_equal_separate_fits(folded):
    rows, names = folded
    found = {r.fold: r for r in fold_ridge(rows, names, "pm25").collect()}
    assert set(found) == set(range(1, 6))
    for i, r in found.items():
        model = fit_ridge(rows.where(F.col("test_fold") < i), names, "pm25").stages
        weights = dict(zip(model[0].getInputCols(), model[1].coefficients.toArray()))
        np.testing.assert_allclose(r.weights, [weights.get(n, 0.0) for n in names], rtol=1e-5, atol=1e-7)
        assert r.intercept == pytest.approx(model[1].intercept, rel=1e-6, abs=1e-6)


def test_normal_equations_hold(folded):
    rows, names = folded
    models = fold_ridge(rows, names, "pm25")
    last = models.where("fold = 5").first()
    train = rows.where("test_fold < 5").select(*names, "pm25").toPandas()
    x, y = train[names].to_numpy(float), train["pm25"].to_numpy(float)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    left = z.T @ (y - x @ np.array(last.weights) - last.intercept) - np.array(last.weights) * sd
    assert np.abs(left).max() < 1e-8 * np.abs(z.T @ y).max()


def test_predictions_by_series(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(50)] + [("c", 0.0, 0.0)], "k string, x double, y double")
    models = series_ridge(df.where("k = 'a'"), ["k"], ["x"], "y")
    out = {(r.k, r.x): r.prediction for r in with_prediction(df, models, ["k"], ["x"]).collect()}
    assert out["c", 0.0] is None and out["a", 10.0] == pytest.approx(50 + 2 * 50 / 51 * (10 - 24.5))
