import random

import numpy as np
import pytest
from helpers import hours
from pyspark.sql import functions as F

from hourloom.catalog.queries import scratch
from hourloom.config import (
    BoostingSettings, ExperimentSettings, ForestSettings,
)
from hourloom.models.bundle import Bundle, align_features, load_bundle, save_bundle, score_recent
from hourloom.models.trainers import (
    first_rounds, fit, fit_boosting, fit_ridge, fit_until_patience, importances, stats_before_folds,
    tail_errors, top_importances, train_stats,
)
from hourloom.operators.scale import settle
from hourloom.operators.validate import assign_folds
from hourloom.plans.experiment import run_experiment

NAMES = ["pm25_lag_1h", "x", "const"]
SMALL = ExperimentSettings(
    n_splits=3, forest=ForestSettings(trees=10, depth=5),
    boosting=BoostingSettings(rounds=8, depth=3, step=0.3))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    df = hours(spark, [rng.uniform(5, 80) for _ in range(240)], column="pm25_lag_1h")
    noise = (F.xxhash64("timestamp") % 1000).cast("double") / 500
    return settle(df.withColumns({
        "x": noise, "const": F.lit(3.0),
        "pm25": 4 + 0.8 * F.col("pm25_lag_1h") - 6 * noise + F.sin("pm25_lag_1h")}))


def test_ridge_equals_closed_form(rows):
    model = fit_ridge(rows, NAMES, "pm25")
    got = [r["prediction"] for r in model.transform(rows).orderBy("timestamp").collect()]
    p = rows.toPandas().sort_values("timestamp")
    x = p[["pm25_lag_1h", "x"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = p.pm25.to_numpy()
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert got == pytest.approx(list(z @ w + y.mean()), abs=1e-9)


def test_one_pass_gives_the_statistics_of_every_training_set(rows):
    folded = assign_folds(rows, 3)
    found = stats_before_folds(folded, NAMES, "pm25")
    for i in (1, 2, 3):
        alone = train_stats(folded.where(F.col("test_fold") < i), NAMES, "pm25")
        assert (found[i].n, found[i].low, found[i].high) == (alone.n, alone.low, alone.high)
        assert found[i].mean == pytest.approx(alone.mean)
        assert found[i].squares == pytest.approx(alone.squares)


def test_ridge_on_constant_target(rows):
    model = fit_ridge(rows.withColumn("pm25", F.lit(2.5)), NAMES, "pm25")
    assert {r["prediction"] for r in model.transform(rows).collect()} == {2.5}


@pytest.mark.parametrize("name", ["forest", "boosting"])
def test_trees_learn_and_explain(spark, rows, name):
    model = fit(name, rows, NAMES, "pm25", SMALL)
    row = model.transform(rows).select(
        F.avg(F.abs(F.col("pm25") - F.col("prediction"))).alias("mae"),
        F.max(F.isnan("prediction")).alias("bad")).first()
    spread = rows.select(F.avg(F.abs(F.col("pm25") - rows.agg(F.avg("pm25")).first()[0]))).first()[0]
    assert not row["bad"] and row["mae"] < spread
    weights = importances(model, NAMES, spark).collect()
    assert sum(r["importance"] for r in weights) == pytest.approx(1)
    assert weights[0]["feature"] == "pm25_lag_1h"
    assert [r["feature"] for r in top_importances(model, NAMES, spark, 1).collect()] == [
        "pm25_lag_1h"]


def test_linear_model_has_no_importances(spark, rows):
    with pytest.raises(ValueError):
        importances(fit_ridge(rows, NAMES, "pm25"), NAMES, spark)


def test_absent_feature_is_an_error(rows):
    with pytest.raises(ValueError, match="nope"):
        align_features(rows, ["x", "nope"])


def test_missing_bundle_is_an_error(spark):
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, scratch(spark))


@pytest.mark.parametrize("name", ["ridge", "forest", "persistence"])
def test_saved_model_scores_the_same(spark, rows, name):
    path = scratch(spark)
    bundle = Bundle(fit(name, rows, NAMES, "pm25", SMALL), name, tuple(NAMES), "pm25")
    save_bundle(spark, bundle, path)
    back = load_bundle(spark, path)
    assert (back.name, back.features, back.target) == (name, tuple(NAMES), "pm25")
    a, b = (score_recent(m, rows, 48, ["station"]).orderBy("timestamp").collect()
            for m in (bundle, back))
    assert len(a) == 48 and a == b


def test_experiment_ranks_and_saves_the_best(spark, rows):
    path = scratch(spark)
    result = run_experiment(rows, NAMES, settings=SMALL, out=path)
    board = result.scores.collect()
    assert [r["mae"] for r in board] == sorted(r["mae"] for r in board)
    assert {r["model"] for r in board} == {"persistence", "ridge", "forest", "boosting"}
    assert result.best.name == board[0]["model"] == load_bundle(spark, f"{path}/best").name
    assert spark.read.json(f"{path}/results").count() == 4


def test_early_stopping_waits_for_the_best_round(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, size=(2500, 4))
    y = 10 * np.sin(2 * x[:, 0]) + 4 * x[:, 1] ** 2 + rng.normal(0, 0.5, 2500)
    df = hours(spark, y.tolist(), column="pm25").toPandas()
    names = ["x0", "x1", "x2", "x3"]
    df[names] = x
    rows = settle(spark.createDataFrame(df))
    head, test = rows.where("timestamp < '2024-03-20'"), rows.where("timestamp >= '2024-03-20'")

    def mae(model):
        return model.transform(test).agg(F.avg(F.abs(F.col("pm25") - F.col("prediction")))).first()[0]

    settings = BoostingSettings(rounds=120, depth=3, patience=30)
    model = fit_boosting(head, names, "pm25", settings)
    rounds = model.stages[-1].getNumTrees
    few = fit_boosting(head, names, "pm25", BoostingSettings(rounds=10, depth=3), stop_early=False)
    assert rounds > 50 and mae(model) < 0.6 * mae(few)
    errors = tail_errors(model, head, "pm25", settings=settings)
    assert len(errors) == rounds and min(errors) == errors[-1]


def test_early_stopping_on_noise_keeps_few_rounds(spark):
    rng = np.random.default_rng(4)
    df = hours(spark, rng.normal(size=400).tolist(), column="pm25").toPandas()
    df["x"] = rng.normal(size=400)
    model = fit_boosting(spark.createDataFrame(df), ["x"], "pm25", BoostingSettings(rounds=60, depth=3, patience=10))
    assert model.stages[-1].getNumTrees < 60


def test_a_strong_signal_takes_more_than_one_round(spark):
    """Each round removes a part of the error, so a model that stopped at the first would be wrong."""
    df = hours(spark, [float(i % 29) for i in range(300)], column="x").withColumn("pm25", 10 * F.col("x"))
    settings = BoostingSettings(rounds=40, depth=3, step=0.1, patience=5)
    model, tried = fit_until_patience(df, ["x"], "pm25", settings)
    best = tried.index(min(tried)) + 1
    assert best > 10 and len(tried) >= min(settings.rounds, best + 5)
    assert tail_errors(model, df, "pm25", settings=settings) == pytest.approx(tried[:best])


def test_first_rounds_are_the_model_fitted_with_so_many(rows, spark):
    whole = fit_boosting(rows, NAMES, "pm25", BoostingSettings(rounds=8, depth=3), stop_early=False)
    few = fit_boosting(rows, NAMES, "pm25", BoostingSettings(rounds=3, depth=3), stop_early=False)
    cut = first_rounds(whole.stages[-1], 3)
    ready = whole.stages[0].transform(rows)
    got, want = ([r["prediction"] for r in m.transform(ready).orderBy("timestamp").collect()] for m in (cut, few.stages[-1]))
    assert got == pytest.approx(want) and len(cut.featureImportances) == len(NAMES)
    assert cut.evaluateEachIteration(ready, "squared") == pytest.approx(whole.stages[-1].evaluateEachIteration(ready, "squared")[:3])
    path = scratch(spark)
    cut.write().save(path)
    again = type(cut).load(path).transform(ready).orderBy("timestamp").collect()
    assert [r["prediction"] for r in again] == pytest.approx(want)
