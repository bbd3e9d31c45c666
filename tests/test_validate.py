import pytest
from helpers import hours
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hourloom.functions.risk import risk_band
from hourloom.operators import validate


def test_folds_are_ordered_and_disjoint(spark):
    df = hours(spark, [float(i) for i in range(103)])
    folds = [r["test_fold"] for r in validate.assign_folds(df).orderBy("timestamp").collect()]
    assert folds == sorted(folds)
    assert [folds.count(i) for i in range(6)] == [18, 17, 17, 17, 17, 17]
    per = validate.assign_folds_per_series(df, ["station"]).orderBy("timestamp").collect()
    assert [r["test_fold"] for r in per] == folds


def test_series_share_their_cut_times(spark):
    long = hours(spark, [1.0] * 60, "a")
    late = hours(spark, [1.0] * 60, "b").where("timestamp >= '2024-01-02 12:00:00'")
    out = validate.assign_folds(long.union(late))
    spread = out.groupBy("timestamp").agg(F.countDistinct("test_fold").alias("n"))
    assert spread.where("n > 1").isEmpty()


def test_too_few_rows_is_an_error(spark):
    df = hours(spark, [1.0] * 5)
    with pytest.raises(ValueError):
        validate.assign_folds(df, 5)
    with pytest.raises(ValueError):
        validate.assign_folds_per_series(df, ["station"], 5)


def test_metric_edges(spark):
    rows = [("const_hit", 1, 5.0, 5.0), ("const_hit", 1, 5.0, 5.0),
            ("const_miss", 1, 5.0, 4.0), ("const_miss", 1, 5.0, 6.0),
            ("one", 1, 5.0, 4.0), ("low", 1, 0.5, 1.0), ("low", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, fold int, y double, yhat double")
    out = {r["model"]: r for r in validate.error_metrics(df).collect()}
    assert out["const_hit"]["r2"] == 1.0 and out["const_miss"]["r2"] == 0.0
    assert out["one"]["r2"] is None and out["one"]["mape"] == pytest.approx(20)
    assert out["low"]["mape"] is None and out["low"]["mae"] == 0.25


def test_summary_rounds_half_even_and_keeps_gaps(spark):
    rows = [("a", 1, 0.0625, 1.0, 1.0, 1.0), ("a", 2, 0.0625, 1.0, None, 1.0)]
    df = spark.createDataFrame(
        rows, "model string, fold int, mae double, rmse double, mape double, r2 double")
    row = validate.fold_summary(df).first()
    assert row["mae"] == 0.062 and row["mae_std"] == 0.0 and row["mape"] is None


def test_best_model_ignores_missing_scores(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("c", 1.0)], "model string, mae double")
    assert validate.best_model(df).first()["model"] == "c"
    assert [r["model"] for r in validate.leaderboard(df).collect()] == ["c", "b", "a"]


def test_risk_edges(spark):
    values = [-1.0, 0.0, 11.99, 12.0, 35.0, 55.0, 998.0, 999.0, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    bands = [r["b"] for r in df.select("i", risk_band(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bands == [4, 1, 1, 2, 3, 4, 4, 4, 4, 4]


@given(st.integers(6, 5000), st.integers(1, 5))
def test_fold_rule_covers_every_tested_row_once(n, k):
    size = n // (k + 1)
    starts = [n - (k - i) * size for i in range(k)]
    assert starts[0] > 0 and starts[-1] + size == n
