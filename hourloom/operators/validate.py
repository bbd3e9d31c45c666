"""Time-ordered cross-validation: folds, error measures, fold summary, leaderboard."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScaleSettings
from .scale import attach, row_positions, settle

METRICS = ("mae", "rmse", "mape", "r2")


def fold_of(position: Column, n: Column, k: int) -> Column:
    """Fold that tests a 0-based position of n rows; 0 for rows no fold tests."""
    size = F.floor(n / (k + 1))
    start = n - k * size
    return F.when(position < start, F.lit(0)).otherwise(
        F.floor((position - start) / size) + 1).cast("int")


def _time_cuts(df: DataFrame, ts: str, places, scale: ScaleSettings) -> list:
    """Values at the given places among the sorted distinct times; ``places(n)`` names them."""
    times = settle(df.select(ts).distinct())
    n = times.count()
    wanted = places(n)
    placed = row_positions(times.withColumn("__one", F.lit(1)), ["__one"], [ts], "__at", scale,
                           rows_bound=n)
    found = placed.where(F.col("__at").isin(wanted)).select("__at", ts).collect()
    at = {r["__at"]: r[ts] for r in found}
    return [at[w] for w in wanted]


def time_literal(value) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def tail_start(df: DataFrame, ts: str, share: float, scale: ScaleSettings):
    """First of the last ``share`` of the distinct times."""
    return _time_cuts(df, ts, lambda n: [min(n - 1, int(n * (1 - share)))], scale)[0]


def fold_cuts(df: DataFrame, n_splits: int = 5, ts: str = "timestamp",
              scale: ScaleSettings = ScaleSettings()) -> list:
    """First time that each fold tests; folds have equally many distinct times."""
    def places(n: int) -> list[int]:
        size = n // (n_splits + 1)
        if size == 0:
            raise ValueError(f"{n} distinct times cannot make {n_splits} folds")
        return [n - (n_splits - i) * size for i in range(n_splits)]

    return _time_cuts(df, ts, places, scale)


def fold_at(ts: Column, cuts: Sequence) -> Column:
    """The fold that tests a time; 0 for times that only train."""
    return reduce(add, [F.when(ts >= time_literal(c), 1).otherwise(0) for c in cuts]).cast("int")


def assign_folds(df: DataFrame, n_splits: int = 5, ts: str = "timestamp",
                 scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Adds ``test_fold``: fold i tests its rows and trains on ``test_fold < i``.

    All series are cut at the same times, so no series lends another its future. Only the
    ``n_splits`` cut times come to the driver, and the fold is a plain expression of the time.
    """
    return df.withColumn("test_fold", fold_at(F.col(ts), fold_cuts(df, n_splits, ts, scale)))


def assign_folds_per_series(df: DataFrame, keys: Sequence[str], n_splits: int = 5,
                            ts: str = "timestamp", scale: ScaleSettings = ScaleSettings()
                            ) -> DataFrame:
    """Folds cut by row position inside each series; a series too short for them is an error."""
    counts = settle(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total")))
    if not counts.where(F.col("__total") < n_splits + 1).isEmpty():
        raise ValueError(f"a series has fewer than {n_splits + 1} rows")
    longest = counts.agg(F.max("__total")).first()[0]
    placed = row_positions(df, keys, [ts], "__g", scale, rows_bound=longest)
    sized = attach(placed, counts, keys, scale)
    return sized.withColumn(
        "test_fold", fold_of(F.col("__g"), F.col("__total"), n_splits)).drop("__g", "__total")


def error_metrics(predictions: DataFrame, by: Sequence[str] = ("model", "fold"),
                  actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """MAE, RMSE, MAPE (only where the actual value is over 1) and R² in one aggregation."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    found = predictions.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(y > 1, F.abs(e / F.when(y > 1, y)))) * 100).alias("mape"),
        F.sum(e * e).alias("__left"), (F.var_pop(y) * F.count(y)).alias("__total"))
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(F.col("__total") > 0, 1 - F.try_divide(F.col("__left"), F.col("__total")))
          .when(F.col("__left") == 0, 1.0).otherwise(0.0))
    return found.withColumn("r2", r2).drop("__left", "__total")


def fold_summary(metrics: DataFrame, by: Sequence[str] = ("model",), digits: int = 3) -> DataFrame:
    """Mean and population deviation over the folds, rounded half-even.

    A measure missing in one fold is missing in the summary.
    """
    found = []
    for m in METRICS:
        whole = F.count(m) == F.count(F.lit(1))
        found += [F.bround(F.when(whole, F.avg(m)), digits).alias(m),
                  F.bround(F.when(whole, F.stddev_pop(m)), digits).alias(f"{m}_std")]
    return metrics.groupBy(*by).agg(*found)


def leaderboard(summary: DataFrame) -> DataFrame:
    """Models by mean absolute error, best first; one row per model."""
    return summary.orderBy(F.asc_nulls_last("mae"), "model")


def best_model(summary: DataFrame) -> DataFrame:
    """One row: the model with the least mean absolute error."""
    scored = summary.where(F.col("mae").isNotNull())
    return scored.agg(F.min_by("model", F.struct("mae", "model")).alias("model"),
                      F.min("mae").alias("mae"))


def rule_predictions(folded: DataFrame, target: str, rules: dict[str, str]) -> DataFrame:
    """Predictions of rules that are columns already; all rules in one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).alias("yhat"))
                      for name, c in rules.items()])
    return folded.where(F.col("test_fold") > 0).select(
        F.col("test_fold").alias("fold"), F.col(target).alias("y"),
        F.explode(cells).alias("c")).select("c.model", "fold", "y", "c.yhat")


def persistence_predictions(folded: DataFrame, target: str = "pm25",
                            name: str = "persistence") -> DataFrame:
    """The previous row's value as prediction; needs no training."""
    return rule_predictions(folded, target, {name: f"{target}_lag_1h"})
