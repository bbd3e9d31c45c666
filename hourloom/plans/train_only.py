"""Cleaning that learns from training rows only, and models compared on it.

Cleaning a whole table looks ahead: fences are quartiles of all rows, a gap is drawn towards a later
value, and the first known weather fills the hours before it. Here each fold has a copy of its rows
that is cleaned with what its training rows know.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import (
    READING_COLUMNS, WEATHER_COLUMNS, CleanSettings, ExperimentSettings, FeatureSettings,
    ScaleSettings,
)
from ..functions.scalars import clip_lower, clip_upper, nan_free
from ..models.trainers import PREDICTION, fit
from ..operators.align import to_hour
from ..operators.features import all_features, complete_rows, feature_names
from ..operators.fences import QUARTILES, fence
from ..operators.fill import fill_series
from ..operators.order_stats import nested_quantiles, quantile_name
from ..operators.scale import attach, settle, settle_rows
from ..operators.validate import error_metrics, fold_at, fold_cuts, fold_summary
from .clean import panel_within

TRAIN, TEST = "train", "test"


def fold_fences(panel: DataFrame, columns: Sequence[str], keys: Sequence[str], n_splits: int,
                factor: float = 3.0, stage: str = "test_fold",
                scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """``<column>_fence`` of every series and ``fold``, from the rows before the fold.

    The training rows of a fold are those of the fold before and one part more, so each part is
    counted once for all folds.
    """
    found = nested_quantiles(panel, columns, QUARTILES, keys, stage, range(1, n_splits + 1), scale)
    low, high = ([F.col(quantile_name(c, p)) for c in columns] for p in QUARTILES)
    return found.select(*keys, F.col(stage).alias("fold"), *[
        fence(a, b, factor).alias(f"{c}_fence") for c, a, b in zip(columns, low, high)])


def clean_train_only(readings: DataFrame, weather: DataFrame, key: str, ts: str = "timestamp",
                     n_splits: int = 5, settings: CleanSettings = CleanSettings(),
                     scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """A cleaned copy of every fold's rows: ``fold``, ``part``, key, time, weather and readings.

    Fold i trains on the hours before its cut and tests those up to the next cut. Fences are those
    of its training rows. Training rows are interpolated towards later training rows only; the last
    gap before the cut, and every gap of the test rows, repeats the last value for
    ``interpolate_limit`` rows. Weather is carried forward; hours before its first known value take
    that value if it was known by the cut. Weather is shared by all series.

    Nothing at or after the cut changes a training row, and nothing after a row changes a test row.
    """
    s = settings
    weather, readings = nan_free(to_hour(weather, ts)), nan_free(to_hour(readings, ts))
    weather = settle_rows(weather)
    panel, bound = panel_within(readings, weather, key, ts, s, scale, look_ahead=False)
    panel = panel.withColumn(s.target, clip_lower(F.col(s.target), 0.0))
    panel = settle_rows(panel)
    cuts = fold_cuts(panel, n_splits, ts, scale)
    panel = panel.withColumn("test_fold", fold_at(F.col(ts), cuts))
    fenced = [c for c in s.fenced if c in panel.columns]
    fences = settle(fold_fences(panel, fenced, [key], n_splits, s.fence_factor, scale=scale))

    copies = panel.withColumn("fold", F.explode(F.sequence(
        F.greatest("test_fold", F.lit(1)), F.lit(n_splits))))
    copies = attach(copies, fences, [key, "fold"], scale).withColumns(
        {c: clip_upper(F.col(c), F.col(f"{c}_fence")) for c in fenced})
    edges = [c for c in s.edge_filled if c in weather.columns]
    copies = copies.withColumns({
        c: F.coalesce(F.col(c), F.when(F.lit(first[1]) < F.col("fold"), F.lit(first[0])))
        for c, first in _first_known(weather, edges, ts, cuts).items()})
    copies = copies.withColumn("__train", F.col("test_fold") < F.col("fold"))
    filled = fill_series(copies, [key, "fold"], [ts], (), s.target, s.interpolate_limit, scale,
                         bound, ahead="__train").dropna(subset=[s.target])
    columns = [c for c in (*WEATHER_COLUMNS, *READING_COLUMNS) if c in panel.columns]
    part = F.when(F.col("__train"), F.lit(TRAIN)).otherwise(F.lit(TEST))
    return filled.select("fold", part.alias("part"), key, ts, *columns)


def _first_known(weather: DataFrame, columns: Sequence[str], ts: str, cuts: Sequence) -> dict:
    """Of each column that has one: its first known value and the fold that tests its hour."""
    if not columns:
        return {}
    known = {c: F.when(F.col(c).isNotNull(), F.col(ts)) for c in columns}
    row = weather.agg(*[F.min_by(c, known[c]).alias(c) for c in columns],
                      *[F.min(known[c]).alias(f"__at_{c}") for c in columns]).first()
    return {c: (row[c], sum(row[f"__at_{c}"] >= cut for cut in cuts))
            for c in columns if row[c] is not None}


def fold_features(rows: DataFrame, key: str, ts: str = "timestamp", target: str = "pm25",
                  settings: FeatureSettings = FeatureSettings(),
                  scale: ScaleSettings = ScaleSettings(), rows_bound: int | None = None) -> DataFrame:
    """Feature rows of every fold's copy; a test row's lags reach back into the training rows."""
    wide = all_features(rows, [key, "fold"], ts, target, settings, scale, rows_bound, keep=["part"])
    return complete_rows(wide, [*feature_names(rows.columns, target, settings), target, ts])


def fold_copy_predictions(rows: DataFrame, model: str, features: Sequence[str], target: str = "pm25",
                          settings: ExperimentSettings = ExperimentSettings(), ts: str = "timestamp",
                          scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """``(model, fold, y, yhat)`` of the test rows, each fold fitted on its own training copy.

    A fold whose training rows are all still warming up is left out, whatever the model.
    """
    def told(tested: DataFrame, predicted: str) -> DataFrame:
        return tested.select(F.lit(model).alias("model"), "fold", F.col(target).alias("y"),
                             F.col(predicted).alias("yhat"))

    folds = sorted(r[0] for r in rows.where(F.col("part") == TRAIN).select("fold").distinct().collect())
    if not folds:
        raise ValueError("no fold has training rows")
    tests = rows.where((F.col("part") == TEST) & F.col("fold").isin(folds))
    if model == "persistence":
        return told(tests, f"{target}_lag_1h")

    def one(i: int) -> DataFrame:
        train = rows.where((F.col("fold") == i) & (F.col("part") == TRAIN))
        fitted = fit(model, train, features, target, settings, ts, scale=scale)
        return told(fitted.transform(tests.where(F.col("fold") == i)), PREDICTION)

    with ThreadPoolExecutor(settings.n_splits) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(one), folds)
        return reduce(DataFrame.unionByName, parts)


def train_only_scores(rows: DataFrame, models: Sequence[str], features: Sequence[str],
                      target: str = "pm25", settings: ExperimentSettings = ExperimentSettings(),
                      ts: str = "timestamp", scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Fold summary of each model on the rows of :func:`fold_features`."""
    every = [fold_copy_predictions(rows, m, features, target, settings, ts, scale) for m in models]
    return fold_summary(error_metrics(reduce(DataFrame.unionByName, every)))
