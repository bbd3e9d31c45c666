"""Compare models over expanding folds, keep the best one."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExperimentSettings, ScaleSettings
from ..models.bundle import Bundle, save_bundle
from ..models.gram import fold_ridge, with_prediction
from ..models.trainers import PREDICTION, fit, stats_before_folds
from ..operators.validate import (
    assign_folds, best_model, error_metrics, fold_summary, leaderboard,
    persistence_predictions,
)
from ..sources.tables import write_records


@dataclass(frozen=True)
class Experiment:
    scores: DataFrame
    best: Bundle


def fold_predictions(folded: DataFrame, model: str, features: Sequence[str], target: str,
                     settings: ExperimentSettings = ExperimentSettings(),
                     ts: str = "timestamp", scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """``(model, fold, y, yhat)`` of every tested row; fold i is trained on ``test_fold < i``."""
    if model == "persistence":
        return persistence_predictions(folded, target)
    if model == "ridge":  # all folds from one pass
        models = fold_ridge(folded, features, target, settings.n_splits, (), settings.ridge)
        tested = with_prediction(folded.where(F.col("test_fold") > 0), models.withColumnRenamed("fold", "test_fold"),
                                 ["test_fold"], features, PREDICTION, scale)
        return tested.select(F.lit(model).alias("model"), F.col("test_fold").alias("fold"),
                             F.col(target).alias("y"), F.col(PREDICTION).alias("yhat"))
    parts = [
        trained.transform(folded.where(F.col("test_fold") == i)).select(
            F.lit(model).alias("model"), F.lit(i).alias("fold"), F.col(target).alias("y"),
            F.col(PREDICTION).alias("yhat"))
        for i, trained in fold_models(folded, model, features, target, settings, ts, scale).items()]
    return reduce(DataFrame.unionByName, parts)


def fold_models(folded: DataFrame, model: str, features: Sequence[str], target: str,
                settings: ExperimentSettings = ExperimentSettings(), ts: str = "timestamp",
                scale: ScaleSettings = ScaleSettings()) -> dict[int, PipelineModel]:
    """The model trained for each tested fold. Folds do not depend on each other, so their jobs
    are submitted side by side."""
    stats = stats_before_folds(folded, features, target) if model == "ridge" else {}

    def one(i: int) -> PipelineModel:
        return fit(model, folded.where(F.col("test_fold") < i), features, target, settings, ts,
                   scale=scale, stats=stats.get(i))

    folds = range(1, settings.n_splits + 1)
    with ThreadPoolExecutor(settings.n_splits) as pool:
        return dict(zip(folds, pool.map(inheritable_thread_target(folded.sparkSession)(one), folds)))


def model_scores(folded: DataFrame, models: Sequence[str], features: Sequence[str], target: str,
                 settings: ExperimentSettings = ExperimentSettings(), ts: str = "timestamp",
                 scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Fold summary of each model; all predictions go through one aggregation."""
    every = [fold_predictions(folded, m, features, target, settings, ts, scale) for m in models]
    return fold_summary(error_metrics(reduce(DataFrame.unionByName, every)))


def run_experiment(feature_rows: DataFrame, features: Sequence[str], target: str = "pm25",
                   settings: ExperimentSettings = ExperimentSettings(), out: str | None = None,
                   ts: str = "timestamp", scale: ScaleSettings = ScaleSettings()) -> Experiment:
    """Leaderboard over all models, the winner trained on all rows, both saved under ``out``.

    There, ``predictions`` has every tested row of every model; scores and choice are computed from
    that table, so both can be checked or repeated without training again. The feature rows are kept
    on executor disks for the many passes; a lost block is computed again from its lineage. Only the
    winner gets a final fit.
    """
    spark = feature_rows.sparkSession
    folded = assign_folds(feature_rows, settings.n_splits, ts, scale).persist(
        StorageLevel.MEMORY_AND_DISK)
    try:
        said = [fold_predictions(folded, m, features, target, settings, ts, scale) for m in settings.models]
        predictions = reduce(DataFrame.unionByName, said)
        if out:
            predictions.write.mode("overwrite").partitionBy("model").parquet(f"{out}/predictions")
            predictions = spark.read.schema(predictions.schema).parquet(f"{out}/predictions")
        summary = fold_summary(error_metrics(predictions))
        # One row per model.
        rows = leaderboard(summary).collect()
        scores = spark.createDataFrame(rows, summary.schema)
        name = best_model(scores).first()["model"]
        winner = fit(name, folded, features, target, settings, ts, final=True, scale=scale)
        best = Bundle(winner, name, tuple(features), target)
    finally:
        folded.unpersist()
    if out:
        save_bundle(spark, best, f"{out}/best")
        write_records(scores.coalesce(1), f"{out}/results")
    return Experiment(scores, best)
