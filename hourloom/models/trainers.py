"""Regressors as Spark ML pipelines over feature rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BoostingSettings, ExperimentSettings, ForestSettings, RidgeSettings
from ..config import ScaleSettings
from ..operators.validate import tail_start, time_literal

VECTOR, PREDICTION = "features", "prediction"


def assembler(features: Sequence[str]) -> VectorAssembler:
    """The model's features in trained order; a frame without one of them is an error."""
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error")


def persistence_model(target: str) -> PipelineModel:
    """Prediction = previous row's value, in the same form as the trained models."""
    stage = SQLTransformer(
        statement=f"SELECT *, `{target}_lag_1h` AS {PREDICTION} FROM __THIS__")
    return PipelineModel(stages=[stage])


@dataclass(frozen=True)
class TrainStats:
    """What ridge has to know about its training rows before the fit."""

    n: int
    mean: float
    squares: float  # squared deviations of the target from its mean
    low: tuple
    high: tuple

    def merge(self, other: TrainStats) -> TrainStats:
        n, gap = self.n + other.n, other.mean - self.mean
        return TrainStats(
            n, self.mean + gap * other.n / n,
            self.squares + other.squares + gap * gap * self.n * other.n / n,
            tuple(map(min, self.low, other.low)), tuple(map(max, self.high, other.high)))


def _stat_columns(features: Sequence[str], target: str) -> list:
    return [F.count(target).alias("n"), F.avg(target).alias("mean"),
            F.var_pop(target).alias("var"), F.array(*[F.min(f) for f in features]).alias("low"),
            F.array(*[F.max(f) for f in features]).alias("high")]


def _stats(row) -> TrainStats:
    return TrainStats(row["n"], row["mean"], row["var"] * row["n"], tuple(row["low"]),
                      tuple(row["high"]))


def train_stats(train: DataFrame, features: Sequence[str], target: str) -> TrainStats:
    row = train.agg(*_stat_columns(features, target)).first()
    if not row["n"]:
        raise ValueError("no training rows")
    return _stats(row)


def stats_before_folds(folded: DataFrame, features: Sequence[str], target: str
                       ) -> dict[int, TrainStats]:
    """Statistics of the training rows of every fold from one pass.

    A training set is the previous one plus one more fold, so one row per fold is enough.
    """
    rows = folded.groupBy("test_fold").agg(*_stat_columns(features, target)).collect()
    per_fold = {r["test_fold"]: _stats(r) for r in rows}
    return {i + 1: reduce(TrainStats.merge, [per_fold[f] for f in sorted(per_fold) if f <= i])
            for i in per_fold}


def fit_ridge(train: DataFrame, features: Sequence[str], target: str,
              settings: RidgeSettings = RidgeSettings(), stats: TrainStats | None = None
              ) -> PipelineModel:
    """Least squares with an L2 penalty on standardised features, intercept free of penalty.

    Spark averages the squared error over n rows and scales the label by its deviation, so the
    penalty alpha on |w|² becomes alpha * deviation / n. A feature that is constant in the
    training rows has weight zero; it is left out because it would make the solver's matrix
    singular.
    """
    stats = stats or train_stats(train, features, target)
    varying = [f for f, a, b in zip(features, stats.low, stats.high, strict=True) if a < b]
    deviation = (stats.squares / stats.n) ** 0.5
    if not varying or not deviation:
        return PipelineModel(stages=[SQLTransformer(
            statement=f"SELECT *, CAST({stats.mean!r} AS DOUBLE) AS {PREDICTION} FROM __THIS__")])
    model = LinearRegression(
        featuresCol=VECTOR, labelCol=target, predictionCol=PREDICTION, solver="normal",
        standardization=True, elasticNetParam=0.0, regParam=settings.alpha * deviation / stats.n)
    return Pipeline(stages=[assembler(varying), model]).fit(train)


def fit_forest(train: DataFrame, features: Sequence[str], target: str,
               settings: ForestSettings = ForestSettings()) -> PipelineModel:
    """Random forest; each split looks at floor(sqrt(feature count)) features."""
    per_split = max(1, int(len(features) ** 0.5))
    model = RandomForestRegressor(
        featuresCol=VECTOR, labelCol=target, predictionCol=PREDICTION,
        numTrees=settings.trees, maxDepth=settings.depth, minInstancesPerNode=settings.min_leaf,
        featureSubsetStrategy=str(per_split), maxBins=settings.bins, seed=settings.seed)
    return Pipeline(stages=[assembler(features), model]).fit(train)


def fit_boosting(train: DataFrame, features: Sequence[str], target: str,
                 settings: BoostingSettings = BoostingSettings(), ts: str = "timestamp",
                 stop_early: bool = True, scale: ScaleSettings = ScaleSettings()
                 ) -> PipelineModel:
    """Boosted trees. With ``stop_early`` the last tenth of the *training* times judges the rounds:
    the model has the rounds with the least squared error there, once ``patience`` further ones
    were no better. The test fold is never looked at while training.
    """
    if not stop_early:
        return Pipeline(stages=[assembler(features), _boosted(target, settings, settings.rounds)]).fit(train)
    return fit_until_patience(train, features, target, settings, ts, scale)[0]


def _boosted(target: str, settings: BoostingSettings, rounds: int) -> GBTRegressor:
    return GBTRegressor(
        featuresCol=VECTOR, labelCol=target, predictionCol=PREDICTION, maxIter=rounds,
        stepSize=settings.step, maxDepth=settings.depth, minInstancesPerNode=settings.min_leaf,
        subsamplingRate=settings.row_share, maxBins=settings.bins,
        featureSubsetStrategy=str(settings.column_share), seed=settings.seed)


def fit_until_patience(train: DataFrame, features: Sequence[str], target: str,
                       settings: BoostingSettings = BoostingSettings(), ts: str = "timestamp",
                       scale: ScaleSettings = ScaleSettings()) -> tuple[PipelineModel, list[float]]:
    """The early-stopped model, and the squared error on the tail after each round that was tried.

    Rounds are added in runs, each twice the last, until the best is ``patience`` rounds back; round m
    is the same in every run, because its rows and columns are drawn with seed + m. The model is cut
    out of the longest run. Without enough times for a tail all rounds are kept and nothing is judged.
    """
    vectors = assembler(features)
    cut = time_literal(tail_start(train, ts, settings.tail_share, scale))
    ready = vectors.transform(train).select(VECTOR, target, ts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        head, tail = ready.where(F.col(ts) < cut), ready.where(F.col(ts) >= cut)
        if head.isEmpty():
            return PipelineModel(stages=[vectors, _boosted(target, settings, settings.rounds).fit(ready)]), []
        rounds = min(settings.rounds, 2 * settings.patience)
        while True:
            model = _boosted(target, settings, rounds).fit(head)
            errors = list(model.evaluateEachIteration(tail, "squared"))
            best = errors.index(min(errors)) + 1
            if rounds == settings.rounds or best + settings.patience <= rounds:
                break
            rounds = min(settings.rounds, 2 * rounds)
    finally:
        ready.unpersist()
    return PipelineModel(stages=[vectors, first_rounds(model, best)]), errors


def first_rounds(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model as it was after n rounds; none of its trees is fitted again."""
    java = model._java_obj
    whole = java.trees()
    if n >= len(whole):
        return model
    jvm = SparkContext._active_spark_context._jvm
    make = SparkContext._active_spark_context._gateway.new_array
    trees, weights = make(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), make(jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = whole[i], java.treeWeights()[i]
    cut = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(
        java.uid(), trees, weights, java.numFeatures()))
    model._copyValues(cut)._transfer_params_to_java()
    return cut


def tail_errors(model: PipelineModel, train: DataFrame, target: str, ts: str = "timestamp",
                settings: BoostingSettings = BoostingSettings(),
                scale: ScaleSettings = ScaleSettings()) -> list[float]:
    """Squared error on the tail after each round of an early-stopped model."""
    cut = time_literal(tail_start(train, ts, settings.tail_share, scale))
    ready = model.stages[0].transform(train.where(F.col(ts) >= cut))
    return model.stages[-1].evaluateEachIteration(ready, "squared")


def fit(name: str, train: DataFrame, features: Sequence[str], target: str,
        settings: ExperimentSettings = ExperimentSettings(), ts: str = "timestamp",
        final: bool = False, scale: ScaleSettings = ScaleSettings(),
        stats: TrainStats | None = None) -> PipelineModel:
    """Train one named model. The final fit of the boosted trees runs all its rounds.

    ``stats`` saves ridge a pass where the caller has them.
    """
    if name == "persistence":
        return persistence_model(target)
    if name == "ridge":
        return fit_ridge(train, features, target, settings.ridge, stats)
    if name == "forest":
        return fit_forest(train, features, target, settings.forest)
    if name == "boosting":
        return fit_boosting(train, features, target, settings.boosting, ts, not final, scale)
    raise ValueError(f"unknown model {name!r}")


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Feature importances, greatest first; an error for models that have none."""
    last = model.stages[-1]
    if not hasattr(last, "featureImportances"):
        raise ValueError(f"{type(last).__name__} has no feature importances")
    weights = last.featureImportances.toArray()
    rows = [(f, float(w)) for f, w in zip(features, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def top_importances(model: PipelineModel, features: Sequence[str], spark, n: int = 15
                    ) -> DataFrame:
    """The n greatest importances, smallest of them first."""
    return importances(model, features, spark).limit(n).orderBy("importance", F.desc("feature"))
