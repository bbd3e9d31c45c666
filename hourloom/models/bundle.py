"""A saved model: pipeline directory plus a one-row table with its name and features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators.summary import last_rows
from .trainers import PREDICTION


@dataclass(frozen=True)
class Bundle:
    model: PipelineModel
    name: str
    features: tuple[str, ...]
    target: str


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    bundle.model.write().overwrite().save(f"{path}/model")
    row = [(bundle.name, list(bundle.features), bundle.target)]
    spark.createDataFrame(row, "name string, features array<string>, target string").coalesce(
        1).write.mode("overwrite").json(f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """The saved model; an error naming the path if there is none."""
    try:
        about = spark.read.schema("name string, features array<string>, target string").json(
            f"{path}/about").first()
    except AnalysisException as missing:
        raise FileNotFoundError(f"no model saved at {path}") from missing
    model = PipelineModel.load(f"{path}/model")
    return Bundle(model, about["name"], tuple(about["features"]), about["target"])


def align_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """The trained features, in trained order; an error if the frame lacks one."""
    absent = [f for f in features if f not in df.columns]
    if absent:
        raise ValueError(f"features missing from the frame: {', '.join(absent)}")
    return list(features)


def score_recent(bundle: Bundle, rows: DataFrame, n: int = 48, keys: Sequence[str] = (),
                 ts: str = "timestamp") -> DataFrame:
    """Actual and predicted value of the last n rows per series."""
    align_features(rows, bundle.features)
    recent = last_rows(rows, n, keys, ts)
    return bundle.model.transform(recent).select(
        *keys, ts, recent[bundle.target].alias("actual"), PREDICTION)
