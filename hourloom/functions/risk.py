"""Risk bands as column expressions and as a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ANNUAL_GUIDELINE, RISK_BANDS


def _choose(value: Column, field: str) -> Column:
    first, *rest = RISK_BANDS
    chosen = F.when((value >= first["low"]) & (value < first["high"]), F.lit(first[field]))
    for b in rest:
        chosen = chosen.when((value >= b["low"]) & (value < b["high"]), F.lit(b[field]))
    return chosen.otherwise(F.lit(RISK_BANDS[-1][field]))


def risk_band(value: Column) -> Column:
    return _choose(value, "band")


def risk_label(value: Column) -> Column:
    return _choose(value, "label")


def risk_color(value: Column) -> Column:
    return _choose(value, "color")


def risk_action(value: Column) -> Column:
    return _choose(value, "action")


def guideline_ratio(value: Column, guideline: float = ANNUAL_GUIDELINE) -> Column:
    return value / F.lit(guideline)


def alert_table(spark: SparkSession) -> DataFrame:
    """One row per band: value range as text, audience, and advised action."""
    def text(b: dict) -> str:
        top = "∞" if b["high"] >= 999 else f"{b['high']:.0f}"
        return f"{b['low']:.0f}–{top}"

    rows = [(b["band"], b["label"], text(b), b["audience"], b["action"], b["color"])
            for b in RISK_BANDS]
    return spark.createDataFrame(
        rows, "band int, label string, value_range string, audience string, "
              "action string, color string")
