"""Risk tables over the clean series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.risk import guideline_ratio, risk_action, risk_band, risk_color, risk_label
from ..operators.summary import last_rows, latest_rows


def with_risk(df: DataFrame, value: str = "pm25") -> DataFrame:
    v = F.col(value)
    return df.withColumns({"band": risk_band(v), "label": risk_label(v), "color": risk_color(v),
                           "action": risk_action(v)})


def latest_risk(clean: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp",
                value: str = "pm25") -> DataFrame:
    """Latest row per series with its band and its multiple of the annual guideline."""
    last = latest_rows(clean.select(*keys, ts, value), keys, ts)
    return with_risk(last, value).withColumn("guideline_ratio", guideline_ratio(F.col(value)))


def recent_risk(clean: DataFrame, keys: Sequence[str] = (), n: int = 168,
                ts: str = "timestamp", value: str = "pm25") -> DataFrame:
    """The last n rows per series, each with its band."""
    recent = last_rows(clean.select(*keys, ts, value), n, keys, ts)
    return recent.withColumns({"band": risk_band(F.col(value)), "color": risk_color(F.col(value))})
