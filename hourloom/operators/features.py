"""Feature rows: calendar, lags, trailing statistics, weather and interactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..config import FeatureSettings, ScaleSettings
from ..functions.scalars import (
    calendar_parts, cyclic_calendar, nan_free, stagnation, temp_humidity, temp_squared,
    wind_vector,
)
from .rolling import lagged_difference, lagged_sum, trailing_stats
from .scale import along_series


def target_lag_names(target: str, settings: FeatureSettings = FeatureSettings()) -> list[str]:
    return [f"{target}_lag_{k}h" for k in settings.target_lags]


def feature_names(columns: Sequence[str], target: str = "pm25",
                  settings: FeatureSettings = FeatureSettings()) -> list[str]:
    """The features in model order; optional ones only if their source column exists."""
    s = settings
    # Names and order of the features, as stored models expect them.
    names = ["hour_sin", "hour_cos", "month_sin", "month_cos", "dow_sin", "dow_cos", "is_weekend"]
    names += target_lag_names(target, s)
    names += [f"{target}_rolling_{tag}" for _, tag in s.mean_windows]
    names += [f"{target}_std_{tag}" for _, tag in s.std_windows]
    names += ["temp", "temp_sq", "humidity", "wind_speed", "wind_u", "wind_v"]
    names += ["temp_x_humidity", "stagnation_idx"]
    if s.secondary in columns:
        names += [f"{s.secondary}_lag_{k}h" for k in s.secondary_lags]
    if "precip" in columns:
        names.append(f"precip_lag_{s.precip_window}h")
    if "pressure" in columns:
        names += ["pressure", f"pressure_change_{s.pressure_span}h"]
    return names


def window_features(df: DataFrame, window: WindowSpec, target: str,
                    settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """All columns that look along the series; they share one exchange and one sort."""
    s = settings
    first = {f"{target}_lag_{k}h": F.lag(target, k).over(window) for k in s.target_lags}
    if s.secondary in df.columns:
        first |= {f"{s.secondary}_lag_{k}h": F.lag(s.secondary, k).over(window)
                  for k in s.secondary_lags}
    if "precip" in df.columns:
        first[f"precip_lag_{s.precip_window}h"] = lagged_sum("precip", window, s.precip_window)
    if "pressure" in df.columns:
        first[f"pressure_change_{s.pressure_span}h"] = lagged_difference(
            "pressure", window, s.pressure_span)
    return trailing_stats(
        df, window, target,
        {n: f"{target}_rolling_{tag}" for n, tag in s.mean_windows},
        {n: f"{target}_std_{tag}" for n, tag in s.std_windows}, first)


def row_features(df: DataFrame, ts: str = "timestamp",
                 settings: FeatureSettings = FeatureSettings()) -> DataFrame:
    """All columns that need only their own row."""
    u, v = wind_vector(F.col("wind_speed"), F.col("wind_dir"))
    return df.withColumns({
        "is_weekend": calendar_parts(F.col(ts))["is_weekend"], **cyclic_calendar(F.col(ts)),
        "wind_u": u, "wind_v": v,
        "temp_sq": temp_squared(F.col("temp")),
        "temp_x_humidity": temp_humidity(F.col("temp"), F.col("humidity")),
        "stagnation_idx": stagnation(F.col("humidity"), F.col("wind_speed"), settings.wind_floor),
    })


def all_features(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp",
                 target: str = "pm25", settings: FeatureSettings = FeatureSettings(),
                 scale: ScaleSettings = ScaleSettings(), rows_bound: int | None = None,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Every feature for every row, warm-up rows included. Without ``keys``: one series.

    ``keep`` names further input columns to pass on.
    """
    clean = nan_free(df)
    keys_used = list(keys) or ["__one"]
    if not keys:
        clean = clean.withColumn("__one", F.lit(1))
    wide = along_series(
        clean, keys_used, [ts], settings.reach,
        lambda d, w: window_features(d, w, target, settings), scale, rows_bound)
    names = feature_names(df.columns, target, settings)
    return row_features(wide, ts, settings).select(
        *keys, ts, *names, target, *keep)


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where none of the columns is missing."""
    return df.dropna(subset=list(columns))


def build_features(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp",
                   target: str = "pm25", settings: FeatureSettings = FeatureSettings(),
                   scale: ScaleSettings = ScaleSettings(),
                   rows_bound: int | None = None) -> DataFrame:
    """Feature rows without any missing value: keys, time, features in order, target.

    A feature of one row reads the target only from earlier rows of the series. Lags count rows,
    not hours: after a removed hour the previous row is the last one that survived.
    """
    wide = all_features(df, keys, ts, target, settings, scale, rows_bound)
    return complete_rows(wide, [*feature_names(df.columns, target, settings), target, ts])
