"""Bringing readings and weather onto one hourly grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import READING_COLUMNS, ScaleSettings
from ..functions.scalars import floor_hour, wall_clock
from .scale import attach, settle


def to_hour(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Zone dropped, minutes dropped."""
    return df.withColumn(ts, floor_hour(wall_clock(F.col(ts))))


def hourly_grid(weather: DataFrame, series: DataFrame, key: str, ts: str = "timestamp",
                scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Every series at every weather hour.

    Each series lists the hours between the first and the last weather hour and meets the
    weather table on the hour, so this is an equi-join. The weather table has one row per hour;
    it is broadcast only if its measured size allows.
    """
    shared = settle(weather)
    first, last = shared.agg(F.min(ts), F.max(ts)).first()
    if first is None:
        return _no_hours(series, key, shared)
    lo, hi = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (first, last))
    hours = F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR")))
    grid = series.select(key).distinct().select(key, hours.alias(ts))
    return attach(grid, shared, [ts], scale, "inner")


def _no_hours(series: DataFrame, key: str, weather: DataFrame) -> DataFrame:
    out = series.select(key).limit(0)
    return out.select(key, *[F.lit(None).cast(f.dataType).alias(f.name) for f in weather.schema])


def join_on_hour(weather: DataFrame, readings: DataFrame, key: str | None = None,
                 ts: str = "timestamp", columns: Sequence[str] = READING_COLUMNS,
                 scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Weather hours with the readings of that hour, if any.

    Both inputs are already on the hour. Several readings in one hour give several rows.
    Weather without the series key is shared by all series.
    """
    there = [c for c in columns if c in readings.columns]
    if key is None:
        return weather.join(readings.select(ts, *there), [ts], "left")
    if key not in weather.columns:
        weather = hourly_grid(weather, readings, key, ts, scale)
    return weather.join(readings.select(key, ts, *there), [key, ts], "left")


def overlay_last(df: DataFrame, live: DataFrame, ordinal: str, key: str | None = None,
                 ts: str = "timestamp", column: str = "pm25",
                 scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """The last live row of each series replaces ``column`` at its hour, even by a missing value."""
    keys = [key] if key else []
    last = live.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(ts).alias("__hour"), F.col(column).alias("__new")),
                 F.col(ordinal)).alias("__last"))
    table = settle(last.select(*keys, "__last.__hour", "__last.__new"))
    joined = attach(df, table, keys, scale) if keys else attach(
        df.withColumn("__one", F.lit(1)), table.withColumn("__one", F.lit(1)), ["__one"], scale
    ).drop("__one")
    replaced = F.when(F.col(ts) == F.col("__hour"), F.col("__new")).otherwise(F.col(column))
    return joined.withColumn(column, replaced).drop("__hour", "__new")


def splice_history(history: DataFrame, live: DataFrame, ts: str = "timestamp",
                   key: str | None = None, scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """History strictly before the first live row, with ``key`` of the same series, then the live rows.

    Columns of one side only are missing on the other. Without live rows all history stays.
    """
    if key is None:
        first = live.agg(F.min(ts).alias("first")).first()["first"]
        if first is not None:
            history = history.where(F.col(ts) < F.lit(first.isoformat(sep=" ")).cast("timestamp_ntz"))
    else:
        firsts = settle(live.groupBy(key).agg(F.min(ts).alias("__first")))
        history = attach(history, firsts, [key], scale).where(
            F.col("__first").isNull() | (F.col(ts) < F.col("__first"))).drop("__first")
    return history.unionByName(live, allowMissingColumns=True)


def widen_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, columns by name, absent ones missing."""
    return a.unionByName(b, allowMissingColumns=True)
