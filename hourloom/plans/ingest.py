"""From landed payloads to the dated clean table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CleanSettings, ScaleSettings
from ..functions.scalars import floor_hour
from ..operators.align import splice_history
from ..sources.payloads import read_payloads, station_rows, weather_rows
from ..sources.tables import bounded_history, read_dated, write_dated
from .clean import clean_series


def one_per_hour(readings: DataFrame, key: str = "station", ts: str = "timestamp") -> DataFrame:
    """The last reading of each series and hour; combined before the shuffle."""
    rest = [c for c in readings.columns if c not in (key, ts)]
    hour = floor_hour(F.col(ts)).alias("__hour")
    kept = readings.groupBy(key, hour).agg(
        F.max_by(F.struct(*rest), F.struct(ts, *rest)).alias("__row"))
    return kept.select(key, F.col("__hour").alias(ts), "__row.*")


def run_ingest(spark: SparkSession, station_path: str, weather_path: str, history_path: str,
               as_of: date, days: int, out: str | None = None, key: str = "station",
               settings: CleanSettings = CleanSettings(),
               scale: ScaleSettings = ScaleSettings(),
               weather_per_series: bool = False, overlay: bool = False) -> DataFrame:
    """Parse, bound, splice, clean, and write under the run date.

    Station and weather payloads are landed JSON lines; history is a parquet table of readings.
    Weather is shared by all series unless its payloads are said to belong to one series each. With
    ``overlay`` the last landed reading of each series is laid over its hour, a missing value too.
    With ``out`` the returned frame reads the written date, so nothing is computed twice.
    """
    live = station_rows(read_payloads(spark, station_path, key), key=key)
    history = bounded_history(spark.read.parquet(history_path), as_of, days)
    landed = read_payloads(spark, weather_path, key)
    weather = bounded_history(
        weather_rows(landed, keep=(key,) if weather_per_series else ()), as_of, days)
    readings = one_per_hour(splice_history(history, live, key=key), key)
    last = live.withColumn("ordinal", F.struct("timestamp", "aqi")) if overlay else None
    clean = clean_series(readings, weather, key, settings=settings, scale=scale, live=last)
    if out is None:
        return clean
    write_dated(clean, out, as_of)
    return read_dated(spark, out, as_of)
