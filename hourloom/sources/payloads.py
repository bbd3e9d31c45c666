"""Landed JSON payloads of stations and weather as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import missing_as_null

_VALUE = "struct<v: double>"
STATION_SCHEMA = (
    "status string, data struct<aqi: double, time: struct<iso: string>, "
    f"iaqi: struct<pm25: {_VALUE}, pm10: {_VALUE}, no2: {_VALUE}, o3: {_VALUE}>>")

# Array names of the weather payload and the columns they become.
WEATHER_FIELDS = (
    ("temperature_2m", "temp"), ("relative_humidity_2m", "humidity"),
    ("wind_speed_10m", "wind_speed"), ("wind_direction_10m", "wind_dir"),
    ("precipitation", "precip"), ("surface_pressure", "pressure"))
WEATHER_SCHEMA = "hourly struct<time: array<string>, " + ", ".join(
    f"{name}: array<double>" for name, _ in WEATHER_FIELDS) + ">"


def _judged(landed: DataFrame, payload: str) -> DataFrame:
    """Adds the parsed payload, its time, and why it gives no row (NULL: it gives one)."""
    fields = F.from_json(payload, "data map<string, string>")["data"]
    whole = F.coalesce(F.map_contains_key(fields, "aqi") & F.map_contains_key(fields, "iaqi"), F.lit(False))
    parsed = landed.withColumns({"__p": F.from_json(payload, STATION_SCHEMA), "__whole": whole})
    parsed = parsed.withColumn("__time", F.col("__p.data.time.iso").try_cast("timestamp_ntz"))
    status = F.col("__p.status")
    return parsed.withColumn("__reason", F.when(status.isNull(), "unreadable").when(status != "ok", "status").when(
        ~F.col("__whole"), "incomplete").when(F.col("__time").isNull(), "time"))


def station_rows(landed: DataFrame, payload: str = "payload", key: str = "station",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One reading per payload whose status is ok; the others are counted by ``rejected_stations``.

    An absent pollutant or a non-numeric index is missing; a payload without an index or without
    the block of pollutants gives no row. The zone offset is dropped.
    """
    value = lambda name: missing_as_null(F.col(f"__p.data.iaqi.{name}.v")).alias(name)
    return _judged(landed, payload).where(F.col("__reason").isNull()).select(
        key, *keep, F.col("__time").alias("timestamp"),
        *[value(n) for n in ("pm25", "pm10", "no2", "o3")], F.col("__p.data.aqi").alias("aqi"))


def rejected_stations(landed: DataFrame, payload: str = "payload", key: str = "station",
                      keep: tuple[str, ...] = ()) -> DataFrame:
    """The payloads that ``station_rows`` has no row for: their number by station and reason
    (unreadable, status, incomplete, time)."""
    rejected = _judged(landed, payload).where(F.col("__reason").isNotNull())
    return rejected.groupBy(key, *keep, F.col("__reason").alias("reason")).agg(F.count("*").alias("n"))


def weather_rows(landed: DataFrame, payload: str = "payload",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per element of the parallel arrays; see ``rejected_times`` for unreadable times."""
    cells = _cells(landed, payload, keep)
    rows = cells.select(
        *keep, F.col("c.time").try_cast("timestamp_ntz").alias("timestamp"),
        *[missing_as_null(F.col(f"c.{name}")).alias(to) for name, to in WEATHER_FIELDS])
    return rows.where(F.col("timestamp").isNotNull())


def rejected_times(landed: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """The time texts that ``weather_rows`` has no rows for, with their number."""
    cells = _cells(landed, payload, keep).where(F.col("c.time").try_cast("timestamp_ntz").isNull())
    return cells.groupBy(*keep, F.col("c.time").alias("time")).agg(F.count("*").alias("n"))


def _cells(landed: DataFrame, payload: str, keep: tuple[str, ...]) -> DataFrame:
    hourly = F.from_json(payload, WEATHER_SCHEMA)["hourly"]
    return landed.withColumn("__h", hourly).where(F.col("__h.time").isNotNull()).select(
        *keep, F.explode(F.arrays_zip(
            F.col("__h.time"), *[F.col(f"__h.{name}") for name, _ in WEATHER_FIELDS])).alias("c"))


def read_payloads(spark: SparkSession, path: str, key: str = "station") -> DataFrame:
    """Landed texts in JSON lines ``{"<key>": ..., "payload": ...}``, read with a fixed schema."""
    return spark.read.schema(f"{key} string, payload string").json(path)
