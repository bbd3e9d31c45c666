"""The given tables seen as readings, weather and landed payloads.

``events`` stands for raw readings: the event type is the station. All sums are over integers,
so any engine gets the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import floor_hour, wall_clock
from .operators.align import join_on_hour


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", wall_clock(F.col("ts")))


def _k():
    return F.get_json_object("props", "$.k").cast("bigint")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per station and hour; raw rows are combined before the shuffle."""
    return events(spark, sf_dir).groupBy(
        F.col("event_type").alias("station"), floor_hour(F.col("ts")).alias("h")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"),
        F.count(F.lit(1)).alias("n"), F.max("value").alias("no2"), F.min("value").alias("o3"),
        F.sum(_k()).alias("sk"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hour, with holes in temp and some calm hours."""
    per_hour = events(spark, sf_dir).groupBy(floor_hour(F.col("ts")).alias("timestamp")).agg(
        F.sum(_k()).alias("sk"), F.sum("user_id").alias("su"),
        F.count_if(F.col("event_type") == "error").alias("ne"))
    sk, su = F.col("sk"), F.col("su")
    return per_hour.select(
        "timestamp",
        F.when(sk % 7 != 0, (sk % 350).cast("double") / 10).alias("temp"),
        (40 + sk % 41).cast("double").alias("humidity"),
        ((su % 120).cast("double") / 10).alias("wind_speed"),
        (su % 360).cast("double").alias("wind_dir"),
        (F.col("ne").cast("double") / 10).alias("precip"),
        (1000 + sk % 40).cast("double").alias("pressure"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings with holes in pm25."""
    return observations(spark, sf_dir).select(
        "station", F.col("h").alias("timestamp"),
        F.when(F.col("sk") % 13 != 0,
               F.col("cents").cast("double") / F.col("n") / 100).alias("pm25"),
        F.col("n").cast("double").alias("aqi"), "no2", "o3")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station at every weather hour."""
    return join_on_hour(weather(spark, sf_dir), readings(spark, sf_dir), "station")


def station_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed station feed texts: some not ok, some without pollutants, some with text for aqi."""
    v = lambda c: F.concat(F.lit('{"v":'), F.col(c).cast("string"), F.lit("}"))
    pollutants = F.when(F.col("sk") % 5 == 0, F.lit("{}")).otherwise(F.concat(
        F.lit('{"pm25":'), F.concat(F.lit('{"v":'), F.col("cents").cast("string"), F.lit("}")),
        F.lit(',"no2":'), v("no2"), F.lit("}")))
    aqi = F.when(F.col("sk") % 3 == 0, F.lit('"-"')).otherwise(F.col("n").cast("string"))
    status = F.when(F.col("sk") % 11 == 0, F.lit("error")).otherwise(F.lit("ok"))
    text = F.concat(
        F.lit('{"status":"'), status, F.lit('","data":{"aqi":'), aqi,
        F.lit(',"time":{"iso":"'), F.date_format("h", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('+04:00"},"iaqi":'), pollutants, F.lit("}}"))
    return observations(spark, sf_dir).select("station", text.alias("payload"))


def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed weather payload texts: one per day, parallel arrays in time order.

    A day has at most 24 elements per array.
    """
    w = weather(spark, sf_dir)
    day = w.groupBy(F.to_date("timestamp").alias("day")).agg(F.sort_array(F.collect_list(F.struct(
        "timestamp", "temp", "humidity", "wind_speed", "wind_dir", "precip", "pressure"
    ))).alias("rows"))
    arr = lambda c: F.expr(f"transform(rows, r -> r.{c})")
    hourly = F.struct(F.struct(
        F.expr("transform(rows, r -> date_format(r.timestamp, \"yyyy-MM-dd'T'HH:mm\"))")
        .alias("time"),
        arr("temp").alias("temperature_2m"), arr("humidity").alias("relative_humidity_2m"),
        arr("wind_speed").alias("wind_speed_10m"), arr("wind_dir").alias("wind_direction_10m"),
        arr("precip").alias("precipitation"), arr("pressure").alias("surface_pressure"),
    ).alias("hourly"))
    return day.select("day", F.to_json(hourly).alias("payload"))
