from datetime import date

import pytest
from helpers import column, hours, plan_text, same_rows
from helpers import same_rows
from pyspark.sql import functions as F

from hourloom import fixtures as fx
from hourloom.catalog.queries import scratch
from hourloom.operators import align
from hourloom.plans.clean import clean_panel, clean_series
from hourloom.plans.ingest import run_ingest
from hourloom.sources.payloads import (
    rejected_stations, rejected_times, station_rows, weather_rows,
)
from hourloom.sources.tables import bounded_history, history_bounds, read_dated, write_dated


def test_station_payload_cases(spark):
    ok = ('{"status":"ok","data":{"aqi":%s,"time":{"iso":"2024-01-01T05:00:00+04:00"},'
          '"iaqi":{%s}}}')
    rows = [
        ("full", ok % ("80", '"pm25":{"v":12.5},"no2":{"v":3},"o3":{"v":4},"pm10":{"v":9}')),
        ("partial", ok % ('"-"', '"no2":{"v":3}')),
        ("down", '{"status":"error","data":"unknown station"}'),
        ("broken", "{not json"),
        ("empty", None)]
    out = {r["station"]: r for r in station_rows(
        spark.createDataFrame(rows, "station string, payload string")).collect()}
    assert set(out) == {"full", "partial"}
    assert out["full"]["timestamp"].isoformat() == "2024-01-01T05:00:00"
    assert (out["full"]["pm25"], out["full"]["pm10"], out["full"]["aqi"]) == (12.5, 9.0, 80.0)
    assert out["partial"]["pm25"] is None and out["partial"]["aqi"] is None
    assert out["partial"]["no2"] == 3.0
    more = [("down", '{"status":"ok","data":{"aqi":1}}'), ("late", (ok % ("1", "")).replace("2024-01-01T", "soon")), ("down", None)]
    rejected = {(r["station"], r["reason"]): r["n"] for r in rejected_stations(
        spark.createDataFrame(rows + more, "station string, payload string")).collect()}
    assert rejected == {("down", "status"): 1, ("down", "incomplete"): 1, ("down", "unreadable"): 1,
                        ("broken", "unreadable"): 1, ("empty", "unreadable"): 1, ("late", "time"): 1}


def test_weather_payload_with_missing_element(spark):
    text = ('{"hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00"],'
            '"temperature_2m":[1.5,null],"relative_humidity_2m":[50,51],'
            '"wind_speed_10m":[1,2],"wind_direction_10m":[10,20],"precipitation":[0,0],'
            '"surface_pressure":[1000,1001]}}')
    out = weather_rows(spark.createDataFrame([(text,), ("{}",)], "payload string"))
    assert [r["temp"] for r in out.orderBy("timestamp").collect()] == [1.5, None]


def test_history_bounds_include_both_days():
    assert history_bounds(date(2024, 1, 25), 10) == (date(2024, 1, 8), date(2024, 1, 18))


def test_history_filter_reaches_the_scan(spark, folder):
    raw = fx.events(spark, folder).select("ts", "value")
    plan = plan_text(bounded_history(raw, date(2024, 1, 25), 10, ts="ts"))
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_splice_without_live_rows_keeps_history(spark):
    history = hours(spark, [1.0, 2.0])
    live = history.limit(0).withColumn("pm10", F.lit(1.0))
    assert align.splice_history(history, live).count() == 2


def test_overlay_uses_the_last_row_even_if_missing(spark):
    base = hours(spark, [1.0, 2.0, 3.0], column="pm25")
    live = base.where("pm25 > 1").withColumns(
        {"ordinal": F.col("pm25").cast("int"), "pm25": F.lit(None).cast("double")})
    out = align.overlay_last(base, live, "ordinal", "station")
    assert column(out, "pm25") == [1.0, 2.0, None]
    single = align.overlay_last(base.drop("station"), live.drop("station"), "ordinal")
    assert column(single, "pm25", ["timestamp"]) == [1.0, 2.0, None]


def test_two_readings_of_an_hour_give_two_rows(spark):
    weather = hours(spark, [1.0, 2.0], column="temp").drop("station")
    reading = hours(spark, [5.0], column="pm25")
    out = align.join_on_hour(weather, reading.union(reading), "station", columns=["pm25"])
    assert out.count() == 3


def test_absent_columns_are_skipped(spark):
    df = hours(spark, [-1.0, 2.0, None], column="pm25")
    assert column(clean_panel(df, ["station"]), "pm25") == [0.0, 2.0, 2.0]


def test_fence_of_a_column_without_values(spark):
    df = hours(spark, [1.0, 2.0, 3.0], column="pm25").withColumn("no2", F.lit(None).cast("double"))
    assert column(clean_panel(df, ["station"]), "no2") == [None] * 3


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_writing_a_date_again_replaces_only_that_date(spark, fmt):
    path, df = scratch(spark), hours(spark, [1.0, 2.0])
    write_dated(df, path, date(2024, 1, 1), fmt)
    write_dated(df, path, date(2024, 1, 2), fmt)
    write_dated(df.limit(1), path, date(2024, 1, 2), fmt)
    schema = "station string, timestamp timestamp_ntz, v double"
    same_rows(read_dated(spark, path, date(2024, 1, 1), schema, fmt), df)
    assert read_dated(spark, path, date(2024, 1, 2), schema, fmt).count() == 1


def test_ingest_from_landed_files(spark, folder):
    base = scratch(spark)
    fx.station_payloads(spark, folder).write.json(f"{base}/stations")
    fx.weather_payloads(spark, folder).withColumn("station", F.lit("any")).write.json(
        f"{base}/weather")
    fx.readings(spark, folder).where("timestamp < '2024-01-03'").write.parquet(f"{base}/history")
    out = run_ingest(spark, f"{base}/stations", f"{base}/weather", f"{base}/history",
                     date(2024, 2, 7), 30, f"{base}/clean")
    row = out.agg(F.count("*").alias("n"), F.count("pm25").alias("k"),
                  F.countDistinct("station").alias("s")).first()
    assert row["n"] == row["k"] > 0 and row["s"] == 5


def test_station_without_index_or_pollutants_gives_no_row(spark):
    time = '"time":{"iso":"2024-01-01T05:00:00"}'
    rows = [("a", '{"status":"ok","data":{%s,"iaqi":{}}}' % time), ("b", '{"status":"ok","data":{"aqi":5,%s}}' % time),
            ("c", '{"status":"ok","data":{"aqi":null,%s,"iaqi":{}}}' % time)]
    out = station_rows(spark.createDataFrame(rows, "station string, payload string")).collect()
    assert [(r["station"], r["aqi"], r["pm25"]) for r in out] == [("c", None, None)]


def test_unreadable_weather_times_are_counted(spark):
    text = ('{"hourly":{"time":["2024-01-01T00:00","soon","soon",null],"temperature_2m":[1,2,3,4],'
            '"relative_humidity_2m":[],"wind_speed_10m":[],"wind_direction_10m":[],"precipitation":[],"surface_pressure":[]}}')
    landed = spark.createDataFrame([(text,)], "payload string")
    assert weather_rows(landed).count() == 1
    assert {(r["time"], r["n"]) for r in rejected_times(landed).collect()} == {("soon", 2), (None, 1)}


def test_history_is_spliced_per_series(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "station string, h int, pm25 double").selectExpr(
        "station", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) as timestamp", "pm25")
    history = rows(("a", 1, 1.0), ("a", 5, 1.0), ("b", 1, 1.0), ("b", 5, 1.0), (None, 2, 1.0), ("c", 9, 1.0))
    live = rows(("a", 2, 2.0), ("b", 6, 2.0), (None, 1, 2.0))
    out = align.splice_history(history, live, key="station").selectExpr("station", "hour(timestamp) as h", "pm25").collect()
    assert {tuple(r) for r in out} == {("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 1.0), ("b", 5, 1.0), ("b", 6, 2.0),
                                       (None, 1, 2.0), ("c", 9, 1.0)}


def test_a_stray_weather_hour_costs_one_row(spark, folder):
    weather, readings = fx.weather(spark, folder), fx.readings(spark, folder)
    far = weather.limit(1).withColumn("timestamp", F.lit("2999-01-01 00:00:00").cast("timestamp_ntz"))
    plain = clean_series(readings, weather, "station")
    assert clean_series(readings, weather.union(far), "station").where("year(timestamp) < 2999").count() == plain.count()
    full = clean_panel(align.join_on_hour(align.to_hour(weather), align.to_hour(readings), "station"), ["station"])
    same_rows(plain, full.select(*plain.columns))
