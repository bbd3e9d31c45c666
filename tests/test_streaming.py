from functools import reduce
from pathlib import Path

from helpers import same_rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom import fixtures as fx
from hourloom.catalog.queries import clean, scratch
from hourloom.config import WEATHER_COLUMNS
from hourloom.functions.scalars import floor_hour
from hourloom.operators.features import build_features
from hourloom.operators.scale import settle
from hourloom.operators.summary import last_rows
from hourloom.streaming import refresh
from hourloom.streaming.hourly import (
    append_hours, append_missed, closed_hours, late_hours, missed_hours, newest_hours, record_batch,
    recorded_hours,
)
from hourloom.streaming.refresh import (
    current_features, refresh_batch, refresh_features, repair_late,
)

KEYS = ["station"]


def test_copies_count_once_and_all_hours_close(spark, folder):
    base = scratch(spark)
    raw = fx.events(spark, folder).select("event_id", "ts", "event_type", "value")
    last = raw.agg(F.max("ts")).first()[0]
    # One far later reading moves the watermark past every real hour.
    flush = raw.limit(1).withColumns({
        "event_id": F.lit(-1).cast("bigint"),
        "ts": F.lit(last.replace(year=2025).isoformat(sep=" ")).cast("timestamp_ntz")})
    raw.union(raw).union(flush).coalesce(1).write.parquet(f"{base}/landed")
    source = spark.readStream.schema(raw.schema).parquet(f"{base}/landed")
    measures = [F.count(F.lit(1)).alias("n"), F.max("value").alias("top")]
    hours = closed_hours(source, "event_type", "ts", ["event_id"], measures)
    append_hours(hours, f"{base}/out", f"{base}/progress").awaitTermination()
    batch = raw.groupBy("event_type", floor_hour(F.col("ts")).alias("timestamp")).agg(*measures)
    same_rows(spark.read.parquet(f"{base}/out").drop("day"), batch)


def test_refreshed_features_equal_one_batch(spark, folder):
    base = scratch(spark)
    clean(spark, folder).write.parquet(f"{base}/clean")
    rows = spark.read.parquet(f"{base}/clean")
    for first, last in (("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-01-20"),
                        ("2024-01-20", "2024-03-01")):
        rows.where(f"timestamp >= '{first}' and timestamp < '{last}'").write.mode(
            "append").parquet(f"{base}/landed")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/landed")
        refresh_features(source, f"{base}/out", f"{base}/progress",
                         ["station"]).awaitTermination()
    out = spark.read.parquet(f"{base}/out/features").drop("batch")
    expected = build_features(rows, ["station"])
    same_rows(out, expected, digits=7)
    # A repeated batch writes the same rows again.
    refresh_batch(rows.where("timestamp >= '2024-01-20'"), 2, f"{base}/out", ["station"])
    same_rows(spark.read.parquet(f"{base}/out/features").drop("batch"), expected, digits=7)


def test_late_rows_do_not_stop_the_stream_and_are_repaired(spark, folder):
    base = scratch(spark)
    clean(spark, folder).write.parquet(f"{base}/clean")
    rows = spark.read.parquet(f"{base}/clean")
    held = F.col("station").isin("click", "error") & (F.day("timestamp") == 10)
    first = F.col("timestamp") < F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")
    last = F.col("timestamp") >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    refresh_batch(rows.where(first & ~held), 0, base, KEYS)
    refresh_batch(rows.where((~first & ~last) | held), 1, base, KEYS)
    same_rows(spark.read.parquet(f"{base}/late/batch=1"), rows.where(held))
    seen = rows.where(~last)
    repair_late(seen, base, [0, 1], KEYS)
    same_rows(current_features(spark, base, KEYS), build_features(seen, KEYS), digits=7)
    assert {r.station for r in spark.read.parquet(f"{base}/repairs").select("station").distinct().collect()} <= {"click", "error"}
    # The next batch starts from the repaired rows; a second repair takes over from the first.
    refresh_batch(rows.where(last), 2, base, KEYS)
    same_rows(current_features(spark, base, KEYS), build_features(rows, KEYS), digits=7)
    more = rows.limit(1).select(F.lit("click").alias("station"), F.lit("2024-01-11 23:30:00").cast(
        "timestamp_ntz").alias("timestamp"), *[c for c in rows.columns if c not in ("station", "timestamp")])
    refresh_batch(more, 3, base, KEYS)
    repair_late(rows.unionByName(more), base, [3], KEYS)
    same_rows(current_features(spark, base, KEYS), build_features(rows.unionByName(more), KEYS), digits=7)


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder.removeprefix("file:")).rglob("*.parquet")}


def test_only_touched_series_are_written(spark, monkeypatch):
    monkeypatch.setattr(refresh, "MERGE_EVERY", 3)
    base = scratch(spark)

    def batch(n, stations):
        hours = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), (F.col("id") + 10 * n).cast("int"))
        rows = spark.range(10).select(F.explode(F.array(*[F.lit(s) for s in stations])).alias("station"), hours.alias("timestamp"),
                                      *[(F.rand(7) + n).alias(c) for c in (*WEATHER_COLUMNS, "pm25", "no2")])
        return settle(rows)

    stations = [f"s{i}" for i in range(30)]
    landed = [batch(0, stations), batch(1, ["s3"]), batch(2, ["s3", "s7"]), *[batch(n, ["s7"]) for n in range(3, 9)]]
    before: dict = {}
    for n, rows in enumerate(landed):
        refresh_batch(rows, n, base, KEYS)
        now = files(f"{base}/carry")
        assert all(now[p] == t for p, t in before.items() if p in now)  # nothing is written again
        if n < 8:  # older parts are still there
            part = spark.read.parquet(f"{base}/carry/part={2 * n}")
            assert {r.station for r in part.select("station").distinct().collect()} == {
                r.station for r in rows.select("station").distinct().collect()}
        before = now
    assert not (Path(base.removeprefix("file:")) / "carry/part=0").exists()
    every = reduce(DataFrame.unionByName, landed)
    kept = refresh.carried_rows(spark, base, 9, landed[0].schema, KEYS).drop("__version", "bucket")
    same_rows(kept, last_rows(every, 168, KEYS))
    # A batch that runs again, with a merge before it, finds the same rows.
    written = settle(spark.read.parquet(f"{base}/carry/part=12"))
    refresh_batch(landed[6], 6, base, KEYS)
    same_rows(written, spark.read.parquet(f"{base}/carry/part=12"))


def test_late_readings_repair_their_hours(spark, folder):
    base = scratch(spark)
    raw = fx.events(spark, folder).select("event_id", "ts", "event_type", "value")
    measures = [F.count(F.lit(1)).alias("n"), F.max("value").alias("top")]
    early = F.col("ts") < F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    late = early & (F.col("event_id") % 40 == 1)
    odd = raw.limit(1).select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(None).cast("string").alias("event_type"), "value")
    parts = [raw.where(early & ~late), raw.where(~early), raw.where(late).union(raw.where(early & (F.col("event_id") % 40 < 2))).union(odd)]
    for n, part in enumerate(parts):
        record_batch(part, n, base, "event_type", "ts", ["event_id"], measures)
    every = raw.union(odd)
    batch = every.groupBy("event_type", floor_hour(F.col("ts")).alias("timestamp")).agg(*measures)
    same_rows(recorded_hours(spark, base, "event_type"), batch)
    # Only the hours that late readings are in were computed again.
    named = raw.where(late).union(odd).select("event_type", floor_hour(F.col("ts")).alias("timestamp")).distinct()
    same_rows(late_hours(spark, base).select("event_type", "timestamp"), named)
    # A batch that runs again writes the same.
    record_batch(parts[2], 2, base, "event_type", "ts", ["event_id"], measures)
    same_rows(recorded_hours(spark, base, "event_type"), batch)
    # Only the days of a batch are read.
    days = spark.read.parquet(f"{base}/landed").where("batch = 2").select("day").distinct().count()
    assert days <= 9


def test_missed_hours_close_the_table(spark):
    rows = spark.createDataFrame(
        [(1, "a", "2024-01-01 00:10:00", 1), (2, "a", "2024-01-01 00:20:00", 2), (3, "a", "2024-01-01 01:00:00", 5),
         (3, "a", "2024-01-01 01:00:00", 5), (4, None, "2024-01-01 02:00:00", 7)],
        "id int, k string, ts string, v int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    measures = [F.count("*").alias("n"), F.sum("v").alias("v")]
    path = scratch(spark)
    written = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1, 1)], "k string, timestamp string, n long, v long") \
        .withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    append_missed(missed_hours(rows, written, "k", "ts", ["id"], measures), path, 1)
    out = newest_hours(written, spark.read.parquet(path), "k").collect()
    assert {(r.k, r.timestamp.hour, r.n, r.v) for r in out} == {("a", 0, 2, 3), ("a", 1, 1, 5), (None, 2, 1, 7)}
    assert len(out) == 3
