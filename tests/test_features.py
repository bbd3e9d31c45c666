import math
import random

import pandas as pd
import pytest
from helpers import START, hours, same_rows
from pyspark.sql import functions as F

from hourloom import fixtures as fx
from hourloom.config import FeatureSettings
from hourloom.functions import scalars
from hourloom.operators.features import all_features, build_features, feature_names
from hourloom.operators.rolling import block_plan
from hourloom.operators.scale import settle


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    df = hours(spark, [rng.uniform(1, 90) for _ in range(400)], column="pm25")
    noise = lambda k: (F.xxhash64("timestamp", F.lit(k)) % 1000).cast("double") / 10
    return settle(df.withColumns({
        "temp": noise(1), "humidity": F.abs(noise(2)), "wind_speed": F.abs(noise(3)) % 9,
        "wind_dir": F.abs(noise(4)) * 3, "precip": F.abs(noise(5)), "pressure": 1000 + noise(6),
        "no2": F.abs(noise(7))}))


def test_feature_lists():
    assert len(feature_names(["pm25", "temp"])) == 28
    assert len(feature_names(["no2", "precip", "pressure"])) == 33
    assert feature_names(["x"], "o3")[7] == "o3_lag_1h"


def test_features_equal_pandas(series):
    mine = build_features(series, ["station"]).toPandas().set_index("timestamp").sort_index()
    p = series.toPandas().sort_values("timestamp").set_index("timestamp")
    past = p.pm25.shift(1)
    assert len(mine) == len(p) - 168
    expect = pd.DataFrame({
        **{f"pm25_lag_{k}h": p.pm25.shift(k) for k in (1, 3, 6, 12, 24, 48, 168)},
        **{f"pm25_rolling_{t}": past.rolling(n).mean()
           for n, t in ((3, "3h"), (6, "6h"), (24, "24h"), (168, "7d"))},
        **{f"pm25_std_{t}": past.rolling(n).std() for n, t in ((24, "24h"), (168, "7d"))},
        "precip_lag_3h": p.precip.shift(1).rolling(3).sum(),
        "pressure_change_3h": p.pressure.shift(1).diff(3),
        "no2_lag_24h": p.no2.shift(24)}).loc[mine.index]
    for c in expect:
        assert (mine[c] - expect[c]).abs().max() < 1e-8, c


def test_no_feature_sees_its_own_or_a_later_target(series):
    at = START + pd.Timedelta(hours=300)
    cut = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
    changed = series.withColumn("pm25", F.when(F.col("timestamp") >= cut, F.col("pm25") + 1000)
                                .otherwise(F.col("pm25")))
    upto = lambda df: build_features(df, ["station"]).where(
        F.col("timestamp") <= cut).drop("pm25")
    same_rows(upto(series), upto(changed))


def test_input_order_and_partitioning_do_not_matter(series):
    same_rows(build_features(series, ["station"]),
              build_features(series.orderBy(F.rand(5)).repartition(5), ["station"]))


def test_a_missing_value_empties_only_the_windows_that_hold_it(spark):
    values = [float(i) for i in range(60)]
    values[20] = None
    df = hours(spark, values, column="pm25").withColumns({
        c: F.lit(1.0) for c in ("temp", "humidity", "wind_speed", "wind_dir")})
    rows = all_features(df, ["station"]).orderBy("timestamp").collect()
    empty = [i for i, r in enumerate(rows) if r["pm25_rolling_24h"] is None]
    assert empty == [*range(24), *range(24, 45)]
    assert [i for i, r in enumerate(rows) if r["pm25_std_24h"] is None] == empty


def test_window_sizes_that_do_not_nest_use_plain_frames(series):
    odd = FeatureSettings(mean_windows=((5, "5h"), (7, "7h"), (97, "97h")),
                          std_windows=((7, "7h"), (97, "97h")))
    assert dict(block_plan([5, 7, 97]))[97] == 0
    mine = all_features(series, ["station"], settings=odd).toPandas().sort_values("timestamp")
    past = series.toPandas().sort_values("timestamp").pm25.shift(1).reset_index(drop=True)
    got = mine.reset_index(drop=True)
    for n in (5, 7, 97):
        pd.testing.assert_series_equal(got[f"pm25_rolling_{n}h"], past.rolling(n).mean(),
                                       check_names=False)
    pd.testing.assert_series_equal(got["pm25_std_97h"], past.rolling(97).std(), check_names=False)


def test_wall_clock_survives_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-03-10 02:30:00.5", "2024-11-03 01:59:59.999999", "1969-12-31 23:00:01"]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ts = F.col("t").cast("timestamp_ntz")
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
            scalars.floor_hour(ts).cast("string").alias("floor"),
            (scalars.instant_to_wall(scalars.wall_to_instant(ts)) == ts).alias("same")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["floor"] for r in rows] == [
        "2024-03-10 02:00:00", "2024-11-03 01:00:00", "1969-12-31 23:00:00"]
    assert all(r["same"] for r in rows)


def test_clips_keep_missing_values(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (None, 2.0), (5.0, None), (5.0, 3.0)],
                               "v double, u double")
    rows = df.select(scalars.clip_lower(F.col("v"), 0).alias("lo"),
                     scalars.clip_upper(F.col("v"), F.col("u")).alias("hi")).collect()
    assert [r["lo"] for r in rows] == [0.0, None, 5.0, 5.0]
    assert [r["hi"] for r in rows] == [-1.0, None, 5.0, 3.0]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan, 1), (2.0, 2)], "v double, i int")
    assert [r["v"] for r in scalars.nan_free(df).orderBy("i").collect()] == [None, 2.0]


def test_one_exchange_one_sort_and_no_python(spark, folder):
    stored = fx.panel(spark, folder).where("pm25 is not null")
    from hourloom.catalog.queries import scratch
    path = scratch(spark)
    stored.write.parquet(path)
    from helpers import plan_text
    plan = plan_text(build_features(spark.read.parquet(path), ["station"], rows_bound=1000))
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    assert "SinglePartition" not in plan and "Python" not in plan
