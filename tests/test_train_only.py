import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from hourloom import fixtures as fx
from hourloom.config import ScaleSettings
from hourloom.operators.scale import settle
from hourloom.plans.clean import clean_series
from hourloom.plans.train_only import clean_train_only, fold_features, fold_fences


@pytest.fixture(scope="module")
def inputs(spark, folder):
    return settle(fx.readings(spark, folder)), settle(fx.weather(spark, folder))


@pytest.fixture(scope="module")
def cleaned(inputs):
    return settle(clean_train_only(*inputs, "station"))


def cut_of(rows, fold):
    return rows.where((F.col("fold") == fold) & (F.col("part") == "test")).agg(F.min("timestamp")).first()[0]


def test_parts_are_ordered_and_disjoint(cleaned):
    for fold in range(1, 6):
        train = cleaned.where((F.col("fold") == fold) & (F.col("part") == "train"))
        assert train.agg(F.max("timestamp")).first()[0] < cut_of(cleaned, fold)
    assert cleaned.where("pm25 is null").isEmpty()


@pytest.mark.parametrize("fold", [1, 3])
def test_nothing_from_the_cut_on_changes_a_training_row(inputs, cleaned, fold):
    readings, weather = inputs
    cut = F.lit(cut_of(cleaned, fold).isoformat(sep=" ")).cast("timestamp_ntz")
    later = F.col("timestamp") >= cut
    changed = readings.withColumns({
        c: F.when(later, F.coalesce(F.col(c), F.lit(1.0)) * 50 + 7).otherwise(F.col(c)) for c in ("pm25", "no2", "o3")})
    windy = weather.withColumns({
        c: F.when(later, F.lit(-99.0)).otherwise(F.col(c)) for c in weather.columns if c != "timestamp"})
    again = clean_train_only(changed, windy, "station")
    own = (F.col("fold") == fold) & (F.col("part") == "train")
    same_rows(cleaned.where(own), again.where(own))
    same_rows(fold_features(cleaned, "station").where(own), fold_features(again, "station").where(own), digits=7)
    # The plan that looks ahead does change them.
    before, after = clean_series(readings, weather, "station"), clean_series(changed, windy, "station")
    assert not before.where(~later).exceptAll(after.where(~later)).isEmpty()


def test_nothing_after_a_row_changes_a_test_row(inputs, cleaned):
    readings, weather = inputs
    cut, last = (cut_of(cleaned, f) for f in (2, 3))
    middle = F.lit((cut + (last - cut) / 2).isoformat(sep=" ")).cast("timestamp_ntz")
    changed = readings.withColumn("pm25", F.when(F.col("timestamp") >= middle, 1e4).otherwise(F.col("pm25")))
    again = clean_train_only(changed, weather, "station")
    own = (F.col("fold") == 2) & (F.col("timestamp") < middle)
    same_rows(cleaned.where(own), again.where(own))


def test_long_series_give_the_same_rows(inputs, cleaned):
    same_rows(cleaned, clean_train_only(*inputs, "station", scale=ScaleSettings(max_group_rows=300)))


def test_leading_weather_and_gap_before_the_cut(spark):
    hours = spark.range(60).select(
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))
         ).alias("timestamp"), "id")
    weather = hours.select("timestamp", F.when(F.col("id") >= 15, F.col("id").cast("double")).alias("temp"))
    readings = hours.select(F.lit("a").alias("station"), "timestamp", F.when(
        ~F.col("id").isin(8, 9, 10, 11, 12, 35), F.col("id").cast("double")).alias("pm25"))
    rows = {(r.fold, r.timestamp.hour + 24 * (r.timestamp.day - 1)): r for r in clean_train_only(
        readings, weather, "station").collect()}
    # Folds test 10 hours each, from hour 10 on. In fold 1 the gap from hour 8 on is open at the cut.
    assert [rows[1, h].pm25 for h in (8, 9, 10)] == [7.0, 7.0, 7.0] and (1, 11) not in rows
    # In fold 2 the whole gap lies in the training rows.
    assert [rows[2, h].pm25 for h in (8, 9, 10)] == [8.0, 9.0, 10.0] and (2, 11) not in rows
    # A test row's gap repeats the last value; as a training row it lies on the line.
    assert rows[3, 35].pm25 == 34.0 and rows[4, 35].pm25 == 35.0
    assert rows[1, 3].temp is None and rows[2, 3].temp == 15.0


def test_fences_of_nested_parts(spark):
    rows = spark.createDataFrame([("a", i % 3, float(i)) for i in range(30)] + [("b", 2, 1.0)], "k string, test_fold int, v double")
    found = {(r.k, r.fold): r.v_fence for r in fold_fences(rows, ["v"], ["k"], 2).collect()}
    first, both = [float(i) for i in range(0, 30, 3)], [float(i) for i in range(30) if i % 3 < 2]
    import numpy as np
    for u, own in ((1, first), (2, both)):
        low, high = np.quantile(own, (0.25, 0.75))
        assert found["a", u] == pytest.approx(high + 3 * (high - low))
    assert found.get(("b", 1)) is None and found.get(("b", 2)) is None
