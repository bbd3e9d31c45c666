"""The plan for long series gives the rows of the plain plan."""

import random
import struct

import numpy as np
import pytest
from helpers import plan_text, same_rows
from pyspark.sql import functions as F

from hourloom import fixtures as fx
from hourloom.config import ScaleSettings
from hourloom.operators import scale as scale_module
from hourloom.operators.features import build_features
from hourloom.operators.fill import fill_series
from hourloom.operators.order_stats import bits_value, nested_quantiles, ordered_bits, quantiles
from hourloom.operators.scale import along_series, attach, part_count, range_parts, row_positions, settle, table_bytes
from hourloom.plans.clean import clean_panel

CUT = ScaleSettings(max_group_rows=200)


@pytest.fixture(scope="module")
def panel(spark, folder):
    return settle(fx.panel(spark, folder))


def test_positions(spark, folder):
    rows = fx.events(spark, folder).select("event_type", "ts", "event_id")
    # One event type holds most rows, the others stay under the limit.
    skewed = rows.withColumn("event_type", F.when(F.col("event_id") % 7 < 5, "hot").otherwise(
        F.col("event_type")))
    plain = row_positions(skewed, ["event_type"], ["ts", "event_id"])
    same_rows(plain, row_positions(skewed, ["event_type"], ["ts", "event_id"],
                                   scale=ScaleSettings(max_group_rows=60)))


def test_positions_when_most_rows_share_one_time_and_one_is_far_off(spark):
    rows = spark.range(4000).select(
        F.lit("a").alias("k"),
        F.when(F.col("id") == 7, "2999-01-01").when(F.col("id") == 8, None)
        .when(F.col("id") % 4 < 3, "2024-01-01 05:00:00").otherwise(
            F.concat(F.lit("2024-01-01 05:00:00."), (F.col("id") + 1000).cast("string")))
        .cast("timestamp_ntz").alias("ts"),
        (F.xxhash64("id") % 10**6).alias("second"), "id")
    order = ["ts", "second", "id"]
    same_rows(row_positions(rows, ["k"], order),
              row_positions(rows, ["k"], order, scale=ScaleSettings(max_group_rows=90)))


def test_positions_with_missing_and_close_large_values(spark):
    rows = spark.range(1200).select(
        F.lit("a").alias("k"), F.when(F.col("id") % 2 == 0, 5.0).alias("ts"),
        (F.lit(2**60) + F.col("id") % 3).alias("big"), (1200 - F.col("id")).alias("id"))
    for order in (["ts", "id"], ["big", "id"], ["ts", "big", "id"]):
        same_rows(row_positions(rows, ["k"], order),
                  row_positions(rows, ["k"], order, scale=ScaleSettings(max_group_rows=70)))


def test_positions_with_a_text_in_the_order(spark):
    rows = spark.range(900).select(F.lit("a").alias("k"), (F.col("id") % 3).alias("ts"),
                                   F.sha2(F.col("id").cast("string"), 256).alias("name"), "id")
    same_rows(row_positions(rows, ["k"], ["ts", "name", "id"]),
              row_positions(rows, ["k"], ["ts", "name", "id"],
                            scale=ScaleSettings(max_group_rows=50)))


@pytest.mark.parametrize("order", ["text", "big", "same"])
def test_no_part_is_much_wider_than_the_limit(spark, order):
    rows = spark.range(4000).select(
        F.lit("a").alias("k"), F.concat(F.lit("t"), F.col("id") % 1300).alias("text"),
        (F.lit(2**60) + F.col("id") % 1300).alias("big"), F.lit(1).alias("same"), "id")
    scale = ScaleSettings(max_group_rows=200)
    parts = range_parts(rows, ["k"], [order], scale).groupBy("__part").count()
    assert parts.agg(F.max("count")).first()[0] <= 200
    same_rows(row_positions(rows, ["k"], [order, "id"]), row_positions(rows, ["k"], [order, "id"], scale=scale))


def test_many_rows_over_a_low_limit_make_few_parts(spark):
    """The driver takes a sample of the keys for every part."""
    rows = spark.range(15_000).select(F.lit("a").alias("k"), (F.col("id") % 7).alias("ts"), "id")
    scale = ScaleSettings(max_group_rows=50)
    assert range_parts(rows, ["k"], ["ts", "id"], scale).agg(F.max("__part")).first()[0] < 200
    same_rows(row_positions(rows, ["k"], ["ts", "id"]), row_positions(rows, ["k"], ["ts", "id"], scale=scale))
    assert [part_count(n, 5_000) for n in (1, 600_000, 36_000_000, 216_000_000)] == [1, 200, 200, 432]
    assert part_count(216_000_000, 1_000_000) == 432


def most_parts(monkeypatch):
    """The numbers of parts that the plans for long series divide rows into from now on."""
    seen, divide = [], scale_module.range_parts

    def watched(*args):
        placed = divide(*args)
        seen.append(placed.agg(F.max("__part")).first()[0] + 1)
        return placed

    monkeypatch.setattr(scale_module, "range_parts", watched)
    return seen


def test_fills_of_many_rows_over_a_low_limit_use_few_parts(spark, monkeypatch):
    seen = most_parts(monkeypatch)
    rows = spark.range(15_000).select(F.lit("a").alias("k"), (F.col("id") % 7).alias("ts"), "id", F.when(
        F.col("id") % 5 == 0, F.col("id") * 1.0).alias("v"), F.when(F.col("id") % 9 == 4, F.col("id") * 2.0).alias("w"))
    cut = fill_series(rows, ["k"], ["ts", "id"], ["v"], "w", 3, ScaleSettings(max_group_rows=50))
    assert len(seen) == 1 and seen[0] <= 200
    same_rows(cut, fill_series(rows, ["k"], ["ts", "id"], ["v"], "w", 3))


def test_windows_of_many_rows_over_a_low_limit_use_few_parts(spark, monkeypatch):
    seen = most_parts(monkeypatch)
    rows = spark.range(15_000).select(F.lit("a").alias("k"), (F.col("id") % 7).alias("ts"), "id")

    def step(df, window):
        return df.withColumns({"back": F.lag("id", 40).over(window), "sum": F.sum("id").over(window.rowsBetween(-9, -1))})

    cut = along_series(rows, ["k"], ["ts", "id"], 40, step, ScaleSettings(max_group_rows=50))
    assert len(seen) == 1 and seen[0] <= 200
    same_rows(cut, along_series(rows, ["k"], ["ts", "id"], 40, step))


def test_cleaning(panel):
    same_rows(clean_panel(panel, ["station"]), clean_panel(panel, ["station"], scale=CUT))


def test_features(panel):
    clean = settle(clean_panel(panel, ["station"]))
    same_rows(build_features(clean, ["station"]),
              build_features(clean, ["station"], scale=CUT), digits=8)


def test_single_series_without_key(panel):
    one = panel.where("station = 'click'").drop("station")
    plain = clean_panel(one)
    same_rows(plain, clean_panel(one, scale=CUT))
    same_rows(build_features(plain), build_features(plain, scale=CUT), digits=8)


@pytest.mark.parametrize("shape", ["smooth", "ties", "outliers", "constant", "missing"])
def test_counted_quantiles_are_exact(spark, shape):
    rng = random.Random(7)
    draw = {
        "smooth": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(0, 3)),
        "outliers": lambda: rng.choice(
            [rng.random(), 1e300, -1e300, 5e-324, -5e-324, 2.0 ** -1022, 0.0, -0.0, 1e-310]),
        "constant": lambda: 5.0, "missing": lambda: rng.choice([None, rng.random()])}[shape]
    values = [draw() for _ in range(3000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 2.0)],
                               "k string, v double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    out = {r["k"]: r for r in quantiles(
        df, ["v"], probs, ["k"],
        ScaleSettings(max_group_rows=100)).collect()}
    expected = np.quantile([v for v in values if v is not None], probs)
    assert list(out["a"])[1:] == pytest.approx(list(expected), rel=1e-12)
    assert out["b"]["v_p50"] == 1.5


def test_bits_keep_order_and_value(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 1.7976931348623157e308, -1e308, 1.0, 2.0, 0.5, float("inf"),
              float("-inf"), 1 - 2.0 ** -53, 1 + 2.0 ** -52, 2.0 ** 1023, 2.0 ** -1074 * 77]
    values += [2.0 ** k for k in range(-1074, 1024, 7)]
    values += [rng.choice((1, -1)) * rng.random() * 10.0 ** rng.randint(-320, 300) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", ordered_bits(F.col("v")).alias("b")).select("v", "b", bits_value(F.col("b")).alias("back")).collect()
    for r in rows:
        assert r.back == r.v
        assert abs(r.b) == struct.unpack("<q", struct.pack("<d", abs(r.v)))[0] and (r.b < 0) == (r.v < 0)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(ordered_bits(F.col("v")).alias("b"))
    assert [r.b for r in odd.collect()] == [None, None]


@pytest.mark.parametrize("limit", [100, 10_000])
def test_nested_quantiles(spark, limit):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), rng.randint(0, 4), rng.choice([None, rng.gauss(0, 1), 0.5]), float(rng.randint(0, 9)))
            for _ in range(1500)] + [("c", 3, 1.0, None), ("c", 4, None, None)]
    df = spark.createDataFrame(rows, "k string, part int, v double, w double")
    found = nested_quantiles(df, ["v", "w"], (0.25, 0.75, 1.0), ["k"], "part", [1, 2, 4], ScaleSettings(max_group_rows=limit))
    got = {(r.k, r.part): list(r)[2:] for r in found.collect()}
    assert set(got) == {(k, u) for k in "abc" for u in (1, 2, 4)}
    for (k, u), q in got.items():
        for c in (0, 1):
            own = [r[2 + c] for r in rows if r[0] == k and r[1] < u and r[2 + c] is not None]
            want = list(np.quantile(own, (0.25, 0.75, 1.0))) if own else [None] * 3
            assert q[3 * c:3 * c + 3] == (pytest.approx(want, rel=1e-12) if own else want)


def test_global_quantiles(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    row = quantiles(df, ["v"], (0.25, 0.5), scale=ScaleSettings(max_group_rows=10)).first()
    assert (row["v_p25"], row["v_p50"]) == (250.0, 500.0)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_joined_attach_equals_broadcast(spark, how):
    big = spark.range(500).select(
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 4).alias("k"), "id")
    small = settle(spark.createDataFrame([(None, 1.0), (1, 2.0), (2, 3.0)], "k long, w double"))
    plain = attach(big, small, ["k"], ScaleSettings(), how)
    same_rows(plain, attach(big, small, ["k"], ScaleSettings(broadcast_bytes=0), how))
    assert plain.where("k is null and w = 1.0").count() == 100


def test_table_bytes_counts_what_is_nested(spark):
    flat = settle(spark.createDataFrame([("x" * 1000,)], "v string"))
    deep = settle(spark.createDataFrame([([("x" * 1000, 1.0)] * 50,)], "v array<struct<a: string, b: double>>"))
    assert table_bytes(flat) > 1000 and table_bytes(deep) > 50_000


def test_both_quantile_plans_agree_to_the_last_bit(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(997)], "v double")
    probs = (0.1, 0.25, 0.3333, 0.5, 0.75, 0.999)
    plain = quantiles(df, ["v"], probs).first()
    assert quantiles(df, ["v"], probs, scale=ScaleSettings(max_group_rows=50)).first() == plain


def test_what_long_series_come_from_is_computed_once(spark, folder):
    """The plan reads the rows it has kept, not their source."""
    source = fx.events(spark, folder).select("event_type", "ts", "event_id", F.when(
        F.col("event_id") % 3 > 0, F.col("value")).alias("v"))
    out = fill_series(source, ["event_type"], ["ts", "event_id"], ["v"], None, 3, ScaleSettings(max_group_rows=60))
    assert "events.parquet" in plan_text(source) and "events.parquet" not in plan_text(out)
    same_rows(out, fill_series(source, ["event_type"], ["ts", "event_id"], ["v"]))
