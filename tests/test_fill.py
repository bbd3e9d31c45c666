import pytest
from helpers import column, hours, same_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hourloom.config import ScaleSettings
from hourloom.operators.fill import fill_series

_ = None
GAPS = [_, _, 1.0, _, _, _, _, _, 7.0, _, 9.0, _, _, _, _]


def test_interpolation_of_leading_inner_and_trailing_gaps(spark):
    out = fill_series(hours(spark, GAPS), ["station"], ["timestamp"], (), "v", 3)
    assert column(out, "v") == [_, _, 1, 2, 3, 4, _, _, 7, 8, 9, 9, 9, 9, _]


def test_edge_fill_goes_forward_then_backward(spark):
    out = fill_series(hours(spark, GAPS), ["station"], ["timestamp"], ["v"])
    assert column(out, "v") == [1, 1, 1, 1, 1, 1, 1, 1, 7, 7, 9, 9, 9, 9, 9]


def test_series_without_any_value_stays_missing(spark):
    df = hours(spark, [None] * 5)
    out = fill_series(df.withColumn("e", df.v), ["station"], ["timestamp"], ["e"], "v", 3)
    assert column(out, "v") == [None] * 5
    assert column(out, "e") == [None] * 5


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.none(), st.floats(0, 100)), min_size=12, max_size=60),
       st.integers(2, 7))
def test_chunked_fill_equals_plain_fill(spark, values, size):
    df = hours(spark, values)
    df = df.withColumn("e", df.v)
    plain = fill_series(df, ["station"], ["timestamp"], ["e"], "v", 3)
    cut = fill_series(df, ["station"], ["timestamp"], ["e"], "v", 3,
                      ScaleSettings(max_group_rows=size))
    same_rows(plain, cut)


@pytest.mark.parametrize("limit", [1, 4])
def test_limit_is_respected(spark, limit):
    out = fill_series(hours(spark, [0.0] + [None] * 6 + [7.0]), ["station"], ["timestamp"], (),
                      "v", limit)
    expected = [float(i) if i <= limit or i == 7 else None for i in range(8)]
    assert column(out, "v") == pytest.approx(expected)
