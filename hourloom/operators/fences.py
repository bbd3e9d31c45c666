"""Upper fence of a series: third quartile plus a multiple of the quartile distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScaleSettings
from ..functions.scalars import clip_upper
from .order_stats import quantile_name, quantiles
from .scale import attach, settle

QUARTILES = (0.25, 0.75)


def fence(q1: Column, q3: Column, factor: float) -> Column:
    return q3 + F.lit(float(factor)) * (q3 - q1)


def upper_fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                 factor: float = 3.0, scale: ScaleSettings = ScaleSettings(),
                 long="measure") -> DataFrame:
    """One row per group: quartiles and ``<column>_fence`` of the columns that exist."""
    there = [c for c in columns if c in df.columns]
    found = quantiles(df, there, QUARTILES, by, scale, long)
    return found.withColumns({
        f"{c}_fence": fence(F.col(quantile_name(c, 0.25)), F.col(quantile_name(c, 0.75)), factor)
        for c in there})


def with_fences(df: DataFrame, columns: Sequence[str], by: Sequence[str], factor: float,
                scale: ScaleSettings, long="measure") -> DataFrame:
    there = [c for c in columns if c in df.columns]
    table = settle(upper_fences(df, there, by, factor, scale, long)
                   .select(*by, *[f"{c}_fence" for c in there]))
    return attach(df, table, by, scale)


def clip_to_fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                   factor: float = 3.0, scale: ScaleSettings = ScaleSettings(),
                   long="measure") -> DataFrame:
    """Values strictly over their fence become the fence; columns that are absent are skipped."""
    there = [c for c in columns if c in df.columns]
    fenced = with_fences(df, there, by, factor, scale, long)
    return fenced.withColumns(
        {c: clip_upper(F.col(c), F.col(f"{c}_fence")) for c in there}
    ).drop(*[f"{c}_fence" for c in there])


def clipped_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (),
                   factor: float = 3.0, scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """How many values of each column lie over their fence."""
    there = [c for c in columns if c in df.columns]
    fenced = with_fences(df, there, by, factor, scale)
    return fenced.groupBy(*by).agg(*[
        F.count_if(F.col(c) > F.col(f"{c}_fence")).alias(f"{c}_clipped") for c in there])
