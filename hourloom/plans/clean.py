"""Cleaning of aligned hourly readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import READING_COLUMNS, WEATHER_COLUMNS, CleanSettings, ScaleSettings
from ..functions.scalars import clip_lower, clip_upper, nan_free
from ..operators.align import join_on_hour, overlay_last, to_hour
from ..operators.fences import QUARTILES, clip_to_fences, fence
from ..operators.fill import fill_long, fill_series, fill_short
from ..operators.scale import (
    attach, find_long, keep_once, row_positions, settle, split_long,
)


def _clip_short(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str],
                factor: float) -> DataFrame:
    """Fences of short series, computed in the window the fills need anyway."""
    whole = Window.partitionBy(*keys).orderBy(ts).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.array(*[F.lit(p) for p in QUARTILES])
    df = df.withColumns({f"__q_{c}": F.percentile(c, wanted).over(whole) for c in columns})
    return df.withColumns({
        c: clip_upper(F.col(c), fence(F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1], factor))
        for c in columns}).drop(*[f"__q_{c}" for c in columns])


def clean_panel(panel: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp",
                settings: CleanSettings = CleanSettings(),
                scale: ScaleSettings = ScaleSettings(),
                rows_bound: int | None = None) -> DataFrame:
    """Clips, fills and drops on rows that are already aligned to hours.

    The order matters: negatives to zero, upper fences, weather fill, interpolation of the
    target, rows without target removed. Steps for absent columns are skipped.
    """
    s = settings
    fenced = [c for c in s.fenced if c in panel.columns]
    edges = [c for c in s.edge_filled if c in panel.columns]
    rows = nan_free(panel)
    rows = rows.withColumn(s.target, clip_lower(F.col(s.target), 0.0))
    used = list(keys) or ["__one"]
    if not keys:
        rows = rows.withColumn("__one", F.lit(1))
    long = find_long(rows, used, scale, rows_bound)

    def short_plan(d: DataFrame) -> DataFrame:
        clipped = _clip_short(d, used, ts, fenced, s.fence_factor)
        return fill_short(clipped, used, [ts], edges, s.target, s.interpolate_limit)

    if long is None:
        filled = short_plan(rows)
    else:
        short, hot = split_long(keep_once(rows), long, scale)
        hot_rows = hot.drop("__n")
        clipped = clip_to_fences(hot_rows, fenced, used, s.fence_factor, scale, long)
        _, again = split_long(clipped, long, scale)
        filled = short_plan(short).unionByName(
            fill_long(again, used, [ts], scale, edges, s.target, s.interpolate_limit))
    return filled.dropna(subset=[s.target]).drop("__one")


def panel_within(readings: DataFrame, weather: DataFrame, key: str, ts: str, settings: CleanSettings,
                 scale: ScaleSettings, look_ahead: bool = True, live: DataFrame | None = None
                 ) -> tuple[DataFrame, int]:
    """Shared weather and readings of each series, from its first reading to ``interpolate_limit``
    weather hours after its last, and a bound of the rows of a series. ``live`` rows count as
    readings for the span, so that one can be laid over its hour.

    Rows outside would have no target after cleaning. As fills of the weather look beyond, it is
    filled before, once per hour; without ``look_ahead`` only from earlier hours. Spans are places
    among the weather hours, so a stray hour far away costs one row. The hourly readings are
    computed once.
    """
    edges = [c for c in settings.edge_filled if c in weather.columns]
    there = [c for c in READING_COLUMNS if c in readings.columns]
    one = nan_free(weather).withColumn("__one", F.lit(1))
    n = one.count()
    one = one.withColumn("__ahead", F.lit(look_ahead))
    filled = fill_series(one, ["__one"], [ts], edges, scale=scale, rows_bound=n, ahead="__ahead")
    hours = settle(row_positions(filled, ["__one"], [ts], "__hour", scale, n).drop("__one", "__ahead"))
    heard = settle(readings.select(key, ts, *there))
    told = heard.select(key, ts)
    if live is not None:
        own = heard.select(key).distinct()
        told = told.union(live.select(key, ts).join(own, key, "left_semi"))
    spans = settle(told.join(hours.select(ts, "__hour"), ts).groupBy(key).agg(
        F.min("__hour").alias("__first"), F.count(F.lit(1)).alias("__n"),
        F.least(F.max("__hour") + settings.interpolate_limit, F.lit(n - 1)).alias("__last")))
    bound = spans.agg(F.max(F.col("__last") - F.col("__first") + 1 + F.col("__n"))).first()[0] or 0
    grid = spans.select(key, F.explode(F.sequence("__first", "__last")).alias("__hour"))
    panel = attach(grid, hours, ["__hour"], scale, "inner").drop("__hour")
    return panel.join(heard, [key, ts], "left"), bound


def clean_and_bound(readings: DataFrame, weather: DataFrame, key: str | None = None,
                    ts: str = "timestamp", settings: CleanSettings = CleanSettings(),
                    scale: ScaleSettings = ScaleSettings(), live: DataFrame | None = None,
                    live_ordinal: str = "ordinal", rows_bound: int | None = None
                    ) -> tuple[DataFrame, int | None]:
    """:func:`clean_series`, and a bound of the rows of a series if one is known."""
    weather, readings = to_hour(weather, ts), to_hour(readings, ts)
    live = None if live is None else to_hour(live, ts)
    if key is not None and key not in weather.columns:
        joined, bound = panel_within(readings, weather, key, ts, settings, scale, live=live)
        rows_bound = bound if rows_bound is None else min(bound, rows_bound)
    else:
        joined = join_on_hour(weather, readings, key, ts, scale=scale)
    if live is not None:
        joined = overlay_last(joined, live, live_ordinal, key, ts, settings.target, scale)
    keys = [key] if key else []
    columns = [c for c in (*WEATHER_COLUMNS, *READING_COLUMNS) if c in joined.columns]
    return clean_panel(joined.select(*keys, ts, *columns), keys, ts, settings, scale, rows_bound), rows_bound


def clean_series(readings: DataFrame, weather: DataFrame, key: str | None = None,
                 ts: str = "timestamp", settings: CleanSettings = CleanSettings(),
                 scale: ScaleSettings = ScaleSettings(), live: DataFrame | None = None,
                 live_ordinal: str = "ordinal", rows_bound: int | None = None) -> DataFrame:
    """Readings joined to weather hours, overlaid with the last live row, and cleaned."""
    return clean_and_bound(readings, weather, key, ts, settings, scale, live, live_ordinal, rows_bound)[0]
