"""Filling of missing values along a series.

Nothing here uses a frame that ends at UNBOUNDED FOLLOWING and starts at the current row: Spark
evaluates such a frame anew for every row. "First later value" is read from a window in
descending order, "first value of the series" from a frame over the whole partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import ScaleSettings
from .scale import (
    LONG_FIELDS, LongSeries, attach, chunk_rows, find_long, keep_once, settle, split_long,
)

FIRST, LAST, HERE = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


def edge_filled(c: str, window: WindowSpec, ahead: str | None = None) -> Column:
    """Last known value, else the first known value of the series."""
    upto, whole = window.rowsBetween(FIRST, HERE), window.rowsBetween(FIRST, LAST)
    return F.coalesce(F.last(c, True).over(upto), F.first(seen(F.col(c), ahead), True).over(whole))


def seen(value: Column, ahead: str | None) -> Column:
    """The value as earlier rows may see it: missing where ``ahead`` is given and not true."""
    return value if ahead is None else F.when(F.col(ahead), value)


def line_value(v: Column, at: Column, before: Column, after: Column, limit: int) -> Column:
    """Value on the line between the known neighbours, for the first ``limit`` rows of a gap.

    Rows count as equally spaced. A gap at the end repeats the last value, a gap at the start
    stays open. ``before`` and ``after`` are ``(value, row)`` structs.
    """
    pv, pi, nv, ni = before["v"], before["i"], after["v"], after["i"]
    run = at - pi
    slope = (nv - pv) / (ni - pi)
    return F.when(v.isNotNull(), v).when(
        run <= limit, F.when(ni.isNull(), pv).otherwise(pv + slope * run))


def known(column: str, at: str) -> Column:
    c = F.col(column)
    return F.when(c.isNotNull(), F.struct(c.alias("v"), F.col(at).alias("i")))


def fill_short(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               edge_columns: Sequence[str] = (), line_column: str | None = None,
               limit: int = 3, ahead: str | None = None) -> DataFrame:
    """Fills inside one window partition per series: one exchange for all columns.

    ``ahead`` names a flag: only rows that have it may lend their values to earlier rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    wanted = {c: edge_filled(c, window, ahead) for c in edge_columns}
    if line_column is None:
        return df.withColumns(wanted) if wanted else df
    df = df.withColumns({**wanted, "__i": F.row_number().over(window)})
    df = df.withColumn("__known", known(line_column, "__i"))
    df = df.withColumn("__prev", F.last("__known", True).over(window.rowsBetween(FIRST, HERE)))
    back = Window.partitionBy(*keys).orderBy(F.desc("__i"))
    df = df.withColumn("__next", F.last(seen(F.col("__known"), ahead), True).over(back.rowsBetween(FIRST, HERE)))
    filled = line_value(F.col(line_column), F.col("__i"), F.col("__prev"), F.col("__next"), limit)
    return df.withColumn(line_column, filled).drop("__i", "__known", "__prev", "__next")


def fill_long(hot: DataFrame, keys: Sequence[str], order: Sequence[str], scale: ScaleSettings,
              edge_columns: Sequence[str] = (), line_column: str | None = None,
              limit: int = 3, ahead: str | None = None) -> DataFrame:
    """Same fills for long series: each chunk learns what lies before and after it.

    The table of chunks has one row per ``max_group_rows`` rows of a series.
    """
    rows = chunk_rows(hot, keys, order, scale)
    tracked = list(dict.fromkeys([*edge_columns, *([line_column] if line_column else [])]))
    rows = rows.withColumns({f"__s_{c}": known(c, "__at") for c in tracked})
    ends = rows.groupBy(*keys, "__home").agg(
        *[F.max_by(f"__s_{c}", F.col(f"__s_{c}.i")).alias(f"__z_{c}") for c in tracked],
        *[F.min_by(seen(F.col(f"__s_{c}"), ahead), seen(F.col(f"__s_{c}.i"), ahead)).alias(f"__a_{c}")
          for c in tracked])
    onward = Window.partitionBy(*keys).orderBy("__home")
    behind = Window.partitionBy(*keys).orderBy(F.desc("__home"))
    carried = []
    for c in tracked:
        carried += [
            F.last(f"__z_{c}", True).over(onward.rowsBetween(FIRST, -1)).alias(f"__before_{c}"),
            F.last(f"__a_{c}", True).over(behind.rowsBetween(FIRST, -1)).alias(f"__after_{c}"),
            F.first(f"__a_{c}", True).over(onward.rowsBetween(FIRST, LAST)).alias(f"__start_{c}")]
    table = settle(ends.select(*keys, "__home", *carried))
    rows = attach(rows, table, [*keys, "__home"], scale)
    window = Window.partitionBy(*keys, "__home").orderBy("__at")
    back = Window.partitionBy(*keys, "__home").orderBy(F.desc("__at"))
    prev = {c: F.coalesce(F.last(f"__s_{c}", True).over(window.rowsBetween(FIRST, HERE)),
                          F.col(f"__before_{c}")) for c in tracked}
    rows = rows.withColumns({f"__prev_{c}": prev[c] for c in tracked})
    out = {c: F.coalesce(F.col(f"__prev_{c}.v"), F.col(f"__start_{c}.v")) for c in edge_columns}
    if line_column:
        rows = rows.withColumn("__next", F.coalesce(
            F.last(seen(F.col(f"__s_{line_column}"), ahead), True).over(back.rowsBetween(FIRST, HERE)),
            F.col(f"__after_{line_column}")))
        out[line_column] = line_value(F.col(line_column), F.col("__at"),
                                      F.col(f"__prev_{line_column}"), F.col("__next"), limit)
    rows = rows.withColumns(out)
    return rows.select(*[c for c in hot.columns if c not in LONG_FIELDS])


def fill_series(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                edge_columns: Sequence[str] = (), line_column: str | None = None,
                limit: int = 3, scale: ScaleSettings = ScaleSettings(),
                rows_bound: int | None = None,
                long: LongSeries | None | str = "measure", ahead: str | None = None) -> DataFrame:
    """Edge fill (last, else first known value) and bounded interpolation along each series."""
    edge_columns = [c for c in edge_columns if c in df.columns]
    if long == "measure":
        long = find_long(df, keys, scale, rows_bound)
    if long is None:
        return fill_short(df, keys, order, edge_columns, line_column, limit, ahead)
    short, hot = split_long(keep_once(df), long, scale)
    return fill_short(short, keys, order, edge_columns, line_column, limit, ahead).unionByName(
        fill_long(hot, keys, order, scale, edge_columns, line_column, limit, ahead))
