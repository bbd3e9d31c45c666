"""Read-side tables: latest and trailing rows, profiles, statistics, stage accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CRITICAL_LIMIT, GUIDELINE_LIMIT, ScaleSettings
from .order_stats import quantile_name, quantiles
from .scale import settle

FIXED_WIDTH = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType,
               T.TimestampNTZType)


def latest_rows(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """Row with the greatest time per series; combined before the shuffle.

    Columns of fixed width are picked one by one: such buffers stay in a hash aggregation,
    whereas a struct makes Spark sort every input row first. All of them see the rows in the
    same order, so they pick the same row.
    """
    rest = [c for c in df.columns if c not in (*keys, ts)]
    fixed = all(isinstance(df.schema[c].dataType, FIXED_WIDTH) for c in rest)
    if fixed and rest:
        picked = df.groupBy(*keys).agg(
            F.max(ts).alias(ts), *[F.max_by(c, ts).alias(c) for c in rest])
    else:
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(ts, *rest), F.col(ts)).alias("__row"))
        picked = picked.select(*keys, "__row.*")
    return picked.select(*df.columns)


def last_rows(df: DataFrame, n: int, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """The last n rows per series. Each task keeps at most n rows per series before the shuffle."""
    if not keys:
        return df.orderBy(F.desc(ts)).limit(n)
    back = Window.partitionBy(*keys).orderBy(F.desc(ts))
    return df.withColumn("__rn", F.row_number().over(back)).where(F.col("__rn") <= n).drop("__rn")


def hour_profile(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp",
                 value: str = "pm25") -> DataFrame:
    """Mean, sample deviation and mean ± deviation per hour of day."""
    found = df.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return found.withColumns({"upper": F.col("mean") + F.col("std"),
                              "lower": F.col("mean") - F.col("std")})


def trailing_statistics(df: DataFrame, n: int = 720, keys: Sequence[str] = (),
                        ts: str = "timestamp", value: str = "pm25") -> DataFrame:
    """Mean, maximum, critical rows and share over the guideline of the last n rows.

    A missing value counts as not over a limit but stays in the share's denominator.
    """
    over = F.when(F.col(value) > GUIDELINE_LIMIT, 1.0).otherwise(0.0)
    return last_rows(df, n, keys, ts).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"),
        F.count_if(F.col(value) > CRITICAL_LIMIT).alias("critical_rows"),
        (F.avg(over) * 100).alias("pct_over"))


def describe(df: DataFrame, columns: Sequence[str], digits: int = 2,
             scale: ScaleSettings = ScaleSettings()) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column, rounded half-even."""
    one = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    moments = one.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns])
    exact = settle(quantiles(one, columns, (0.25, 0.5, 0.75), (), scale))
    # Two one-row tables, put side by side on a constant.
    both = moments.withColumn("__one", F.lit(1)).join(
        exact.withColumn("__one", F.lit(1)), "__one", "left")
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"{c}.count").alias("count"),
        *[F.bround(F.col(f"{c}.{s}"), digits).alias(s) for s in ("mean", "std", "min")],
        *[F.bround(F.col(quantile_name(c, p)), digits).alias(quantile_name("q", p)[2:])
          for p in (0.25, 0.5, 0.75)],
        F.bround(F.col(f"{c}.max"), digits).alias("max")) for c in columns]))
    return both.select(rows.alias("r")).select("r.*")


def stage_account(df: DataFrame, stage: str, ts: str = "timestamp",
                  present: Sequence[str] = ()) -> DataFrame:
    """Rows, time span, and rows in which none of ``present`` is missing, in one aggregation."""
    kept = F.lit(True)
    for c in present:
        kept = kept & F.col(c).isNotNull()
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"),
                   F.max(ts).alias("last"), F.count_if(kept).alias("rows_kept"))
    lost = F.when(F.col("rows") > 0, (1 - F.col("rows_kept") / F.col("rows")) * 100).otherwise(0.0)
    return found.select(F.lit(stage).alias("stage"), "*",
                        (F.col("rows") - F.col("rows_kept")).alias("rows_lost"),
                        lost.alias("pct_lost"))
