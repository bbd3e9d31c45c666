"""Stored tables: bounded history loads, dated sinks, result tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def history_bounds(as_of: date, days: int, publication_lag: int = 7) -> tuple[date, date]:
    """First and last day of a load, both included."""
    last = as_of - timedelta(days=publication_lag)
    return last - timedelta(days=days), last


def bounded_history(df: DataFrame, as_of: date, days: int, ts: str = "timestamp",
                    publication_lag: int = 7) -> DataFrame:
    """Rows of the bounded period; the two comparisons reach the parquet scan."""
    first, last = history_bounds(as_of, days, publication_lag)
    day = lambda d: F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")
    return df.where((F.col(ts) >= day(first)) & (F.col(ts) < day(last + timedelta(days=1))))


def write_dated(df: DataFrame, path: str, run_date: date, fmt: str = "parquet") -> None:
    """One directory per run date; writing a date again replaces only that date."""
    out = df.withColumn("run_date", F.lit(run_date.isoformat()).cast("date"))
    writer = out.write.mode("overwrite").partitionBy("run_date").format(fmt)
    writer.option("partitionOverwriteMode", "dynamic").option("header", "true").save(path)


def read_dated(spark: SparkSession, path: str, run_date: date, schema: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """The rows of one run date; other dates are pruned, not read."""
    reader = spark.read.format(fmt).option("header", "true")
    reader = reader.schema(f"{schema}, run_date date") if schema else reader
    return reader.load(path).where(
        F.col("run_date") == F.lit(run_date.isoformat()).cast("date")).drop("run_date")


def write_records(df: DataFrame, path: str) -> None:
    """Result rows as JSON records."""
    df.write.mode("overwrite").json(path)
