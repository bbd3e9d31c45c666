"""Landed readings as a stream of closed hours."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalars import floor_hour, instant_to_wall, wall_to_instant
from ..operators.scale import settle


def closed_hours(readings: DataFrame, key: str, ts: str, identity: Sequence[str],
                 measures: Sequence[Column], delay: str = "1 hour") -> DataFrame:
    """One row per series and hour, given out once the watermark has passed the hour.

    Copies of a reading (same ``identity``) that arrive within the delay count once. The
    identity spreads that step over all tasks; the hourly sums are combined before the shuffle.
    """
    timed = readings.withColumn("__at", wall_to_instant(F.col(ts))).withWatermark("__at", delay)
    once = timed.dropDuplicatesWithinWatermark(list(identity))
    hours = once.groupBy(F.window("__at", "1 hour").alias("__w"), key).agg(*measures)
    rest = [c for c in hours.columns if c not in ("__w", key)]
    return hours.select(key, instant_to_wall(F.col("__w.start")).alias("timestamp"), *rest)


def append_hours(hours: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed hours to a parquet table, one folder per day, and stop when caught up."""
    dated = hours.withColumn("day", F.to_date("timestamp"))
    return (dated.writeStream.format("parquet").outputMode("append").partitionBy("day")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def missed_hours(readings: DataFrame, written: DataFrame, key: str, ts: str,
                 identity: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """Hours that the stream has not written, because they were open when it ended, or has written
    without readings that came after the watermark; with the values they should have.

    A batch job over the readings given, which may be bounded to the days in question. Keep its
    rows with :func:`append_missed`; ``newest_hours`` reads the last of each hour.
    """
    hour = F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("timestamp")
    hours = readings.dropDuplicates(list(identity)).groupBy(key, hour).agg(*measures)
    on = [hours[c].eqNullSafe(written[c]) for c in hours.columns]
    return hours.join(written, reduce(lambda a, b: a & b, on), "left_anti")


def append_missed(missed: DataFrame, path: str, revision: int) -> None:
    """Adds corrected hours, marked with a revision over 0, to a table of their own: a stream's
    table is read by the stream's log and does not show files of others."""
    missed.withColumns({"day": F.to_date("timestamp"), "revision": F.lit(revision)}).write.mode(
        "append").partitionBy("day").parquet(path)


def newest_hours(written: DataFrame, missed: DataFrame, key: str) -> DataFrame:
    """One row per series and hour: the one of the highest revision; the stream's own have none."""
    both = written.withColumn("revision", F.lit(0)).unionByName(missed.select(*written.columns, "revision"))
    rest = [c for c in written.columns if c not in (key, "timestamp", "day")]
    return both.groupBy(key, "timestamp").agg(
        F.max_by(F.struct(*rest), "revision").alias("__row")).select(key, "timestamp", "__row.*")


# ---- hours that are repaired as late readings come ----------------------------------------


def _landed(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """Readings kept so far, each once, with the batch that brought it; by day."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType()),
                          T.StructField("day", T.DateType())])
    try:
        return spark.read.schema(whole).parquet(f"{base}/landed")
    except AnalysisException:
        return spark.createDataFrame([], whole)


def _newest_time(spark: SparkSession, base: str, batch: int):
    """Latest time of any reading before a batch."""
    try:
        marks = spark.read.parquet(f"{base}/marks")
    except AnalysisException:
        return None
    return marks.where(F.col("batch") < batch).agg(F.max("newest")).first()[0]


def record_batch(readings: DataFrame, batch: int, base: str, key: str, ts: str,
                 identity: Sequence[str], measures: Sequence[Column], delay: str = "1 hour") -> None:
    """Keep the readings of a batch and compute anew just the hours they are in.

    Hours go two ways: ``late`` ones had been closed before the batch (the watermark, ``delay``
    behind the latest reading, had passed their end), the others had not. Either way the hour is
    computed from all its readings, of which only the days touched are read. A reading that was
    kept before, by its ``identity`` on its day, does not count again. Every folder is named after
    the batch, so a repeated batch writes the same rows again.
    """
    spark, schema = readings.sparkSession, readings.schema
    came = readings.dropDuplicates(list(identity)).withColumn("day", F.to_date(ts))
    days = F.broadcast(settle(came.select("day").distinct()))  # one row per day
    kept = _landed(spark, base, schema).where(F.col("batch") < batch)
    seen = kept.join(days, "day", "left_semi").select("day", *identity)
    same = reduce(lambda a, b: a & b, [came[c].eqNullSafe(seen[c]) for c in ("day", *identity)])
    came.join(seen, same, "left_anti").write.mode("overwrite").partitionBy("day").parquet(
        f"{base}/landed/batch={batch}")

    hour = floor_hour(F.col(ts))
    landed = _landed(spark, base, schema).where(F.col("batch") <= batch).withColumn("timestamp", hour)
    touched = settle(landed.where(F.col("batch") == batch).select("day", key, "timestamp").distinct())
    own = touched.select("day", F.col(key).alias("__key"), F.col("timestamp").alias("__hour"))
    again = landed.join(days, "day", "left_semi").join(
        own.drop("day"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("timestamp") == F.col("__hour")), "left_semi")
    before = _newest_time(spark, base, batch)
    closed = F.lit(False) if before is None else F.coalesce(
        F.col("timestamp") + F.expr("INTERVAL 1 HOUR") <= F.lit(before.isoformat(sep=" ")).cast(
            "timestamp_ntz") - F.expr(f"INTERVAL {delay}"), F.lit(False))
    again.groupBy(key, "timestamp").agg(*measures).withColumn("late", closed).write.mode(
        "overwrite").partitionBy("late").parquet(f"{base}/hours/batch={batch}")
    landed.where(F.col("batch") == batch).agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(
        f"{base}/marks/batch={batch}")


def record_hours(readings: DataFrame, base: str, checkpoint: str, key: str, ts: str,
                 identity: Sequence[str], measures: Sequence[Column], delay: str = "1 hour") -> StreamingQuery:
    """Run :func:`record_batch` over every micro-batch of a stream of readings."""
    def each(rows: DataFrame, batch: int) -> None:
        record_batch(rows, batch, base, key, ts, identity, measures, delay)

    return (readings.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def recorded_hours(spark: SparkSession, base: str, key: str) -> DataFrame:
    """One row per series and hour, as of its newest batch; hours still open are there as well."""
    every = spark.read.parquet(f"{base}/hours").drop("late")
    rest = [c for c in every.columns if c not in (key, "timestamp", "batch")]
    return every.groupBy(key, "timestamp").agg(
        F.max_by(F.struct(*rest), "batch").alias("__row")).select(key, "timestamp", "__row.*")


def late_hours(spark: SparkSession, base: str) -> DataFrame:
    """Every repair of an hour that had been closed: series, hour, values and batch."""
    return spark.read.parquet(f"{base}/hours").where(F.col("late").cast("boolean")).drop("late")
