"""Feature rows for newly appended clean rows.

Lags count rows, which a streaming frame cannot do; each micro-batch therefore joins the last
rows of its series. Those are kept as a log: every batch adds a part with the last
``FeatureSettings.reach`` rows of just the series it has touched, dealt out to buckets by key, and
reads only the buckets of its series. From time to time the parts are merged into a snapshot.
Parts are named after their batch, so a repeated batch finds the same input and writes the same
output.

A row that is not later than what its series already has cannot be appended. It is set aside, the
stream goes on, and :func:`repair_late` computes just the rows of its series from there on anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..config import FeatureSettings, ScaleSettings
from ..operators.features import all_features, complete_rows, feature_names
from ..operators.scale import attach, settle
from ..operators.summary import last_rows

#: Folders that a part is dealt out to, and batches between two snapshots.
BUCKETS, MERGE_EVERY = 64, 16


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, base: str, folders: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of those folders that exist."""
    found = spark.createDataFrame([], schema)
    for folder in folders:
        try:
            found = found.unionByName(spark.read.schema(schema).parquet(f"{base}/{folder}"))
        except AnalysisException:
            continue
    return found


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("__version", T.LongType()),
                         T.StructField("bucket", T.IntegerType())])


def _log(spark: SparkSession, base: str, batch: int, schema: T.StructType) -> DataFrame:
    """All parts a batch may see: the newest snapshot before it and what came after that.

    Batch n has version 2n, a repair after it 2n + 1. A snapshot is made as its batch begins.
    """
    start = batch - batch % MERGE_EVERY
    while start > 0 and not _exists(spark, f"{base}/carry/snapshot={start}/_SUCCESS"):
        start -= MERGE_EVERY
    folders = [f"carry/part={v}" for v in range(2 * max(start, 0), 2 * batch)]
    return _read(spark, base, [f"carry/snapshot={start}", *folders], _stored(schema))


def _newest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each series the rows of its newest version."""
    newest = F.max("__version").over(Window.partitionBy(*keys))
    return log.withColumn("__newest", newest).where("__version = __newest").drop("__newest")


def carried_rows(spark: SparkSession, base: str, batch: int, schema: T.StructType,
                 keys: Sequence[str], touched: DataFrame | None = None) -> DataFrame:
    """The last rows of the touched series (or of all) as the batch finds them.

    At most ``BUCKETS`` numbers come to the driver; other buckets are not read.
    """
    log = _log(spark, base, batch, schema)
    if touched is not None:
        buckets = [r[0] for r in touched.select(_bucket(keys)).distinct().collect()]
        on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
        names = touched.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
        log = log.where(F.col("bucket").isin(buckets)).join(names, on, "left_semi")
    return _newest(log, keys)


def _write_part(rows: DataFrame, base: str, version: int, keys: Sequence[str], reach: int, ts: str) -> None:
    last_rows(rows, reach, keys, ts).withColumns({
        "__version": F.lit(version).cast("bigint"), "bucket": _bucket(keys)}).write.mode(
        "overwrite").partitionBy("bucket").parquet(f"{base}/carry/part={version}")


def merge_log(spark: SparkSession, base: str, batch: int, schema: T.StructType,
              keys: Sequence[str]) -> None:
    """Snapshot of all series before a batch. What only the snapshot before the last one needed goes."""
    path = f"{base}/carry/snapshot={batch}"
    if not _exists(spark, f"{path}/_SUCCESS"):
        carried_rows(spark, base, batch, schema, keys).write.mode("overwrite").partitionBy("bucket").parquet(path)
    done = batch - MERGE_EVERY
    for b in range(max(0, done - MERGE_EVERY), done):
        for v in (2 * b, 2 * b + 1):
            _remove(spark, f"{base}/carry/part={v}")
    if done > 0:
        _remove(spark, f"{base}/carry/snapshot={done - MERGE_EVERY}")


def refresh_batch(new: DataFrame, batch: int, base: str, keys: Sequence[str],
                  ts: str = "timestamp", target: str = "pm25",
                  settings: FeatureSettings = FeatureSettings(),
                  scale: ScaleSettings = ScaleSettings()) -> None:
    """Write the feature rows of one batch, its part of the log, and its late rows."""
    spark, schema = new.sparkSession, new.schema
    if batch and batch % MERGE_EVERY == 0:
        merge_log(spark, base, batch, schema, keys)
    touched = settle(new.select(*keys).distinct())
    old = settle(carried_rows(spark, base, batch, schema, keys, touched).drop("__version", "bucket"))
    last = settle(old.groupBy(*keys).agg(F.max(ts).alias("__last")))
    marked = attach(new, last, keys, scale).withColumn(
        "__late", F.coalesce(F.col(ts) <= F.col("__last"), F.lit(False))).drop("__last")
    late = marked.where("__late").drop("__late")
    late.write.mode("overwrite").parquet(f"{base}/late/batch={batch}")
    new = marked.where("not __late").drop("__late")
    rows = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    wide = all_features(rows, keys, ts, target, settings, scale, keep=["__new"])
    names = feature_names(new.columns, target, settings)
    fresh = complete_rows(wide.where("__new").drop("__new"), [*names, target, ts])
    fresh.write.mode("overwrite").parquet(f"{base}/features/batch={batch}")
    _write_part(rows.drop("__new"), base, 2 * batch, keys, settings.reach, ts)


def refresh_features(clean: DataFrame, base: str, checkpoint: str, keys: Sequence[str],
                     ts: str = "timestamp", target: str = "pm25",
                     settings: FeatureSettings = FeatureSettings(),
                     scale: ScaleSettings = ScaleSettings()) -> StreamingQuery:
    """Run :func:`refresh_batch` over every micro-batch of a stream of clean rows."""
    def each(batch_rows: DataFrame, batch: int) -> None:
        refresh_batch(batch_rows, batch, base, keys, ts, target, settings, scale)

    return (clean.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def repair_late(history: DataFrame, base: str, batches: Sequence[int], keys: Sequence[str],
                ts: str = "timestamp", target: str = "pm25",
                settings: FeatureSettings = FeatureSettings(),
                scale: ScaleSettings = ScaleSettings()) -> None:
    """Feature rows of the series that have late rows in some batches, from the first late row on.

    ``history`` are all clean rows, late ones included; of the series in question it is read from
    ``reach`` rows before the first late row. Run it between two batches, after the last of
    ``batches``; it also renews the carried rows of those series.
    """
    spark, batch = history.sparkSession, max(batches)
    late = _read(spark, base, [f"late/batch={b}" for b in batches], history.schema)
    since = settle(late.groupBy(*keys).agg(F.min(ts).alias("__since")))
    own = settle(attach(history, since, keys, scale, "inner"))
    before = last_rows(own.where(F.col(ts) < F.col("__since")), settings.reach, keys, ts)
    rows = before.unionByName(own.where(F.col(ts) >= F.col("__since")))
    wide = all_features(rows.withColumn("__new", F.col(ts) >= F.col("__since")).drop("__since"),
                        keys, ts, target, settings, scale, keep=["__new"])
    names = feature_names(history.columns, target, settings)
    fresh = complete_rows(wide.where("__new").drop("__new"), [*names, target, ts])
    fresh.write.mode("overwrite").parquet(f"{base}/repairs/batch={batch}")
    since.write.mode("overwrite").parquet(f"{base}/repaired/batch={batch}")
    _write_part(rows.drop("__since"), base, 2 * batch + 1, keys, settings.reach, ts)


def current_features(spark: SparkSession, base: str, keys: Sequence[str],
                     ts: str = "timestamp") -> DataFrame:
    """The feature rows of all batches, without those that a later repair has replaced."""
    written = spark.read.parquet(f"{base}/features").withColumn("__version", 2 * F.col("batch")).drop("batch")
    try:
        repaired = spark.read.parquet(f"{base}/repaired").select(
            *[F.col(k).alias(f"__k_{k}") for k in keys], "__since", (2 * F.col("batch") + 1).alias("__by"))
        repairs = spark.read.parquet(f"{base}/repairs").withColumn("__version", 2 * F.col("batch") + 1).drop("batch")
    except AnalysisException:
        return written.drop("__version")
    every = written.unionByName(repairs)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    replaced = same & (F.col("__by") > F.col("__version")) & (F.col(ts) >= F.col("__since"))
    return every.join(repaired, replaced, "left_anti").drop("__version")
