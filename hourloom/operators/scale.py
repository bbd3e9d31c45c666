"""Plans that stay balanced when one series holds a large share of all rows.

Two plans exist for everything that runs "along a series":

* series within ``ScaleSettings.max_group_rows``: one window partition per series, so every
  lag, mean and fill shares one exchange and one sort;
* longer series: rows are divided by range once, which gives exact positions, are cut into chunks
  of equal row count, and each chunk is a window partition of its own. Rows that the next chunk has to look back at are
  copied into it and removed again.

Which plan a series takes is measured, not guessed, and both give the same rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ScaleSettings


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hourloom-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def settle(small: DataFrame) -> DataFrame:
    """Compute a small table once and keep it in the shared folder."""
    ensure_checkpoint_dir(small.sparkSession)
    return small.checkpoint(eager=True)


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about: texts by their length, arrays and structs by what they hold."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [value_bytes(value[f.name], f.dataType) for f in kind], F.lit(16))
    elif isinstance(kind, T.ArrayType):
        size = F.lit(24) + F.aggregate(
            F.transform(value, lambda x: value_bytes(x, kind.elementType).cast("bigint")),
            F.lit(0).cast("bigint"), lambda a, b: a + b)
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("bigint"), F.lit(8).cast("bigint"))


def table_bytes(small: DataFrame) -> int:
    """Size of a settled table, summed over its values."""
    row = reduce(lambda a, b: a + b, [value_bytes(F.col(f.name), f.dataType) for f in small.schema],
                 F.lit(16).cast("bigint"))
    return small.agg(F.sum(row)).first()[0] or 0


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str], scale: ScaleSettings,
           how: str = "left", size: int | None = None) -> DataFrame:
    """Join a settled per-key table onto ``df``, NULL keys included.

    Broadcast only after measuring it; ``size`` is its :func:`table_bytes` where the caller has
    measured already. Otherwise it is a plain equi-join, which adaptive execution splits where a
    key has very many rows.
    """
    renamed = small.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    if (table_bytes(small) if size is None else size) <= scale.broadcast_bytes:
        renamed = F.broadcast(renamed)
    return df.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


LONG_FIELDS = ("__n", "__tie")


@dataclass(frozen=True)
class LongSeries:
    """Settled table of the series over the row limit: keys and row count."""

    keys: tuple[str, ...]
    table: DataFrame


def find_long(df: DataFrame, keys: Sequence[str], scale: ScaleSettings,
              rows_bound: int | None = None) -> LongSeries | None:
    """Series with more rows than one task should hold; ``None`` when there is none.

    ``rows_bound`` is a bound the caller has measured or proved; without it the series are counted,
    which reads only the keys. The result has at most total rows / limit rows.
    """
    if rows_bound is not None and rows_bound <= scale.max_group_rows:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    found = settle(counts.where(F.col("__n") > scale.max_group_rows))
    return None if found.isEmpty() else LongSeries(tuple(keys), found)


def keep_once(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder with a running id, for a plan that reads them several times:
    what they come from is computed once, and ties in their order are told apart alike each time."""
    return settle_rows(df.withColumn("__tie", F.monotonically_increasing_id()))


def split_long(df: DataFrame, long: LongSeries, scale: ScaleSettings
               ) -> tuple[DataFrame, DataFrame]:
    """``(short, long)`` rows of ``df``; the long part carries ``LONG_FIELDS``."""
    marked = attach(df, long.table, long.keys, scale)
    return (marked.where(F.col("__n").isNull()).drop(*LONG_FIELDS),
            marked.where(F.col("__n").isNotNull()))


#: Low row limits make at most FEW_PARTS parts, or one per PART_ROWS rows if that is more: the driver takes
#: a sample of the keys for every part, and a part is sorted with spilling, so it may exceed the row limit.
PART_ROWS, FEW_PARTS = 500_000, 200


def part_count(rows: int, limit: int) -> int:
    """Parts of half of the row limit, but not very many small ones."""
    return max(1, min(-(-2 * rows // limit), max(FEW_PARTS, -(-rows // PART_ROWS))))


def range_parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                scale: ScaleSettings) -> DataFrame:
    """The rows in key and order, each with ``__part`` and ``__in_part`` (its place in that part).

    One shuffle by range and one sort, written to the shared folder, so that whatever follows
    reads the same numbers and nothing upstream is computed again. Any sortable column can be in
    the order; rows that agree in all of it are kept apart by a running id, so ties do not make a
    part wide either. Parts hold half of the row limit in the mean, or more where that would make
    more parts than :func:`part_count` allows.
    """
    spark = rows.sparkSession
    tied = rows if "__tie" in rows.columns else keep_once(rows)
    n = part_count(tied.count(), scale.max_group_rows)
    by = [*keys, *order, "__tie"]
    placed = tied.repartitionByRange(n, *by).sortWithinPartitions(*by).select(
        *[c for c in rows.columns if c != "__tie"], F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__in_part"))
    path = shared_path(spark)
    placed.write.parquet(path)
    return spark.read.schema(placed.schema).parquet(path)


def settle_rows(rows: DataFrame) -> DataFrame:
    """Rows written once, so that ranges are drawn from what is then divided."""
    path = shared_path(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/hourloom-{uuid4().hex}"


def _positions_of_long(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                       scale: ScaleSettings) -> DataFrame:
    """Exact 0-based row position in long series, without sorting a series in one task.

    A part can end one series and begin the next; where a series begins in it, and how many of
    its rows earlier parts have, is a table of a row per part and series.
    """
    placed = range_parts(rows.drop("__n"), keys, order, scale)
    parts = placed.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__in_part").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(parts.select(
        *keys, "__part",
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__start")))
    return (
        attach(placed, starts, [*keys, "__part"], scale)
        .withColumn(name, F.col("__start") + F.col("__in_part"))
        .drop("__part", "__in_part", "__start"))


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  name: str = "position", scale: ScaleSettings = ScaleSettings(),
                  rows_bound: int | None = None) -> DataFrame:
    """0-based position of every row in its series."""
    long = find_long(df, keys, scale, rows_bound)
    plain = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint")
    if long is None:
        return df.withColumn(name, plain)
    short, hot = split_long(keep_once(df), long, scale)
    return short.withColumn(name, plain).unionByName(
        _positions_of_long(hot, keys, order, name, scale))


def chunk_rows(hot: DataFrame, keys: Sequence[str], order: Sequence[str], scale: ScaleSettings,
               reach: int = 0) -> DataFrame:
    """Rows of long series with ``__at`` (position) and ``__home`` (chunk of equal row count)."""
    size = max(scale.max_group_rows, reach, 1)
    placed = _positions_of_long(hot, keys, order, "__at", scale)
    return placed.withColumn("__home", F.floor(F.col("__at") / F.lit(size)))


Along = Callable[[DataFrame, WindowSpec], DataFrame]


def along_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int,
                 step: Along, scale: ScaleSettings = ScaleSettings(),
                 rows_bound: int | None = None) -> DataFrame:
    """Apply ``step(df, window)``, whose columns look back at most ``reach`` rows.

    ``step`` receives a window over one series (or one chunk of it) in row order.
    """
    long = find_long(df, keys, scale, rows_bound)
    window = Window.partitionBy(*keys).orderBy(*order)
    if long is None:
        return step(df, window)
    short, hot = split_long(keep_once(df), long, scale)
    size = max(scale.max_group_rows, reach, 1)
    home = F.col("__home")
    wanted = F.when(F.col("__at") % size >= size - reach, F.array(home, home + 1)).otherwise(
        F.array(home))
    copied = chunk_rows(hot, keys, order, scale, reach).withColumn("__chunk", F.explode(wanted))
    chunked = step(copied, Window.partitionBy(*keys, "__chunk").orderBy("__at"))
    kept = chunked.where(F.col("__chunk") == home).drop("__chunk", "__home", "__at")
    return step(short, window).unionByName(kept)
