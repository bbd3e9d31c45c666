"""Exact quantiles that never hold a long group in one task, also of nested parts of a group.

Groups within the row limit use the built-in exact ``percentile``. For longer groups a double is
turned into a 64-bit integer of the same order, and the wanted rank is found digit by digit: the
rows of a group that share the digits found so far are counted by their next sixteen bits. Four
such counts give the value itself. Nothing is ordered but at most 2^16 counts, and the same
counts serve every wanted quantile.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScaleSettings
from .scale import (
    LongSeries, attach, find_long, settle, settle_rows, split_long, table_bytes,
)

DIGIT = 16
# The layout of a 64-bit floating-point number.
FRACTION, BIAS, INFINITE = 52, 1023, 2047


def quantile_name(column: str, prob: float) -> str:
    return f"{column}_p{prob * 100:g}".replace(".", "_")


def ordered_bits(v: Column) -> Column:
    """A 64-bit integer in the order of the doubles: the bits of the magnitude, with the sign.

    Both zeros are 0; NULL and NaN stay missing.
    """
    v = v.cast("double")
    there = v.isNotNull() & ~F.isnan(v)
    size = F.abs(F.when(there, v).otherwise(F.lit(0.0)))
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), size).cast("bigint")
    return F.when(there, F.when(v < 0, -bits).otherwise(bits))


def bits_value(bits: Column) -> Column:
    """Inverse of :func:`ordered_bits`."""
    size = F.abs(bits)
    exponent, fraction = F.shiftright(size, FRACTION), size.bitwiseAND(F.lit((1 << FRACTION) - 1))
    usual = (1.0 + fraction / float(1 << FRACTION)) * F.pow(
        F.lit(2.0), F.least(exponent, F.lit(INFINITE - 1)) - BIAS)
    value = F.when(exponent == 0, fraction.cast("double") * 2.0 ** -1074).when(
        exponent == INFINITE, F.lit(float("inf"))).otherwise(usual)
    return F.when(bits < 0, -value).otherwise(value)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              by: Sequence[str] = (), scale: ScaleSettings = ScaleSettings(),
              long: LongSeries | None | str = "measure") -> DataFrame:
    """One row per group: ``<column>_p<percent>``, linearly interpolated; missing is skipped."""
    keys = list(by) or ["__all"]
    rows = df.select(*by, *columns) if by else df.select(F.lit(0).alias("__all"), *columns)
    if long == "measure":
        long = find_long(rows, keys, scale)
    staged = rows.withColumn("__stage", F.lit(0))
    if long is None:
        found = _built_in(staged, columns, probs, keys, "__stage", [1])
    else:
        short, hot = split_long(settle_rows(staged), long, scale)
        found = _built_in(short, columns, probs, keys, "__stage", [1]).unionByName(
            counted_quantiles(hot.select(*keys, "__stage", *columns), columns, probs, keys, "__stage", [1], scale))
    return found.drop("__all", "__stage")


def nested_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     by: Sequence[str], stage: str, upto: Sequence[int],
                     scale: ScaleSettings = ScaleSettings(),
                     long: LongSeries | None | str = "measure") -> DataFrame:
    """Quantiles of what comes before each of some stages: a row per group and value ``u`` of
    ``upto``, in column ``stage``, over the group's rows with ``stage < u``.

    Every row is counted once, in its own stage; counts are summed up from stage to stage. A part
    without a value has missing quantiles.
    """
    keys, upto = list(by), sorted(upto)
    rows = df.select(*keys, stage, *columns).where(F.col(stage) < upto[-1])
    if long == "measure":
        long = find_long(rows, keys, scale)
    if long is None:
        return _built_in(rows, columns, probs, keys, stage, upto)
    short, hot = split_long(settle_rows(rows), long, scale)
    return _built_in(short, columns, probs, keys, stage, upto).unionByName(
        counted_quantiles(hot.select(*keys, stage, *columns), columns, probs, keys, stage, upto, scale))


def _built_in(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str],
              stage: str, upto: Sequence[int]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    found = df.groupBy(*keys).agg(*[
        F.percentile(F.when(F.col(stage) < u, F.col(c).cast("double")), wanted).alias(f"__q_{u}_{i}")
        for u in upto for i, c in enumerate(columns)])
    parts = F.array(*[F.struct(F.lit(u).cast("int").alias(stage), *[
        F.col(f"__q_{u}_{i}")[j].alias(quantile_name(c, p))
        for i, c in enumerate(columns) for j, p in enumerate(probs)]) for u in upto])
    return found.select(*keys, F.explode(parts).alias("__part")).select(*keys, "__part.*")


def _shifted(bits: Column, step: int) -> Column:
    """The first ``step`` digits of a number; none: zero."""
    return F.shiftright(bits, 64 - DIGIT * step) if step else F.lit(0).cast("bigint")


def _prefixes(column: int) -> Column:
    """Of a group's places those of a column, as an array that compiled code can search."""
    own = F.filter("__places", lambda x: x["col"] == column)
    return F.array_distinct(F.transform(own, lambda x: x["prefix"])).alias(f"__in{column}")


def counted_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                      keys: Sequence[str], stage: str, upto: Sequence[int],
                      scale: ScaleSettings) -> DataFrame:
    """The same as :func:`nested_quantiles` for groups of any length, by counting digits.

    The numbers are written once, side by side; each count reads one column of them.
    """
    numbers = settle_rows(df.select(*keys, F.col(stage).alias("__stage"), *[
        ordered_bits(F.col(c)).alias(f"__b{i}") for i, c in enumerate(columns)]))
    along = Window.partitionBy(*keys, "__col", "__prefix").orderBy("__digit").rowsBetween(
        Window.unboundedPreceding, 0)
    own = [F.count_if(F.col("__stage") < upto[0])] + [
        F.count_if((F.col("__stage") >= a) & (F.col("__stage") < b)) for a, b in zip(upto, upto[1:])]
    places, size = None, 0
    for step in range(64 // DIGIT):
        rows = numbers if places is None else attach(numbers, places, keys, scale, "inner", size)
        parts = []
        for i in range(len(columns)):
            bits, prefix = F.col(f"__b{i}"), _shifted(F.col(f"__b{i}"), step)
            wanted = bits.isNotNull()
            if places is not None:
                wanted = F.array_contains(f"__in{i}", prefix)
            digit = _shifted(bits, step + 1) - F.shiftleft(prefix, DIGIT)
            parts.append(rows.where(wanted).groupBy(
                *keys, F.lit(i).alias("__col"), prefix.alias("__prefix"), digit.alias("__digit")).agg(
                *[c.alias(f"__s{j}") for j, c in enumerate(own)]))
        # At most 2^16 rows for each place a rank lies in, whatever the group's length.
        counts = reduce(DataFrame.unionByName, parts)
        n = [reduce(lambda a, b: a + b, [F.col(f"__s{j}") for j in range(k + 1)]) for k in range(len(upto))]
        counts = counts.select(*keys, "__col", "__prefix", "__digit", *[c.alias(f"__n{k}") for k, c in enumerate(n)])
        counts = counts.withColumns({f"__u{k}": F.sum(f"__n{k}").over(along) for k in range(len(upto))})
        counts = counts.select(
            *keys, "__col", "__prefix", "__digit", *[F.array(*[F.col(f"__{x}{k}") for k in range(len(upto))])
                                                     .alias(name) for x, name in (("n", "__n"), ("u", "__upto"))])
        if places is None:
            counts = settle(counts)
            places = _first_places(counts, keys, probs, len(upto))
            size = table_bytes(places)
        own_place = F.filter("__places", lambda x: (x["col"] == F.col("__col")) & (x["prefix"] == F.col("__prefix")))
        before = lambda t: F.get("__upto", t["part"]) - F.get("__n", t["part"])
        hit = F.transform(
            F.filter(own_place[0]["targets"], lambda t: (F.get("__upto", t["part"]) > t["rank"]) & (before(t) <= t["rank"])),
            lambda t: t.withField("rank", t["rank"] - before(t)))
        found = attach(counts, places, keys, scale, "inner", size).select(*keys, F.struct(
            F.col("__col").alias("col"), (F.shiftleft("__prefix", DIGIT) + F.col("__digit")).alias("prefix"),
            hit.alias("targets")).alias("__place"))
        grouped = found.where(F.size("__place.targets") > 0).groupBy(*keys).agg(
            F.collect_list("__place").alias("__places"))
        places = settle(grouped.select("*", *[_prefixes(i) for i in range(len(columns))]))
        size = table_bytes(places)
    column = [*keys, "__col"]
    targets = places.select(*keys, F.explode("__places").alias("__p")).select(
        *keys, F.col("__p.col").alias("__col"), F.col("__p.prefix").alias("__prefix"),
        F.col("__p.targets").alias("__targets"))
    cells = targets.select(*column, bits_value(F.col("__prefix")).alias("__v"),
                           F.explode("__targets").alias("__t"))
    pick = cells.groupBy(*column, F.col("__t.part").alias("__part"), F.col("__t.prob").alias("__prob")).agg(
        F.max("__t.at").alias("__at"), F.min("__v").alias("__a"), F.max("__v").alias("__b"))
    lower = F.floor("__at")
    # The same arithmetic as the built-in, so that both plans agree to the last bit.
    value = F.when(lower == F.col("__at"), F.col("__a")).otherwise(
        (lower + 1 - F.col("__at")) * F.col("__a") + (F.col("__at") - lower) * F.col("__b"))
    groups = numbers.select(*keys).distinct().select(
        *keys, F.explode(F.sequence(F.lit(0), F.lit(len(upto) - 1))).alias("__part"))
    values = pick.select(*keys, "__col", "__part", "__prob", value.alias("__value")).groupBy(*keys, "__part").agg(*[
        F.max(F.when((F.col("__col") == i) & (F.col("__prob") == j), F.col("__value"))).alias(quantile_name(c, p))
        for i, c in enumerate(columns) for j, p in enumerate(probs)])
    named = F.element_at(F.array(*[F.lit(u).cast("int") for u in upto]), F.col("__part") + 1)
    return attach(groups, settle(values), [*keys, "__part"], scale).withColumn(stage, named).select(
        *keys, stage, *[quantile_name(c, p) for c in columns for p in probs])


def _first_places(counts: DataFrame, keys: Sequence[str], probs: Sequence[float], parts: int) -> DataFrame:
    """The ranks to find in each group and column: two neighbours for every part and probability."""
    totals = counts.groupBy(*keys, "__col").agg(*[F.max(F.col("__upto")[k]).alias(f"__t{k}") for k in range(parts)])
    wanted = []
    for k in range(parts):
        n = F.col(f"__t{k}")
        for j, p in enumerate(probs):
            at = (n - 1) * F.lit(float(p))
            for rank in (F.floor(at), F.least(F.floor(at) + 1, n - 1)):
                wanted.append(F.when(n > 0, F.struct(
                    F.lit(k).alias("part"), F.lit(j).alias("prob"), at.alias("at"), rank.cast("bigint").alias("rank"))))
    place = F.struct(F.col("__col").alias("col"), F.lit(0).cast("bigint").alias("prefix"),
                     F.array_compact(F.array(*wanted)).alias("targets"))
    return settle(totals.groupBy(*keys).agg(F.collect_list(place).alias("__places")))
