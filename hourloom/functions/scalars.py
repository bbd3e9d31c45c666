"""Column expressions. Everything here stays inside whole-stage code generation."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing_as_null(c: Column) -> Column:
    """NaN becomes NULL; inside the library NULL is the only missing value."""
    return F.when(~F.isnan(c), c)


def nan_free(df: DataFrame) -> DataFrame:
    """``df`` with NaN turned into NULL in every floating-point column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: missing_as_null(F.col(c)) for c in floating}) if floating else df


def wall_clock(c: Column) -> Column:
    """ISO text or any timestamp as zone-less wall clock; an offset is dropped, not applied."""
    return c.cast("timestamp_ntz")


def floor_hour(ts: Column) -> Column:
    """Wall clock floored to the hour.

    ``date_trunc`` goes through the session zone and can shift an hour at a DST change;
    date plus hour does not.
    """
    day = F.to_date(ts).cast("timestamp_ntz")
    return day + F.make_dt_interval(F.lit(0), F.hour(ts))


def wall_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall clock, independent of the session zone."""
    return (
        F.unix_date(F.to_date(ts)).cast("double") * 86400.0
        + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0
        + F.extract(F.lit("SECOND"), ts).cast("double")
    )


def wall_to_instant(ts: Column) -> Column:
    """Wall clock read as UTC; streams need an instant for their watermark."""
    micros = (
        (F.unix_date(F.to_date(ts)).cast("bigint") * 86400
         + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000
        + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    )
    return F.timestamp_micros(micros)


def instant_to_wall(ts: Column) -> Column:
    """Inverse of :func:`wall_to_instant`."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.unix_micros(ts)
    whole = F.floor(micros / F.lit(86_400_000_000)).cast("int")
    rest = (micros - whole.cast("bigint") * 86_400_000_000).cast("decimal(18,0)") / 1_000_000
    return epoch + F.make_dt_interval(whole, F.lit(0), F.lit(0), rest.cast("decimal(18,6)"))


def clip_lower(c: Column, low: float) -> Column:
    """Values under ``low`` become ``low``; missing stays missing (``greatest`` would not)."""
    return F.when(c < low, F.lit(float(low))).otherwise(c)


def clip_upper(c: Column, high: Column) -> Column:
    """Values over ``high`` become ``high``; a missing value or bound changes nothing."""
    return F.when(c > high, high).otherwise(c)


def calendar_parts(ts: Column) -> dict[str, Column]:
    weekday = F.weekday(ts)
    return {
        "hour": F.hour(ts),
        "dow": weekday,
        "month": F.month(ts),
        "dayofyear": F.dayofyear(ts),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def cyclic(c: Column, period: int) -> tuple[Column, Column]:
    angle = c * F.lit(2.0 * pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclic_calendar(ts: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for name, part, period in (
        ("hour", F.hour(ts), 24), ("month", F.month(ts), 12), ("dow", F.weekday(ts), 7)
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(part, period)
    return out


def wind_vector(speed: Column, degrees: Column) -> tuple[Column, Column]:
    return speed * F.sin(F.radians(degrees)), speed * F.cos(F.radians(degrees))


def temp_squared(temp: Column) -> Column:
    return temp * temp


def temp_humidity(temp: Column, humidity: Column) -> Column:
    return temp * humidity / 100.0


def stagnation(humidity: Column, wind_speed: Column, floor: float = 0.1) -> Column:
    """Humidity over wind speed, the wind never taken below ``floor``."""
    return humidity / clip_lower(wind_speed, floor)


def half_even(c: Column, digits: int) -> Column:
    """Rounding of the published tables: ties go to the even digit."""
    return F.bround(c, digits)
