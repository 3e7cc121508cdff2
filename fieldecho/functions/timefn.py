"""Time columns. Instants are handled as whole microseconds (BIGINT) wherever bounds matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def micros(ts: Column) -> Column:
    """Instant -> microseconds. NTZ input is read in the session zone (UTC by default)."""
    return F.unix_micros(ts.cast("timestamp"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(micros(ts) + F.round(seconds.cast("double") * SECOND).cast("bigint"))


def round_to_second(us: Column) -> Column:
    """Half-to-even rounding of microseconds to whole seconds, still in microseconds.

    Integer arithmetic only: the remainder decides, and an exact half goes to the even second.
    """
    rem = F.pmod(us, F.lit(SECOND))
    floor = us - rem
    odd = F.pmod(floor / SECOND, F.lit(2)) == 1
    up = (rem > SECOND // 2) | ((rem == SECOND // 2) & odd)
    return floor + F.when(up, F.lit(SECOND)).otherwise(F.lit(0))


def floor_to(us: Column, width: int) -> Column:
    """Start of the ``width``-microsecond bucket holding ``us``."""
    return us - F.pmod(us, F.lit(width))


def seconds_to_grid(ts: Column, grid: int = 3) -> Column:
    """Seconds from ``ts`` to the next multiple of ``grid`` within its minute."""
    in_minute = F.pmod(micros(ts), F.lit(60 * SECOND))
    rem = F.pmod(in_minute, F.lit(grid * SECOND))
    return F.when(rem == 0, F.lit(0.0)).otherwise((F.lit(grid * SECOND) - rem) / SECOND)


def time_in_day(local: Column) -> Column:
    return F.hour(local) + F.minute(local) / 60


def is_night(local: Column, start_hour: int = 21, end_hour: int = 6) -> Column:
    """Wrap-around night test on a wall-clock column."""
    return (F.hour(local) >= start_hour) | (F.hour(local) < end_hour)


def grid_windows(df: DataFrame, start: str, duration_s: str, grid: int = 3, pad_short: bool = True) -> DataFrame:
    """Explode each recording into whole ``grid``-second windows aligned to the wall clock.

    A tail shorter than the window is dropped. With ``pad_short`` a recording shorter than one
    window gives a single padded window, only when it starts on the grid. A window counts if its
    own end is within the recording; the quotient of the lengths alone may be rounded past it.
    """
    shift, length = seconds_to_grid(F.col(start), grid), F.col(duration_s)
    near = F.floor((length - shift) / grid).cast("int")
    ends = lambda n: shift + (n - 1) * grid + grid <= length
    last = F.when(ends(near + 1), near).when(ends(near), near - 1).otherwise(near - 2)
    if pad_short:
        last = F.greatest(last, F.when((shift == 0) & (length < grid), F.lit(0)).otherwise(F.lit(-1)))
    return (df.withColumn("__shift", shift).withColumn("__last", last)
            .where("__last >= 0")
            .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__last"))))
            .withColumn("win_start", F.col("__shift") + F.col("__i") * grid)
            .withColumn("win_end", F.col("win_start") + grid)
            .drop("__shift", "__last", "__i"))


def year_chunks(df: DataFrame, start: str, end: str) -> DataFrame:
    """Split each [start, end] day range into calendar-year pieces."""
    s, e = F.col(start).cast("date"), F.col(end).cast("date")
    return (df.withColumn("year", F.explode(F.sequence(F.year(s), F.year(e))))
            .withColumn("chunk_start", F.greatest(s, F.make_date("year", F.lit(1), F.lit(1))))
            .withColumn("chunk_end", F.least(e, F.make_date("year", F.lit(12), F.lit(31))))
            .where("chunk_start <= chunk_end"))


def sun_times(day: Column, lat: Column, lon: Column) -> Column:
    """Struct(sunrise, sunset) instants from the published sunrise equation.

    Zenith 90.833 degrees. Null on days the sun stays up or down.
    """
    rad, deg = F.radians, F.degrees
    n = F.datediff(day, F.lit("2000-01-01").cast("date")) + F.lit(0.0008)
    noon = n - lon / 360.0
    m = F.pmod(357.5291 + 0.98560028 * noon, F.lit(360.0))
    c = 1.9148 * F.sin(rad(m)) + 0.02 * F.sin(rad(2 * m)) + 0.0003 * F.sin(rad(3 * m))
    ecl = F.pmod(m + c + 180 + 102.9372, F.lit(360.0))
    transit = noon + 0.0053 * F.sin(rad(m)) - 0.0069 * F.sin(rad(2 * ecl))
    decl = F.asin(F.sin(rad(ecl)) * F.sin(rad(F.lit(23.4397))))
    cos_h = ((F.sin(rad(F.lit(-0.833))) - F.sin(rad(lat)) * F.sin(decl))
             / (F.cos(rad(lat)) * F.cos(decl)))
    half_day = F.when(F.abs(cos_h) <= 1, deg(F.acos(cos_h)) / 360.0)
    # days since 2000-01-01 12:00 UTC -> microseconds
    at = lambda d: F.timestamp_micros((F.lit(946_728_000 * SECOND) + F.round(d * 86400) * SECOND).cast("bigint"))
    return F.struct(at(transit - half_day).alias("sunrise"), at(transit + half_day).alias("sunset"))


def sun_table(spark: SparkSession, lat: float, lon: float, date_start: str, date_end: str) -> DataFrame:
    """Sunrise and sunset for every day in [date_start, date_end); polar days are skipped."""
    days = spark.range(1).select(F.explode(F.sequence(
        F.lit(date_start).cast("date"), F.date_sub(F.lit(date_end).cast("date"), 1))).alias("date"))
    return (days.withColumn("s", sun_times(F.col("date"), F.lit(lat), F.lit(lon)))
            .select("date", "s.sunrise", "s.sunset").where("sunrise IS NOT NULL"))
