"""Time columns."""

from pyspark.sql import functions as F

from fieldecho.functions import timefn

from . import ORACLES, query
from .base import DET, detections_rounded, table, us


@query("second_rounding_half_even", f"WITH {DET} SELECT event_id, sec_us FROM detr")
def second_rounding_half_even(spark, d):
    return detections_rounded(spark, d).select("event_id", us("call_datetime_r").alias("sec_us"))


@query("half_second_ties", """SELECT event_id, CAST(round_even((epoch_us(date_trunc('second', ts)) + 500000) / 1000000.0::DOUBLE, 0) AS BIGINT) AS s FROM events""")
def half_second_ties(spark, d):
    """Every value an exact half second: ties go to the even second."""
    e = table(spark, d, "events")
    half = us("ts") - F.pmod(us("ts"), F.lit(1_000_000)) + 500_000
    return e.select("event_id", (timefn.round_to_second(half) / 1_000_000).cast("bigint").alias("s"))


@query("call_times", """SELECT event_id, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS call_us, CAST(ts - INTERVAL 6 HOUR AS DATE) AS date,
  round(hour(ts - INTERVAL 6 HOUR) + minute(ts - INTERVAL 6 HOUR) / 60.0, 9) AS time_in_day FROM events""")
def call_times(spark, d):
    e = table(spark, d, "events")
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Chicago")
    return e.select("event_id", us("__t").alias("call_us") if "__t" in e.columns else timefn.micros(timefn.add_seconds(F.col("ts"), F.col("value"))).alias("call_us"),
                    F.to_date(local).alias("date"), F.round(timefn.time_in_day(local), 9).alias("time_in_day"))


@query("night_filter", "SELECT event_id FROM events WHERE hour(ts) >= 21 OR hour(ts) < 6")
def night_filter(spark, d):
    return table(spark, d, "events").where(timefn.is_night(F.col("ts"))).select("event_id")


@query("seconds_to_grid", """SELECT event_id, CASE WHEN (epoch_us(ts) % 60000000) % 3000000 = 0 THEN 0 ELSE (3000000 - (epoch_us(ts) % 60000000) % 3000000) / 1000000.0 END::DOUBLE AS s FROM events""")
def seconds_to_grid(spark, d):
    return table(spark, d, "events").select("event_id", timefn.seconds_to_grid(F.col("ts")).alias("s"))


@query("fixed_offset_parse", "SELECT event_id, epoch_us(date_trunc('second', ts)) + 18000000000 AS at_us FROM events")
def fixed_offset_parse(spark, d):
    from fieldecho.functions.text import fixed_offset_time
    return table(spark, d, "events").select("event_id", timefn.micros(fixed_offset_time(F.date_format("ts", "yyyyMMdd_HHmmss"))).alias("at_us"))


@query("recording_end", "SELECT event_id, epoch_us(ts) + CAST(round((event_id * 997 + 44100) / 44100.0::DOUBLE * 1000000) AS BIGINT) AS end_us FROM events")
def recording_end(spark, d):
    """End = start + frames / nominal rate."""
    e = table(spark, d, "events")
    dur = (F.col("event_id") * 997 + 44100) / 44100
    return e.select("event_id", timefn.micros(timefn.add_seconds(F.col("ts"), dur)).alias("end_us"))


@query("iso_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM events")
def iso_timestamps(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("iso"))


@query("year_chunks", """WITH r AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1)
SELECT o_custkey, y::INT AS year, greatest(a, make_date(y, 1, 1)) AS chunk_start, least(b, make_date(y, 12, 31)) AS chunk_end FROM r, range(1990, 2010) t(y) WHERE y BETWEEN year(a) AND year(b)""")
def year_chunks(spark, d):
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return timefn.year_chunks(r, "a", "b").select("o_custkey", "year", "chunk_start", "chunk_end")


@query("sun_times", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
a AS (SELECT day, datediff('day', DATE '2000-01-01', day) + 0.0008 - (-93.3 / 360.0) AS j FROM d),
b AS (SELECT *, (357.5291 + 0.98560028 * j) % 360 AS m FROM a),
c AS (SELECT *, (m + 1.9148 * sin(radians(m)) + 0.02 * sin(radians(2 * m)) + 0.0003 * sin(radians(3 * m)) + 282.9372) % 360 AS l FROM b),
e AS (SELECT *, j + 0.0053 * sin(radians(m)) - 0.0069 * sin(radians(2 * l)) AS tr, asin(sin(radians(l)) * sin(radians(23.4397))) AS dec FROM c),
f AS (SELECT *, degrees(acos((sin(radians(-0.833)) - sin(radians(33.7)) * sin(dec)) / (cos(radians(33.7)) * cos(dec)))) / 360 AS h FROM e)
SELECT day, 946728000 + CAST(round((tr - h) * 86400) AS BIGINT) AS rise_s, 946728000 + CAST(round((tr + h) * 86400) AS BIGINT) AS set_s FROM f""")
def sun_times(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    out = days.withColumn("s", timefn.sun_times(F.col("day"), F.lit(33.7), F.lit(-93.3)))
    return out.select("day", F.unix_seconds("s.sunrise").alias("rise_s"), F.unix_seconds("s.sunset").alias("set_s"))


#: The name of the time when ``sun_times`` left out days before 2000; both are the same query now.
query("sun_times_all_days", ORACLES["sun_times"])(sun_times)
