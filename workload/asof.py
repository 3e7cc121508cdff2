"""As-of joins and weather."""

from pyspark.sql import functions as F

from fieldecho.functions.timefn import HOUR
from fieldecho.operators.asof import asof_join
from fieldecho.plans import weather as plan

from . import query
from .base import HOURLY, hourly, table, us

NEAR = """b AS (SELECT e.*, h.dt_us AS p FROM (SELECT event_id, epoch_us(ts) AS us FROM events) e ASOF LEFT JOIN hourly h ON e.us >= h.dt_us),
nx AS (SELECT b.*, h.dt_us AS q FROM b ASOF LEFT JOIN hourly h ON b.us < h.dt_us),
near AS (SELECT event_id, us, CASE WHEN p IS NULL THEN q WHEN q IS NULL THEN p WHEN us - p <= q - us THEN p ELSE q END AS dt_us FROM nx)"""


def points(spark, d):
    return table(spark, d, "events").select("event_id", us("ts").alias("us"))


@query("asof_backward", f"""WITH {HOURLY}
SELECT e.event_id, h.dt_us, h.temp_c FROM (SELECT event_id, epoch_us(ts) AS us FROM events) e
ASOF LEFT JOIN hourly h ON e.us >= h.dt_us""")
def asof_backward(spark, d):
    return asof_join(points(spark, d), hourly(spark, d).drop("rh"), "us", "dt_us").drop("us")


@query("asof_backward_by_key", """WITH r AS (SELECT user_id, epoch_us(ts) AS t, value FROM events WHERE event_type = 'signup')
SELECT e.event_id, r.t, r.value FROM (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'signup') e
ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.us >= r.t""")
def asof_backward_by_key(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type <> 'signup'").select("event_id", "user_id", us("ts").alias("us"))
    right = e.where("event_type = 'signup'").select("user_id", us("ts").alias("t"), "value")
    return asof_join(left, right, "us", "t", ["user_id"], width=24 * HOUR).drop("user_id", "us")


@query("asof_nearest", f"WITH {HOURLY}, {NEAR} SELECT event_id, dt_us, temp_c FROM near LEFT JOIN hourly USING (dt_us)")
def asof_nearest(spark, d):
    return asof_join(points(spark, d), hourly(spark, d).drop("rh"), "us", "dt_us", direction="nearest").drop("us")


@query("asof_nearest_tolerance", f"""WITH {HOURLY}, {NEAR}
SELECT event_id, h.dt_us, h.temp_c FROM near n LEFT JOIN hourly h ON h.dt_us = n.dt_us AND abs(n.us - n.dt_us) <= 1800000000""")
def asof_nearest_tolerance(spark, d):
    return asof_join(points(spark, d), hourly(spark, d).drop("rh"), "us", "dt_us", direction="nearest",
                     tolerance=1_800_000_000).drop("us")


SPEED = ("sqrt(1.4 * 287.05 * (temp_c + 273.15)) * (1 + 0.165 * (greatest(0.0, least(100.0, rh)) / 100 * "
         "(0.61078 * exp(17.27 * temp_c / (temp_c + 237.3))) / 101.325))")


def weather(spark, d):
    from fieldecho.functions.physics import speed_of_sound
    return (hourly(spark, d).withColumn("dt", F.timestamp_micros("dt_us")).withColumn("speed", speed_of_sound(F.col("temp_c"), F.col("rh")))
            .drop("dt_us"))


@query("attach_speed", f"""WITH {HOURLY}, {NEAR}
SELECT event_id, temp_c, round({SPEED}, 6) AS speed FROM near LEFT JOIN hourly USING (dt_us)""")
def attach_speed(spark, d):
    cand = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("call_datetime"))
    return plan.attach_speed(cand, weather(spark, d)).select("event_id", "temp_c", F.round("speed", 6).alias("speed"))


@query("reattach_speed", f"""WITH {HOURLY}, {NEAR}
SELECT event_id, 343.0::DOUBLE AS speed_old, h.rh, coalesce(h.temp_c, 15.0) AS temp_c, round(coalesce({SPEED}, 343.0), 6) AS speed
FROM near n LEFT JOIN hourly h ON h.dt_us = n.dt_us AND abs(n.us - n.dt_us) <= 1800000000""")
def reattach_speed(spark, d):
    cand = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("call_datetime"),
                                            F.lit(343.0).alias("speed"), F.lit(15.0).alias("temp_c"), F.lit(None).cast("double").alias("rh"))
    return (plan.reattach_speed(cand, weather(spark, d), tolerance=1_800_000_000)
            .select("event_id", "speed_old", "rh", "temp_c", F.round("speed", 6).alias("speed")))


@query("speed_change_report", """WITH e AS (
  SELECT value - 30 AS delta, CASE WHEN hour(ts) >= 21 OR hour(ts) < 6 THEN 'night' ELSE 'day' END AS period FROM events)
SELECT period, count(*) AS n, min(delta) AS "min", max(delta) AS "max", round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd,
  round(median(delta), 6) AS median FROM e GROUP BY 1""")
def speed_change_report(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("call_datetime"), F.col("value").alias("speed"),
                                         F.lit(30.0).alias("speed_old"))
    out = plan.speed_change_report(e, "UTC")
    return out.select("period", "n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "median")])


@query("weather_json", """WITH h AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS temp_c_raw, l_discount * 1000 AS rh,
    epoch_us(l_shipdate) + l_linenumber * 3600000000 AS t FROM lineitem WHERE l_linenumber <> 2),
b AS (SELECT *, temp_c_raw + CASE WHEN hour(make_timestamp(t)) >= 21 OR hour(make_timestamp(t)) < 6 THEN -2.3::DOUBLE ELSE -0.3::DOUBLE END AS temp_c FROM h)
SELECT t AS dt_us, temp_c_raw, round(temp_c, 9) AS temp_c, round(rh, 6) AS rh, round(""" + SPEED + """, 6) AS speed, 'grid' AS source FROM b""")
def weather_json(spark, d):
    """Parallel-array weather replies as JSON text, one per order -> rows with corrected temperature and speed."""
    from fieldecho.schemas import WEATHER_JSON
    li = table(spark, d, "lineitem").select(
        "l_orderkey", F.date_format(F.timestamp_micros(us("l_shipdate") + F.col("l_linenumber") * 3_600_000_000), "yyyy-MM-dd'T'HH:mm").alias("t"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("q"), (F.col("l_discount") * 1000).alias("r"))
    arrays = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("t", "q", "r")).alias("s"))
    js = arrays.select(F.to_json(F.struct(F.struct(
        F.col("s.t").alias("time"), F.col("s.q").alias("temperature_2m"), F.col("s.r").alias("relative_humidity_2m")).alias("hourly"))).alias("j"))
    payload = js.select(F.from_json("j", WEATHER_JSON).alias("p")).select("p.*")
    out = plan.hourly(payload, "UTC", "grid")
    return out.select(us("dt").alias("dt_us"), "temp_c_raw", F.round("temp_c", 9).alias("temp_c"), F.round("rh", 6).alias("rh"),
                      F.round("speed", 6).alias("speed"), "source")
