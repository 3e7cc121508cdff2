"""Stand-ins for the domain tables, derived by Spark from the given tables, with the same text in SQL.

events -> detections and recordings, orders -> deployments, lineitem -> located points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T0 = 1_704_067_200_000_000  # 2024-01-01 00:00 UTC in microseconds


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{d}/{name}.parquet")


def us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def detections(spark: SparkSession, d: str) -> DataFrame:
    """One hour of events becomes one minute, so several recorders hear the same second."""
    e = table(spark, d, "events").withColumn("us", us("ts"))
    rec = F.col("user_id") % 12
    return e.select(
        "event_id", F.col("event_type").alias("common_name"), F.concat(F.lit("R"), rec).alias("recorder"),
        F.when(rec != 11, F.concat(F.lit("G"), rec % 2)).alias("recorder_group"),
        (F.col("value") / (F.col("value") + 20.0)).alias("prob"),
        F.expr(f"{T0}L + ((us - {T0}L) div 3600000000L) * 60000000L + us % 1000000L").alias("call_us"))


DET = f"""det AS (
  SELECT event_id, event_type AS common_name, 'R' || (user_id % 12) AS recorder,
    CASE WHEN user_id % 12 <> 11 THEN 'G' || ((user_id % 12) % 2) END AS recorder_group,
    value / (value + 20.0::DOUBLE) AS prob,
    {T0} + ((epoch_us(ts) - {T0}) // 3600000000) * 60000000 + epoch_us(ts) % 1000000 AS call_us
  FROM events),
detr AS (
  SELECT *, call_us - call_us % 1000000 + CASE
      WHEN call_us % 1000000 > 500000 THEN 1000000
      WHEN call_us % 1000000 = 500000 AND ((call_us // 1000000) % 2) = 1 THEN 1000000 ELSE 0 END AS sec_us
  FROM det)"""


def detections_rounded(spark: SparkSession, d: str) -> DataFrame:
    from fieldecho.functions.timefn import round_to_second
    det = detections(spark, d)
    return (det.withColumn("call_datetime", F.timestamp_micros("call_us"))
            .withColumn("call_datetime_r", F.timestamp_micros(round_to_second(F.col("call_us")))))


def recordings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("us", us("ts"))
    rec = F.col("user_id") % 12
    start = F.expr(f"{T0}L + (us - {T0}L) div 60L")
    return e.select(
        "event_id", F.concat(F.lit("R"), rec).alias("recorder"),
        F.when(rec != 11, F.concat(F.lit("G"), rec % 2)).alias("recorder_group"),
        start.alias("lo"), (start + (3 + F.col("event_id") % 20) * 1_000_000).alias("hi"))


REC = f"""rec AS (
  SELECT event_id, 'R' || (user_id % 12) AS recorder,
    CASE WHEN user_id % 12 <> 11 THEN 'G' || ((user_id % 12) % 2) END AS recorder_group,
    {T0} + (epoch_us(ts) - {T0}) // 60 AS lo,
    {T0} + (epoch_us(ts) - {T0}) // 60 + (3 + event_id % 20) * 1000000 AS hi
  FROM events)"""

MERGED = """reach AS (
  SELECT *, max(hi) OVER (PARTITION BY recorder_group, recorder ORDER BY lo, hi, event_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM rec WHERE recorder_group IS NOT NULL),
isl AS (
  SELECT *, sum(CASE WHEN r IS NULL OR lo > r + 10000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY recorder_group, recorder ORDER BY lo, hi, event_id ROWS UNBOUNDED PRECEDING) AS i FROM reach),
merged AS (
  SELECT recorder_group, recorder, min(lo) AS lo, max(hi) AS hi FROM isl GROUP BY recorder_group, recorder, i)"""


def deployments(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    begin = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(
        k.alias("ord"), F.concat(F.lit("R"), "o_custkey").alias("recorder"),
        F.when(k % 7 != 0, F.concat(F.lit("G"), k % 4)).alias("recorder_group"), begin.alias("begin"),
        F.when(k % 10 != 0, F.timestamp_micros(F.unix_micros(begin) + (k % 90) * F.lit(86_400_000_000))).alias("end"),
        F.when(k % 5 != 0, 30 + (k % 1000) / 100).alias("latitude"),
        F.when(k % 5 != 0, -95 + (k % 700) / 100).alias("longitude"))


DEP = """dep AS (
  SELECT o_orderkey AS ord, 'R' || o_custkey AS recorder,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'G' || (o_orderkey % 4) END AS recorder_group,
    epoch_us(o_orderdate) AS b,
    CASE WHEN o_orderkey % 10 <> 0 THEN epoch_us(o_orderdate) + (o_orderkey % 90) * 86400000000 END AS e,
    CASE WHEN o_orderkey % 5 <> 0 THEN 30 + (o_orderkey % 1000) / 100.0::DOUBLE END AS latitude,
    CASE WHEN o_orderkey % 5 <> 0 THEN -95 + (o_orderkey % 700) / 100.0::DOUBLE END AS longitude
  FROM orders)"""


def located_files(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows: recorder, start, a spatial-join group and noisy coordinates."""
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("R"), "l_partkey").alias("recorder"),
        F.col("l_shipdate").cast("timestamp").alias("start_datetime"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("Z_"), "l_returnflag")).alias("recorder_group"),
        F.when(F.col("l_linenumber") != 3, 30 + F.col("l_quantity") / 100).alias("latitude"),
        F.when(F.col("l_linenumber") != 3, -95 + F.col("l_quantity") / 50).alias("longitude"))


FILES = """files AS (
  SELECT l_orderkey, l_linenumber, 'R' || l_partkey AS recorder, epoch_us(l_shipdate) AS t,
    CASE WHEN l_returnflag <> 'R' THEN 'Z_' || l_returnflag END AS recorder_group,
    CASE WHEN l_linenumber <> 3 THEN 30 + l_quantity / 100 END AS latitude,
    CASE WHEN l_linenumber <> 3 THEN -95 + l_quantity / 50 END AS longitude
  FROM lineitem)"""


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Hourly readings with every fifth hour missing: temp_c, rh."""
    e = table(spark, d, "events").withColumn("us", us("ts"))
    h = F.expr("(us div 3600000000L) * 3600000000L")
    return (e.groupBy(h.alias("dt_us")).agg((F.min("value") / 10).alias("temp_c"), F.least(F.max("value"), F.lit(100.0)).alias("rh"))
            .where(F.expr("(dt_us div 3600000000L) % 5 <> 0")))


HOURLY = """hourly AS (
  SELECT * FROM (SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS dt_us, min(value) / 10 AS temp_c,
    least(max(value), 100.0::DOUBLE) AS rh FROM events GROUP BY 1)
  WHERE (dt_us // 3600000000) % 5 <> 0)"""


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz")
