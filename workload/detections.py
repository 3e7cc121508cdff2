"""Detections to candidates."""

from pyspark.sql import functions as F

from fieldecho.functions.timefn import micros
from fieldecho.operators import concordance as conc
from fieldecho.plans import detections as plan

from . import query
from .base import DET, MERGED, REC, detections_rounded, recordings, table

P = (0.9, 0.75, 0.5)

CONC = """cells AS (
  SELECT common_name, sec_us, recorder_group, recorder, max(prob) AS prob, min(call_us) AS call_us
  FROM detr WHERE recorder_group IS NOT NULL GROUP BY ALL),
conc0 AS (
  SELECT common_name, sec_us, recorder_group, max(prob) AS maxp,
    count(*) FILTER (WHERE prob >= 0.9) AS n_p90, count(*) FILTER (WHERE prob >= 0.75) AS n_p75,
    count(*) FILTER (WHERE prob >= 0.5) AS n_p50 FROM cells GROUP BY ALL),
firsts AS (SELECT common_name, sec_us, min(call_us) AS call_us FROM detr GROUP BY ALL),
conc AS (
  SELECT conc0.*, max(maxp) OVER (PARTITION BY common_name, sec_us) AS allmax, call_us
  FROM conc0 JOIN firsts USING (common_name, sec_us))"""
ACTIVE = """act AS (
  SELECT c.*, (SELECT count(*) FROM merged m WHERE m.recorder_group = c.recorder_group
               AND m.lo <= c.sec_us AND c.sec_us < m.hi) AS n_active FROM conc c)"""
FULL = f"WITH {DET}, {REC}, {MERGED}, {CONC}, {ACTIVE}"
CODE = ("upper(regexp_replace(common_name, '[^A-Za-z0-9]', '', 'g')) || '_' || recorder_group || '_' || "
        "strftime(make_timestamp(sec_us), '%Y%m%d-%H%M%S')")


def counts(spark, d):
    return conc.concordance(detections_rounded(spark, d), P)


def catalog(spark, d):
    return recordings(spark, d).select("recorder", "recorder_group", F.timestamp_micros("lo").alias("start_datetime"),
                                       F.timestamp_micros("hi").alias("end_datetime"))


@query("concordance_counts", f"""WITH {DET}, {CONC}
SELECT common_name, sec_us, recorder_group, n_p90, n_p75, n_p50 FROM conc""")
def concordance_counts(spark, d):
    return counts(spark, d).select("common_name", micros(F.col("call_datetime_r")).alias("sec_us"), "recorder_group",
                                   "n_p90", "n_p75", "n_p50")


@query("concordance_max", f"""WITH {DET}, {CONC}
SELECT common_name, sec_us, recorder_group, maxp, allmax, call_us FROM conc""")
def concordance_max(spark, d):
    return counts(spark, d).select("common_name", micros(F.col("call_datetime_r")).alias("sec_us"), "recorder_group",
                                   "maxp", "allmax", micros(F.col("call_datetime")).alias("call_us"))


@query("concordance_wide", f"""WITH {DET}, {CONC}
SELECT common_name, sec_us, max(prob) FILTER (WHERE recorder = 'R0') AS "R0", max(prob) FILTER (WHERE recorder = 'R1') AS "R1",
  max(prob) FILTER (WHERE recorder = 'R2') AS "R2", max(prob) FILTER (WHERE recorder = 'R3') AS "R3"
FROM cells GROUP BY ALL""")
def concordance_wide(spark, d):
    return (conc.wide(detections_rounded(spark, d), ["R0", "R1", "R2", "R3"])
            .withColumn("sec_us", micros(F.col("call_datetime_r"))).drop("call_datetime_r"))


@query("concordance_dense", f"""WITH {DET}, {CONC}, k AS (
  SELECT DISTINCT common_name, sec_us, g AS recorder_group FROM conc, (VALUES ('G0'), ('G1')) v(g))
SELECT common_name, sec_us, recorder_group, maxp, coalesce(n_p90, 0) AS n_p90, coalesce(n_p75, 0) AS n_p75,
  coalesce(n_p50, 0) AS n_p50 FROM k LEFT JOIN conc USING (common_name, sec_us, recorder_group)""")
def concordance_dense(spark, d):
    return (conc.dense_counts(counts(spark, d), ["G0", "G1"], P)
            .withColumn("sec_us", micros(F.col("call_datetime_r"))).drop("call_datetime_r"))


@query("active_count", f"""{FULL}
SELECT common_name, sec_us, recorder_group, n_active AS n_active_recorders FROM act""")
def active_count(spark, d):
    out = plan.count_active(counts(spark, d), catalog(spark, d))
    return out.select("common_name", micros(F.col("call_datetime_r")).alias("sec_us"), "recorder_group",
                      F.col("n_active_recorders").cast("bigint").alias("n_active_recorders"))


def _selected(spark, d, **kw):
    out = plan.select_candidates(plan.count_active(counts(spark, d), catalog(spark, d)), min_active_recorders=2, **kw)
    return (out.withColumn("sec_us", micros(F.col("call_datetime_r"))).withColumn("call_us", micros(F.col("call_datetime")))
            .withColumn("n_active_recorders", F.col("n_active_recorders").cast("bigint"))
            .drop("call_datetime_r", "call_datetime"))


_OUT = f"""common_name, upper(regexp_replace(common_name, '[^A-Za-z0-9]', '', 'g')) AS birdcode, sec_us, call_us,
  recorder_group, {CODE} AS call_id, maxp, n_p50 AS ngoodrecs, n_p90 AS ngoodrecs_high, n_active AS n_active_recorders,
  concat_ws('|', common_name, coalesce(recorder_group, ''), sec_us) AS event_id"""


@query("select_flexible", f"""{FULL}, pick AS (
  SELECT *, row_number() OVER (PARTITION BY recorder_group, common_name ORDER BY n_p50 DESC, maxp DESC, sec_us) AS rk
  FROM act WHERE n_active >= 2 AND maxp >= 0.8 AND n_p50 >= 1)
SELECT {_OUT} FROM pick WHERE rk <= 40""")
def select_flexible(spark, d):
    return _selected(spark, d, min_max_prob=0.8, min_concordant_recs=1, max_per_species=40)


@query("select_strict", f"""{FULL}
SELECT {_OUT} FROM act WHERE n_active >= 2 AND n_p90 >= greatest(1, round_even(CAST(n_active * 0.25 AS DOUBLE), 0))""")
def select_strict(spark, d):
    return _selected(spark, d, strategy="strict", strict_agreement_fraction=0.25)


@query("candidate_date_range", f"""{FULL}
SELECT {_OUT} FROM act WHERE n_active >= 2 AND maxp >= 0.8 AND n_p50 >= 1
  AND sec_us >= epoch_us(TIMESTAMP '2024-01-01 03:00:00') AND sec_us < epoch_us(TIMESTAMP '2024-01-01 09:00:00')
  AND recorder_group IN ('G1')""")
def candidate_date_range(spark, d):
    return _selected(spark, d, min_max_prob=0.8, min_concordant_recs=1, max_per_species=0, recorder_groups=["G1"],
                     date_start="2024-01-01 03:00:00", date_end="2024-01-01 09:00:00")


@query("duplicate_call_ids", f"""{FULL}
SELECT call_id, count(*) AS n FROM (
  SELECT upper(regexp_replace(common_name, '[^A-Za-z0-9]', '', 'g')) || '_' || recorder_group || '_' ||
    strftime(make_timestamp(sec_us // 3600000000 * 3600000000), '%Y%m%d-%H%M%S') AS call_id FROM conc)
GROUP BY 1 HAVING count(*) > 1""")
def duplicate_call_ids(spark, d):
    from fieldecho.functions import text
    ids = counts(spark, d).select(text.call_id(F.col("common_name"), F.col("recorder_group"),
                                               F.date_trunc("hour", "call_datetime_r")).alias("call_id"))
    return plan.duplicate_call_ids(ids)


@query("filter_detections", f"""WITH {DET}
SELECT event_id, recorder, prob FROM det
WHERE call_us >= epoch_us(TIMESTAMP '2024-01-01 08:00:00') AND call_us < epoch_us(TIMESTAMP '2024-01-02 06:00:00')
  AND event_id % 3 <> 0 AND event_id % 2 = 0 AND recorder_group IN ('G0', 'G1')
  AND CASE WHEN event_id % 4 = 0 THEN 'SOLARBAR' ELSE 'S4A' END IN ('SOLARBAR')""")
def filter_detections(spark, d):
    det = (detections_rounded(spark, d).withColumn("gps_sync", F.col("event_id") % 3 != 0)
           .withColumn("site_species", F.col("event_id") % 2 == 0)
           .withColumn("recorder_type", F.when(F.col("event_id") % 4 == 0, "SOLARBAR").otherwise("S4A")))
    # site-zone days: 02:00 in Chicago is 08:00 UTC, and midnight is 06:00 UTC
    out = plan.filter_detections(det, "America/Chicago", date_start="2024-01-01 02:00:00", date_end="2024-01-02",
                                 recorder_types=["SOLARBAR"], recorder_groups=["G0", "G1"])
    return out.select("event_id", "recorder", "prob")


@query("explode_json_detections", """SELECT event_id, event_type AS common_name, CAST(json_extract(props, '$.k') AS INT) AS class_idx,
  value AS prob FROM events WHERE CAST(json_extract(props, '$.k') AS INT) IS NOT NULL""")
def explode_json_detections(spark, d):
    e = table(spark, d, "events").withColumn("probs", F.filter(F.array(F.struct(
        F.from_json("props", "k int")["k"].alias("class_idx"), F.col("value").alias("prob"))), lambda p: p["class_idx"].isNotNull()))
    win = e.select(F.col("event_id").cast("string").alias("file"), F.col("event_type").alias("abs_start_iso"),
                   F.lit(0.0).alias("win_start"), F.lit(3.0).alias("win_end"), "probs")
    return plan.explode_windows(win).select(F.col("file").cast("bigint").alias("event_id"),
                                            F.col("abs_start_iso").alias("common_name"), "class_idx", "prob")


@query("detections_to_candidates", f"""WITH win AS (
  SELECT event_id, json_extract(props, '$.k')::INT % 25 AS class_idx, value / (value + 20.0::DOUBLE) AS prob,
    event_id % 50 AS f, (event_id // 50) % 40 * 3.0::DOUBLE AS win_start FROM events),
cat AS (SELECT f, f % 10 AS r, 1704067200000000 + (f // 10) * 7000000 AS st FROM range(50) t(f)),
det AS (
  SELECT n_name AS common_name, 'R' || r AS recorder, 'G' || (r % 2) AS recorder_group, prob,
    st + CAST(win_start * 1000000 AS BIGINT) AS call_us, st + CAST(win_start * 1000000 AS BIGINT) AS sec_us
  FROM win JOIN nation ON n_nationkey = class_idx JOIN cat USING (f) WHERE n_regionkey <> 0),
c AS (SELECT common_name, sec_us, recorder_group, recorder, max(prob) AS prob FROM det GROUP BY ALL),
k AS (SELECT common_name, sec_us, recorder_group, max(prob) AS maxp, count(*) FILTER (WHERE prob >= 0.5) AS ngoodrecs,
  count(*) FILTER (WHERE prob >= 0.9) AS ngoodrecs_high FROM c GROUP BY ALL),
a AS (SELECT k.*, (SELECT count(DISTINCT r) FROM cat WHERE 'G' || (r % 2) = recorder_group AND st <= sec_us AND sec_us < st + 125000000) AS n
  FROM k)
SELECT common_name, sec_us, recorder_group, maxp, ngoodrecs, ngoodrecs_high, n AS n_active_recorders
FROM a WHERE n >= 2 AND maxp >= 0.7 AND ngoodrecs >= 2""")
def detections_to_candidates(spark, d):
    """The whole chain on window rows: explode, labels, catalog by file name, filters, concordance, selection."""
    e = table(spark, d, "events")
    win = e.select(
        F.concat(F.lit("/old/place/"), F.col("event_id") % 50, F.lit(".wav")).alias("file"), F.lit("").alias("abs_start_iso"),
        (F.floor(F.col("event_id") / 50) % 40 * 3.0).alias("win_start"), F.lit(0.0).alias("win_end"),
        F.array(F.struct((F.from_json("props", "k int")["k"] % 25).alias("class_idx"),
                         (F.col("value") / (F.col("value") + 20.0)).alias("prob"))).alias("probs"))
    labels = table(spark, d, "nation").select(F.col("n_nationkey").alias("class_idx"), F.col("n_name").alias("common_name"),
                                              (F.col("n_regionkey") != 0).alias("site_species"))
    f = F.col("event_id") % 50
    files = e.select(f.alias("f")).distinct()
    start = 1704067200000000 + F.floor(F.col("f") / 10) * 7000000
    cat = files.select(
        F.concat(F.lit("/new/place/"), "f", F.lit(".wav")).alias("file"), F.concat(F.lit("R"), F.col("f") % 10).alias("recorder"),
        F.lit("SOLARBAR").alias("recorder_type"), F.lit(True).alias("gps_sync"),
        F.concat(F.lit("G"), F.col("f") % 10 % 2).alias("recorder_group"), F.timestamp_micros(start).alias("start_datetime"),
        F.timestamp_micros(start + 125_000_000).alias("end_datetime"))
    out = plan.run(win, labels, cat, "UTC", selection={"min_active_recorders": 2, "min_max_prob": 0.7,
                                                       "min_concordant_recs": 2, "max_per_species": 0})
    return out.select("common_name", micros(F.col("call_datetime_r")).alias("sec_us"), "recorder_group", "maxp",
                      "ngoodrecs", "ngoodrecs_high", F.col("n_active_recorders").cast("bigint").alias("n_active_recorders"))
