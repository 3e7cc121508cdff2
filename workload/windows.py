"""Ranking, de-duplication, and array windows."""

from pyspark.sql import functions as F

from fieldecho.functions import arrays
from fieldecho.functions.timefn import DAY, grid_windows
from fieldecho.operators import ranking, stats
from fieldecho.operators.relate import latest_row
from fieldecho.operators.running import Run, running

from . import query
from .base import REC, recordings, table, us


@query("dedupe_first", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2")
def dedupe_first(spark, d):
    return ranking.keep_first(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], [F.col("doc_id")])


@query("dedupe_last", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def dedupe_last(spark, d):
    return ranking.keep_last(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("latest_deployment", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def latest_deployment(spark, d):
    return latest_row(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("topn_by_prob", """SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r
FROM events WHERE value >= 5) WHERE r <= 20""")
def topn_by_prob(spark, d):
    e = table(spark, d, "events").where("value >= 5").select("event_type", "event_id", "value")
    return ranking.top_n(e, ["event_type"], [F.col("value").desc(), F.col("event_id")], 20)


@query("head_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 250")
def head_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(250)


@query("running_sum", f"""WITH {REC} SELECT event_id, recorder, CAST(sum(hi - lo) OVER (PARTITION BY recorder ORDER BY lo, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total, max(hi) OVER (PARTITION BY recorder ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
FROM rec""")
def running_sum(spark, d):
    out = running(recordings(spark, d), ["recorder"], "lo", DAY // 24, {
        "total": Run("sum", F.col("hi") - F.col("lo")), "reach": Run("max", F.col("hi"), include_current=False)}, ["event_id"])
    return out.select("event_id", "recorder", "total", "reach")


@query("gap_flags", f"""WITH {REC}, r AS (SELECT *, max(hi) OVER (PARTITION BY recorder ORDER BY lo, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM rec)
SELECT event_id, coalesce(lo > m + 10000000, true) AS new_run FROM r""")
def gap_flags(spark, d):
    out = running(recordings(spark, d), ["recorder"], "lo", DAY // 24, {"m": Run("max", F.col("hi"), include_current=False)}, ["event_id"])
    return out.select("event_id", F.coalesce(F.col("lo") > F.col("m") + 10_000_000, F.lit(True)).alias("new_run"))


_CELL = "c AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query("rolling_max", f"""WITH {_CELL}, p AS (SELECT vec_id, k, x FROM c UNION ALL SELECT vec_id, k, 0.0 FROM (SELECT DISTINCT vec_id FROM c), (VALUES (-3),(-2),(-1),(64),(65),(66)) v(k)),
w AS (SELECT vec_id, k, max(x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM p)
SELECT vec_id, CAST(k AS INT) AS k, m FROM w WHERE k BETWEEN 0 AND 63""")
def rolling_max(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", arrays.rolling_max(F.col("embedding"), 3).alias("a"))
    return e.select("vec_id", F.posexplode("a").alias("k", "m"))


@query("rolling_argmax", f"""WITH {_CELL}, p AS (SELECT vec_id, k, x FROM c UNION ALL SELECT vec_id, k, 0.0 FROM (SELECT DISTINCT vec_id FROM c), (VALUES (-2),(-1),(64),(65)) v(k)),
w AS (SELECT vec_id, k, arg_max(k, (x, -k)) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p)
SELECT vec_id, CAST(k AS INT) AS k, CAST(m - k AS INT) AS off FROM w WHERE k BETWEEN 0 AND 63""")
def rolling_argmax(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", arrays.rolling_argmax(F.col("embedding"), 2).alias("a"))
    return e.select("vec_id", F.posexplode("a").alias("k", "off"))


@query("moving_average", f"""WITH {_CELL}, p AS (SELECT vec_id, k, x FROM c UNION ALL SELECT vec_id, k, 0.0 FROM (SELECT DISTINCT vec_id FROM c), (VALUES (-2),(-1),(64),(65)) v(k)),
w AS (SELECT vec_id, k, avg(x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM p)
SELECT vec_id, CAST(k AS INT) AS k, round(m, 9) AS m FROM w WHERE k BETWEEN 0 AND 63""")
def moving_average(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", arrays.moving_average(F.col("embedding"), 5).alias("a"))
    return e.select("vec_id", F.posexplode("a").alias("k", "m")).withColumn("m", F.round("m", 9))


@query("runs_of_ones", f"""WITH {_CELL}, f AS (SELECT vec_id, k, (x > 0.05)::INT AS o FROM c),
g AS (SELECT *, k - row_number() OVER (PARTITION BY vec_id ORDER BY k) AS i FROM f WHERE o = 1)
SELECT vec_id, CAST(min(k) AS INT) AS "start", CAST(max(k) + 1 AS INT) AS "end" FROM g GROUP BY vec_id, i""")
def runs_of_ones(spark, d):
    flags = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.05, 1).otherwise(0))
    return table(spark, d, "embeddings").select("vec_id", F.inline(arrays.runs_of_ones(flags)))


@query("half_energy_index", f"""WITH {_CELL}, r AS (SELECT vec_id, k, sum(x * x) OVER (PARTITION BY vec_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS e,
  sum(x * x) OVER (PARTITION BY vec_id) / 2 AS h FROM c)
SELECT vec_id, CAST(min(k) AS INT) AS k FROM r WHERE e >= h GROUP BY 1""")
def half_energy_index(spark, d):
    return table(spark, d, "embeddings").select("vec_id", arrays.half_energy_index(F.col("embedding")).alias("k"))


@query("grid_windows", """WITH r AS (SELECT event_id, epoch_us(ts) AS us, value AS dur FROM events),
s AS (SELECT *, ((us % 60000000) % 3000000) AS rem FROM r),
t AS (SELECT *, CASE WHEN rem = 0 THEN 0 ELSE (3000000 - rem) / 1000000.0::DOUBLE END AS sh FROM s)
SELECT event_id, round(sh + i * 3, 6) AS win_start, round(sh + i * 3 + 3, 6) AS win_end FROM t, range(200) x(i) WHERE sh + i * 3 + 3 <= dur""")
def grid_windows_q(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("start"), F.col("value").alias("dur"))
    out = grid_windows(e, "start", "dur", pad_short=False)
    return out.select("event_id", F.round("win_start", 6).alias("win_start"), F.round("win_end", 6).alias("win_end"))


@query("median_step", """WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS x FROM events)
SELECT user_id, median(x) AS median_step FROM g WHERE x IS NOT NULL GROUP BY 1""")
def median_step(spark, d):
    e = table(spark, d, "events").select("user_id", us("ts").alias("t"))
    return stats.median_step(e, ["user_id"], "t", 7 * DAY)


@query("custom_order_rank", """SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_totalprice, o_orderkey) AS pos
FROM orders""")
def custom_order_rank(spark, d):
    """Sort all orders by a listed order of groups, then by value; the position shows the order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.positions(ranking.custom_order(o, "o_orderpriority", ["5-LOW", "1-URGENT"], "o_totalprice", "o_orderkey")).select("o_orderkey", "pos")
