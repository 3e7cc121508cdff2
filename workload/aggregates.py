"""Aggregations and summaries."""

from pyspark.sql import functions as F

from fieldecho.operators import stats
from fieldecho.plans import analysis

from . import query
from .base import table


@query("usage_table", """WITH c AS (SELECT l_returnflag AS recorder_group, 'R' || (l_suppkey % 50) AS recorder, l_shipdate AS s, l_quantity AS dur, l_orderkey FROM lineitem),
u AS (SELECT DISTINCT l_returnflag AS g, 'R' || (l_suppkey % 50) AS r FROM lineitem WHERE l_discount > 0.09 AND l_suppkey % 3 = 0)
SELECT recorder_group, recorder, epoch_us(min(s)) AS first_us, epoch_us(max(s)) AS last_us, count(*) AS n_files, round(sum(dur) / 3600, 6) AS total_hours,
  (recorder_group, recorder) IN (SELECT (g, r) FROM u) AS used_in_primary_run FROM c GROUP BY ALL""")
def usage_table(spark, d):
    li = table(spark, d, "lineitem")
    rec = F.concat(F.lit("R"), F.col("l_suppkey") % 50)
    cat = li.select(F.col("l_returnflag").alias("recorder_group"), rec.alias("recorder"), F.col("l_shipdate").cast("timestamp").alias("start_datetime"),
                    F.col("l_shipdate").cast("timestamp").alias("end_datetime"), F.col("l_quantity").alias("duration"))
    res = (li.where("l_discount > 0.09 AND l_suppkey % 3 = 0")
           .select(F.col("l_returnflag").alias("recorder_group"), F.array(rec).alias("recorders")))
    out = analysis.recorder_usage(cat, res)
    return out.select("recorder_group", "recorder", F.unix_micros("first_recorded").alias("first_us"), F.unix_micros("last_recorded").alias("last_us"),
                      "n_files", F.round("total_hours", 6).alias("total_hours"), "used_in_primary_run")


@query("set_per_group", "SELECT DISTINCT o_orderpriority AS recorder_group, l_suppkey AS recorder FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def set_per_group(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    ev = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_orderkey", F.col("o_orderpriority").alias("recorder_group"))
          .agg(F.collect_set("l_suppkey").alias("recorders")))
    return analysis.used_recorders(ev)


@query("centroids", """WITH last AS (SELECT g, r, arg_max(x, (b, o)) AS x, arg_max(y, (b, o)) AS y FROM (
  SELECT o_orderpriority AS g, o_custkey % 60 AS r, o_orderdate AS b, o_orderkey AS o, -93 + (o_orderkey % 97) / 1000.0 AS x, 33 + (o_orderkey % 89) / 1000.0 AS y FROM orders)
  GROUP BY ALL),
used AS (SELECT DISTINCT o_orderpriority AS g, o_custkey % 60 AS r FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0)
SELECT g AS recorder_group, count(*) AS n, round(avg(x), 6) AS lon, round(avg(y), 6) AS lat FROM last SEMI JOIN used USING (g, r) GROUP BY 1""")
def centroids(spark, d):
    """Mean latest position over the recorders in use, before projection (the projection is checked by itself)."""
    from fieldecho.operators.ranking import keep_last
    o = table(spark, d, "orders").withColumn("recorder", F.col("o_custkey") % 60).withColumnRenamed("o_orderpriority", "recorder_group")
    used = analysis.used_recorders(o.where("o_orderstatus = 'F' AND o_custkey % 2 = 0").select("recorder_group", F.array("recorder").alias("recorders")))
    last = keep_last(o, ["recorder_group", "recorder"], ["o_orderdate", "o_orderkey"])
    return (last.join(used, ["recorder_group", "recorder"], "left_semi").groupBy("recorder_group")
            .agg(F.count("*").alias("n"), F.round(F.avg(-93 + (F.col("o_orderkey") % 97) / 1000), 6).alias("lon"),
                 F.round(F.avg(33 + (F.col("o_orderkey") % 89) / 1000), 6).alias("lat")))


@query("distinct_counts", "SELECT l_shipmode AS k, n FROM (SELECT l_returnflag AS l_shipmode, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)")
def distinct_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.countDistinct("l_orderkey").alias("n"))


@query("delta_report", """SELECT min(l_tax - l_discount) AS "min", max(l_tax - l_discount) AS "max", round(avg(l_tax - l_discount), 9) AS mean,
  round(stddev_samp(l_tax - l_discount), 9) AS sd, count(*) AS n, round(median(l_tax - l_discount), 9) AS median FROM lineitem""")
def delta_report(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_tax") - F.col("l_discount")).alias("delta"))
    out = stats.delta_report(li, "delta")
    return out.select("min", "max", "n", *[F.round(c, 9).alias(c) for c in ("mean", "sd", "median")])


@query("exact_percentiles", """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS med, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90,
  round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def exact_percentiles(spark, d):
    out = stats.exact_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"med": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("med", "p90", "p99")])


_COND = "c AS (SELECT l_returnflag AS g, CASE WHEN l_linenumber = 6 THEN 'inf'::DOUBLE ELSE l_extendedprice / 10 END AS cond FROM lineitem)"


def _scores(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("group"), F.when(
        F.col("l_linenumber") == 6, F.lit(float("inf"))).otherwise(F.col("l_extendedprice") / 10).alias("cond"))


@query("conditional_fraction_p90", f"""WITH {_COND}, f AS (SELECT quantile_cont(cond, 0.5) AS med, quantile_cont(cond, 0.9) AS p90, quantile_cont(cond, 0.99) AS p99 FROM c WHERE cond < 'inf'::DOUBLE)
SELECT (SELECT count(*) FROM c) AS n, (SELECT round(avg((cond < 5000)::INT), 9) FROM c) AS frac_ok, (SELECT count(*) FROM c WHERE cond = 'inf'::DOUBLE) AS n_infinite,
  round(med, 6) AS med, round(p90, 6) AS p90, round(p99, 6) AS p99 FROM f""")
def conditional_fraction_p90(spark, d):
    out = analysis.identifiability_summary(_scores(spark, d), cond_max=5000.0)
    return out.select("n", F.round("frac_ok", 9).alias("frac_ok"), "n_infinite", *[F.round(c, 6).alias(c) for c in ("med", "p90", "p99")])


@query("conditional_fraction_by_group", f"""WITH {_COND}
SELECT g AS "group", count(*) AS n, round(avg((cond < 5000)::INT), 9) AS frac_ok, count(*) FILTER (WHERE cond = 'inf'::DOUBLE) AS n_infinite,
  round(quantile_cont(cond, 0.5), 6) AS med FROM c GROUP BY 1""")
def conditional_fraction_by_group(spark, d):
    out = analysis.identifiability_summary(_scores(spark, d), ["group"], 5000.0)
    return out.select("group", "n", F.round("frac_ok", 9).alias("frac_ok"), "n_infinite", F.round("med", 6).alias("med"))


@query("histogram_bins", """WITH b AS (SELECT l_returnflag, least(floor((l_discount - 0.01) / ((0.09 - 0.01) / 13)), 12)::INT AS bin FROM lineitem WHERE l_discount BETWEEN 0.01 AND 0.09)
SELECT l_returnflag, bin, count(*) AS n, round(0.01 + bin * ((0.09 - 0.01) / 13), 9) AS bin_lo,
  round(count(*) / (sum(count(*)) OVER (PARTITION BY l_returnflag) * ((0.09 - 0.01) / 13)), 6) AS density FROM b GROUP BY 1, 2""")
def histogram_bins(spark, d):
    out = stats.histogram(table(spark, d, "lineitem"), "l_discount", 0.01, 0.09, 13, ["l_returnflag"], density=True)
    return out.select("l_returnflag", "bin", "n", F.round("bin_lo", 9).alias("bin_lo"), F.round("density", 6).alias("density"))


@query("perturb_summary", """WITH s AS (SELECT l_orderkey AS call_id, (l_linenumber % 3) * 5.0 AS p, l_extendedprice / 1000 AS r, l_quantity / 10 AS m, l_tax * 10 AS h FROM lineitem),
ok AS (SELECT DISTINCT call_id FROM s WHERE p = 0 AND m < 2.5)
SELECT p::DOUBLE AS perturb, round(median(r), 6) AS med_resid_ms, round(median(m), 6) AS med_moved_m, round(median(h), 6) AS med_moved_h,
  round(quantile_cont(h, 0.9), 6) AS p90_moved_h, count(DISTINCT call_id) AS n_calls FROM s SEMI JOIN ok USING (call_id) GROUP BY 1""")
def perturb_summary(spark, d):
    s = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("call_id"), (F.col("l_linenumber") % 3 * 5.0).alias("perturb"), (F.col("l_extendedprice") / 1000).alias("resid_ms"),
        (F.col("l_quantity") / 10).alias("moved_m"), (F.col("l_tax") * 10).alias("moved_h"))
    out = analysis.perturbation_summary(s, 2.5)
    return out.select("perturb", "n_calls", *[F.round(c, 6).alias(c) for c in ("med_resid_ms", "med_moved_m", "med_moved_h", "p90_moved_h")])


@query("majority_value", """SELECT o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (
  SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1""")
def majority_value(spark, d):
    return stats.majority(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("min_max_dates", "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1")
def min_max_dates(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"))


@query("species_counts", """SELECT event_type AS common_name, count(*) AS n, round(median(value / 1000), 9) AS median_error FROM events WHERE value / 1000 < 0.05 GROUP BY 1""")
def species_counts(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("common_name"), (F.col("value") / 1000).alias("mean_error"))
    return analysis.species_counts(e, 0.05).withColumn("median_error", F.round("median_error", 9))


@query("rank_versus_top", """WITH r AS (SELECT l_orderkey AS k, max(l_tax) FILTER (WHERE l_linenumber = 1) AS a, max(l_discount) FILTER (WHERE l_linenumber = 2) AS b FROM lineitem GROUP BY 1)
SELECT k, a AS rank0, b AS toppeak, round(a - b, 9) AS diff FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND least(a, b) < 0.05""")
def rank_versus_top(spark, d):
    """Two labelled candidates per event out of an array, at least one of them good."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_linenumber") == 1, F.col("l_tax"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_discount"))).alias("b"))
    cand = F.filter(F.array(F.struct(F.lit("rank_0").alias("candidate_label"), F.col("a").alias("mean_error")),
                            F.struct(F.lit("toppeak_per_pair").alias("candidate_label"), F.col("b").alias("mean_error"))), lambda c: c["mean_error"].isNotNull())
    out = analysis.rank_versus_top(li.select(F.col("l_orderkey").alias("k"), cand.alias("candidates")), 0.05)
    return out.select("k", "rank0", "toppeak", F.round("diff", 9).alias("diff"))


@query("complete_pair_filter", """WITH e AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS top, count(*) FILTER (WHERE l_quantity > 3) AS kept FROM lineitem GROUP BY 1)
SELECT l_orderkey FROM e WHERE n >= 4 AND kept = n""")
def complete_pair_filter(spark, d):
    """Events whose pair list is complete and refers to their own recorders."""
    li = table(spark, d, "lineitem").withColumn("slot", F.struct("l_linenumber", "l_quantity"))
    ev = li.groupBy("l_orderkey").agg(F.collect_list("slot").alias("recorders"), F.count_if(F.col("l_quantity") > 3).alias("kept"))
    n = F.col("kept").cast("int")
    idx = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pairs = F.flatten(F.transform(idx, lambda i: F.transform(F.filter(idx, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return analysis.complete_pairs(ev.withColumn("pairs", pairs)).select("l_orderkey")


@query("clean_subset", "WITH e AS (SELECT l_orderkey, count(*) AS n, max(l_tax) AS s FROM lineitem GROUP BY 1) SELECT l_orderkey FROM e WHERE n = 5 AND s > 0.03")
def clean_subset(spark, d):
    ev = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("pairs"), F.collect_list("l_tax").alias("tdoas"), F.max("l_tax").alias("best_score"))
    return analysis.clean_subset(ev, 5, 0.03).select("l_orderkey")


@query("quality_points", """WITH c AS (SELECT n_regionkey AS g, avg(s_acctbal) AS cx, avg(s_suppkey) AS cy FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey, c_acctbal AS x, (c_custkey % 100)::DOUBLE AS y FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN c ON g = n_regionkey
WHERE c_custkey % 1000 / 1000.0 < 0.9 AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND abs(c_acctbal - cx) < 2000 AND abs(c_custkey % 100 - cy) < 2000""")
def quality_points(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier")
    cen = (s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("recorder_group"))
           .agg(F.avg("s_acctbal").alias("cx"), F.avg("s_suppkey").alias("cy")))
    c = table(spark, d, "customer")
    res = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", F.col("n_regionkey").alias("recorder_group"), F.col("c_mktsegment").alias("common_name"), (F.col("c_custkey") % 1000 / 1000).alias("mean_error"),
        F.array(F.col("c_acctbal"), (F.col("c_custkey") % 100).cast("double")).alias("x_est"))
    out = analysis.high_quality_points(res, cen, 4000.0, 0.9, ["BUILDING", "MACHINERY", "HOUSEHOLD"])
    return out.select("c_custkey", "x", "y")


@query("card_totals", """WITH f AS (SELECT 'c' || (doc_id % 7) AS card, n_chars AS len, doc_id % 3 AS k FROM documents)
SELECT card, count(*) AS n_files, count(*) FILTER (WHERE k = 0) AS n_audio, CAST(sum(len) AS BIGINT) AS bytes FROM f GROUP BY 1""")
def card_totals(spark, d):
    from fieldecho.plans.archive import card_totals as totals
    f = table(spark, d, "documents").select(F.concat(F.lit("c"), F.col("doc_id") % 7).alias("card"), F.col("n_chars").alias("length"),
                                            F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".WAV").otherwise(".txt")).alias("file"))
    return totals(f)


_BIN = lambda v, lo, w, n: f"least(floor(({v} - ({lo})) / ({w})), {n - 1})::INT"


@query("consistency_histograms", f"""WITH r AS (SELECT l_orderkey AS k, max(l_tax) FILTER (WHERE l_linenumber = 1) AS a, max(l_discount) FILTER (WHERE l_linenumber = 2) AS b, max(l_tax) AS m FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey AS k, max(l_discount) / 10 AS x FROM lineitem WHERE l_quantity > 25 GROUP BY 1),
v AS (SELECT 'mean_error' AS panel, {_BIN('m', 0, '0.1::DOUBLE / 99', 99)} AS bin FROM r WHERE m BETWEEN 0 AND 0.1
  UNION ALL SELECT 'rank_vs_top', {_BIN('(a - b)', '-0.1::DOUBLE', '0.2::DOUBLE / 99', 99)} FROM r WHERE a IS NOT NULL AND b IS NOT NULL AND least(a, b) < 0.005 AND a - b BETWEEN -0.1 AND 0.1
  UNION ALL SELECT 'rerun', {_BIN('(x - m / 10)', '-0.01::DOUBLE', '0.02::DOUBLE / 24', 24)} FROM s JOIN r USING (k) WHERE x - m / 10 BETWEEN -0.01 AND 0.01)
SELECT panel, bin, count(*) AS n FROM v GROUP BY 1, 2""")
def consistency_histograms(spark, d):
    """Three histograms in one tidy table: errors, best choice against top peaks, strict re-run against the first."""
    li = table(spark, d, "lineitem")
    r = li.groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.col("l_tax"))).alias("a"),
                                     F.max(F.when(F.col("l_linenumber") == 2, F.col("l_discount"))).alias("b"), F.max("l_tax").alias("m"))
    cand = F.filter(F.array(F.struct(F.lit("rank_0").alias("candidate_label"), F.col("a").alias("mean_error")),
                            F.struct(F.lit("toppeak_per_pair").alias("candidate_label"), F.col("b").alias("mean_error"))), lambda c: c["mean_error"].isNotNull())
    res = r.select(F.col("l_orderkey").alias("call_id"), F.col("m").alias("mean_error"), cand.alias("candidates"))
    rerun = li.where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("call_id")).agg((F.max("l_discount") / 10).alias("mean_error"))
    tenth = res.withColumn("mean_error", F.col("mean_error") / 10)
    first = analysis.consistency_histograms(res).select("panel", "bin", "n")
    last = analysis.consistency_histograms(tenth, rerun).where("panel = 'rerun'").select("panel", "bin", "n")
    return first.unionByName(last)
