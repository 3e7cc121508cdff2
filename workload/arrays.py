"""Array functions over embeddings."""

from pyspark.sql import functions as F

from fieldecho.functions import arrays, physics
from fieldecho.operators import stats

from . import query
from .base import table

CELL = "c AS (SELECT vec_id, label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def emb(spark, d):
    return table(spark, d, "embeddings")


@query("sparse_threshold_pairs", f"WITH {CELL} SELECT vec_id, CAST(k AS INT) AS class_idx, CAST(x AS FLOAT) AS prob FROM c WHERE x >= 0.15")
def sparse_threshold_pairs(spark, d):
    return emb(spark, d).select("vec_id", F.inline(arrays.sparse_pairs(F.col("embedding"), 0.15)))


@query("l2_norm", f"WITH {CELL} SELECT vec_id, CAST(k AS INT) AS k, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS v FROM c")
def l2_norm(spark, d):
    v = emb(spark, d).select("vec_id", F.posexplode(arrays.l2_normalize(F.col("embedding"))).alias("k", "v"))
    return v.withColumn("v", F.round("v", 6))


@query("peak_normalize", f"WITH {CELL} SELECT vec_id, CAST(k AS INT) AS k, round(x * (0.99 / max(abs(x)) OVER (PARTITION BY vec_id)), 6) AS v FROM c")
def peak_normalize(spark, d):
    v = emb(spark, d).select("vec_id", F.posexplode(arrays.peak_scale(F.col("embedding"), 0.99)).alias("k", "v"))
    return v.withColumn("v", F.round("v", 6))


@query("percentile_normalize", f"""WITH {CELL}, p AS (SELECT vec_id, quantile_cont(abs(x), 0.9) AS m FROM c GROUP BY 1)
SELECT vec_id, CAST(k AS INT) AS k, round(x * (0.99 / m), 6) AS v FROM c JOIN p USING (vec_id)""")
def percentile_normalize(spark, d):
    v = emb(spark, d).select("vec_id", F.posexplode(arrays.percentile_scale(F.col("embedding"), 90.0)).alias("k", "v"))
    return v.withColumn("v", F.round("v", 6))


@query("array_argmax", f"WITH {CELL} SELECT vec_id, CAST(arg_max(k, (x, -k)) AS INT) AS lag FROM c GROUP BY 1")
def array_argmax(spark, d):
    return emb(spark, d).select("vec_id", arrays.argmax(F.col("embedding")).alias("lag"))


@query("array_median_p90", f"WITH {CELL} SELECT label, CAST(k AS INT) AS k, count(*) AS n, round(median(x), 9) AS med, round(quantile_cont(x, 0.9), 9) AS p90 FROM c GROUP BY 1, 2")
def array_median_p90(spark, d):
    out = stats.array_percentiles(emb(spark, d), ["label"], "embedding", {"med": 0.5, "p90": 0.9})
    z = F.arrays_zip("med", "p90")
    return (out.select("label", "n", F.posexplode(z).alias("k", "z"))
            .select("label", "k", "n", F.round("z.med", 9).alias("med"), F.round("z.p90", 9).alias("p90")))


@query("mean_abs_error", f"WITH {CELL} SELECT vec_id, round(avg(abs(x)), 9) AS mean_error FROM c GROUP BY 1")
def mean_abs_error(spark, d):
    return emb(spark, d).select("vec_id", F.round(arrays.mean_abs(F.transform("embedding", lambda x: x.cast("double"))), 9).alias("mean_error"))


@query("non_empty_arrays", f"WITH {CELL} SELECT vec_id, count(*)::INT AS n FROM c WHERE x > 0.3 GROUP BY 1")
def non_empty_arrays(spark, d):
    out = emb(spark, d).withColumn("p", arrays.sparse_pairs(F.col("embedding").cast("array<double>"), 0.3)).where(F.size("p") > 0)
    return out.select("vec_id", F.size("p").alias("n"))


@query("pair_error_sums", """WITH p AS (SELECT l_orderkey, l_linenumber - 1 AS i, l_tax AS e FROM lineitem), m AS (SELECT max(l_linenumber) + 1 AS n FROM lineitem)
SELECT l_orderkey, CAST(k AS INT) AS k, round(sum(CASE WHEN i = k THEN e WHEN (i + 1) % n = k THEN -e ELSE 0 END), 9) AS err FROM p, m, range(100) t(k) WHERE k < n GROUP BY 1, 2""")
def pair_error_sums(spark, d):
    """Signed error per recorder: pairs (i, i+1), as many recorders as the longest order needs."""
    li = table(spark, d, "lineitem")
    n = li.agg(F.max("l_linenumber")).first()[0] + 1
    s = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_tax").alias("e"))).alias("s"))
    pairs = F.transform("s", lambda x: F.struct((x["n"] - 1).alias("i"), (x["n"] % n).alias("j")))
    recs = F.array(*[F.lit(f"r{k}") for k in range(n)])
    out = s.select("l_orderkey", F.posexplode(arrays.signed_pair_error(recs, pairs, F.transform("s", lambda x: x["e"]))).alias("k", "err"))
    return out.withColumn("err", F.round("err", 9))


@query("local_pair_indexes", """WITH n AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1 AS pos,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey DESC) - 1 AS rev FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2))
SELECT l_orderkey, CAST(a.pos AS INT) AS i, CAST(b.pos AS INT) AS j FROM n a JOIN n b USING (l_orderkey) WHERE b.pos = a.pos + 1""")
def local_pair_indexes(spark, d):
    """Neighbouring recorder ids of an event written as positions in its list."""
    ev = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("r")).where(F.size("r") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda k: F.struct(F.get("r", k - 1).alias("i"), F.get("r", k).alias("j")))
    return ev.select("l_orderkey", F.inline(arrays.local_pairs(F.col("r"), pairs)))


@query("error_map", """SELECT l_orderkey, 'r' || l_linenumber || '|s' || l_suppkey AS k, max(l_tax) AS v FROM lineitem GROUP BY 1, 2""")
def error_map(spark, d):
    from fieldecho.plans.localize import error_map as build
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.max("l_tax").alias("l_tax"))
    ev = li.groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.concat(F.lit("r"), "l_linenumber").alias("ri"), F.concat(F.lit("s"), "l_suppkey").alias("rj"), "l_tax")).alias("s"))
    return ev.select("l_orderkey", F.explode(build(F.col("s"), F.transform("s", lambda x: x["l_tax"]))).alias("k", "v"))


@query("logistic", "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 9) AS p FROM embeddings")
def logistic(spark, d):
    return emb(spark, d).select("vec_id", F.round(physics.logistic(F.col("embedding")[0].cast("double")), 9).alias("p"))
