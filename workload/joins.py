"""Equi-join idioms and set operations."""

from pyspark.sql import functions as F

from fieldecho.operators import relate
from fieldecho.operators.ranking import seeded_sample

from . import query
from .base import table


@query("label_left_join", """SELECT l_orderkey, l_linenumber, p_partkey AS class_idx, p_name AS common_name, p_brand AS species, p_size > 25 AS site_species
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 17 <> 0""")
def label_left_join(spark, d):
    labels = table(spark, d, "part").where("p_partkey % 17 <> 0").select(
        F.col("p_partkey").alias("class_idx"), F.col("p_name").alias("common_name"), F.col("p_brand").alias("species"),
        (F.col("p_size") > 25).alias("site_species"), F.lit(1).alias("hit"))
    det = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("class_idx"))
    return (relate.attach_labels(det, labels).withColumn("class_idx", F.when(F.col("hit") == 1, F.col("class_idx"))).drop("hit"))


@query("site_flag", """SELECT c_custkey, n_name, n_name IN (SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)) AS site_species
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def site_flag(spark, d):
    from fieldecho.sources.tables import flag_site_species
    nation = table(spark, d, "nation")
    labels = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("common_name"))
    site = nation.where("n_regionkey IN (1, 3)").select(F.col("n_name").alias("common_name"))
    return (table(spark, d, "customer").join(flag_site_species(labels, site), "c_nationkey")
            .select("c_custkey", F.col("common_name").alias("n_name"), "site_species"))


_PG = """pg AS (SELECT page_id, url, regexp_replace(split_part(url, '?', 1), '.*/', '') AS b FROM pages)"""


@query("join_first_by_basename", f"""WITH {_PG}, first AS (SELECT b, min(url) AS u FROM pg WHERE page_id % 2 = 0 GROUP BY 1),
f AS (SELECT b, u, min(page_id) AS p FROM first JOIN pg USING (b) WHERE url = u AND page_id % 2 = 0 GROUP BY ALL)
SELECT page_id, u AS file FROM pg LEFT JOIN f USING (b)""")
def join_first_by_basename(spark, d):
    pages = table(spark, d, "pages")
    clean = F.substring_index("url", "?", 1)
    det = pages.select("page_id", clean.alias("file"))
    cat = pages.where("page_id % 2 = 0").select(clean.alias("file"), F.col("url").alias("u"))
    first = cat.groupBy("file").agg(F.min("u").alias("u"))
    # the smallest full url decides, as the stored path does for a catalog
    cat2 = first.withColumn("name", relate.basename(F.col("file")))
    best = relate.keep_first(cat2, ["name"], [F.col("u")]).select("file", "u")
    return relate.join_by_basename(det, best).select("page_id", F.col("u").alias("file"))


@query("missing_anti", f"""WITH {_PG}
SELECT DISTINCT b AS basename FROM pg WHERE b NOT IN (SELECT b FROM pg WHERE page_id % 3 = 0)""")
def missing_anti(spark, d):
    pages = table(spark, d, "pages").withColumn("file", F.substring_index("url", "?", 1))
    return relate.missing_from_catalog(pages, pages.where("page_id % 3 = 0"))


@query("sidecar_unpivot_join", """WITH k AS (SELECT o_orderkey, o_custkey, 'a' || o_custkey AS wavfile0, 'b' || o_custkey AS wavfile1 FROM orders WHERE o_orderkey % 4 = 0),
m AS (SELECT o_orderkey, wavfile0 AS filename FROM k UNION ALL SELECT o_orderkey, wavfile1 FROM k)
SELECT c_custkey, filename, o_orderkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END || c_custkey AS filename FROM customer)
LEFT JOIN m USING (filename)""")
def sidecar_unpivot_join(spark, d):
    from fieldecho.plans.catalog import unpivot_sidecar
    km = (table(spark, d, "orders").where("o_orderkey % 4 = 0")
          .select("o_orderkey", F.concat(F.lit("a"), "o_custkey").alias("wavfile0"), F.concat(F.lit("b"), "o_custkey").alias("wavfile1")))
    wf = table(spark, d, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b"), "c_custkey").alias("filename"))
    return wf.join(unpivot_sidecar(km), "filename", "left").select("c_custkey", "filename", "o_orderkey")


@query("pair_self_join", """SELECT a.l_orderkey, a.l_suppkey AS l_suppkey_i, b.l_suppkey AS l_suppkey_j
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b
  ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey""")
def pair_self_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return relate.event_pairs(li, "l_orderkey", "l_suppkey")


_PAIR = """s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_suppkey AS i, b.l_suppkey AS j FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
  WHERE (a.l_suppkey + b.l_suppkey) % 5 <> 0)"""


@query("triangle_join", """WITH e AS MATERIALIZED (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS s FROM lineitem GROUP BY 1),
a AS MATERIALIZED (SELECT l_orderkey, s, unnest(range(1, len(s) + 1)) AS m FROM e), b AS MATERIALIZED (SELECT *, unnest(range(m + 1, len(s) + 1)) AS n FROM a),
t AS (SELECT *, unnest(range(n + 1, len(s) + 1)) AS o FROM b)
SELECT l_orderkey, s[m] AS a, s[n] AS b, s[o] AS c FROM t WHERE (s[m] + s[n]) % 5 <> 0 AND (s[n] + s[o]) % 5 <> 0 AND (s[m] + s[o]) % 5 <> 0""")
def triangle_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = (relate.event_pairs(li, "l_orderkey", "l_suppkey").toDF("l_orderkey", "i", "j").where("(i + j) % 5 <> 0"))
    return relate.triangles(pairs, "l_orderkey")


@query("best_pairs", f"""WITH {_PAIR}, q AS (SELECT *, ((i * 7919 + j * 104729) % 1000) / 1000.0::DOUBLE AS qual FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY qual, i, j) AS k FROM q WHERE qual <= 0.6)
SELECT l_orderkey, i, j, qual FROM r WHERE k <= 4""")
def best_pairs(spark, d):
    """Quality cut, then the best few pairs of an event."""
    from fieldecho.plans.localize import usable_pairs
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = (relate.event_pairs(li, "l_orderkey", "l_suppkey").toDF("call_id", "i", "j").where("(i + j) % 5 <> 0")
             .withColumn("qual", ((F.col("i") * 7919 + F.col("j") * 104729) % 1000) / 1000.0))
    return usable_pairs(pairs, qualcut=0.6, max_pairs=4, key="call_id").withColumnRenamed("call_id", "l_orderkey")


@query("anti_resume", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 6)""")
def anti_resume(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "call_id")
    todo = table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"))
    out = relate.pending(todo, li.where("l_returnflag = 'R'"), li.where("l_linenumber = 6"), key="call_id")
    return out.withColumnRenamed("call_id", "o_orderkey")


@query("semi_used_flag", """WITH u AS (SELECT DISTINCT o_orderpriority AS g, l_suppkey AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_tax > 0.07)
SELECT p.g, s_suppkey AS r, u.r IS NOT NULL AS used FROM (SELECT DISTINCT o_orderpriority AS g FROM orders) p CROSS JOIN supplier LEFT JOIN u ON u.g = p.g AND u.r = s_suppkey""")
def semi_used_flag(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").where("l_tax > 0.07")
    ev = (li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_orderkey", F.col("o_orderpriority").alias("g"))
          .agg(F.collect_set("l_suppkey").alias("recs")))
    rec = (table(spark, d, "supplier").select(F.col("s_suppkey").alias("r"))
           .withColumn("g", F.explode(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]))))
    return relate.used_flag(rec, ev, "g", "r", "recs")


@query("recorders_with_coordinates", """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND s_nationkey < 12)""")
def recorders_with_coordinates(spark, d):
    have = table(spark, d, "supplier").where("s_acctbal > 0 AND s_nationkey < 12").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(have, "l_suppkey", "left_semi")


@query("merge_fill", """SELECT p_partkey AS k, p_name AS v FROM part WHERE p_size < 20 UNION ALL
SELECT DISTINCT l_partkey, 'line' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)""")
def merge_fill(spark, d):
    primary = table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v"))
    fallback = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.lit("line").alias("v")).distinct()
    return relate.merge_fill(primary, fallback, "k")


@query("profile_lookup", """SELECT event_id, upper(regexp_replace(event_type, '[^A-Za-z]', '', 'g')) AS birdcode, m, m IS NULL AS use_phat
FROM events LEFT JOIN (SELECT event_type AS t, max(value) AS m FROM events WHERE event_type <> 'view' GROUP BY 1) ON t = event_type""")
def profile_lookup(spark, d):
    from fieldecho.functions.text import profile_code
    from fieldecho.plans.localize import attach_profiles
    e = table(spark, d, "events")
    prof = (e.where("event_type <> 'view'").groupBy(profile_code(F.col("event_type")).alias("birdcode")).agg(F.max("value").alias("m"))
            .select("birdcode", F.array(F.lit(0.0)).alias("freqs"), F.array("m").alias("specmax")))
    ev = e.select("event_id", F.col("event_type").alias("common_name"))
    return attach_profiles(ev, prof).select("event_id", "birdcode", F.col("profile")[0].alias("m"), "use_phat")


@query("paired_rerun", """SELECT a.l_orderkey, a.x AS mean_error_x, b.y AS mean_error_y, round(a.x - b.y, 9) AS diff FROM
 (SELECT l_orderkey, max(l_tax) AS x FROM lineitem WHERE l_quantity > 20 GROUP BY 1) a JOIN
 (SELECT l_orderkey, max(l_discount) AS y FROM lineitem WHERE l_quantity <= 30 GROUP BY 1) b USING (l_orderkey)""")
def paired_rerun(spark, d):
    from fieldecho.plans.analysis import paired_errors
    li = table(spark, d, "lineitem")
    a = li.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.max("l_tax").alias("mean_error"))
    b = li.where("l_quantity <= 30").groupBy(F.col("l_orderkey").alias("call_id")).agg(F.max("l_discount").alias("mean_error"))
    return (paired_errors(a, b).withColumn("diff", F.round("diff", 9)).withColumnRenamed("call_id", "l_orderkey"))


@query("prefix_join", """WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*', ''), '^https?://', '') AS p FROM pages),
dirs AS (SELECT DISTINCT regexp_replace(p, '/[^/]*$', '') AS dir FROM f WHERE page_id % 5 = 0)
SELECT dir, page_id FROM dirs JOIN f ON starts_with(p, dir || '/')""")
def prefix_join(spark, d):
    f = table(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), "^https?://", "").alias("file"))
    dirs = f.where("page_id % 5 = 0").select(F.regexp_replace("file", "/[^/]*$", "").alias("dir"))
    return relate.under_folder(f, dirs).select("dir", "page_id")


@query("majority_group", """WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*', ''), '^https?://', '') AS p, page_id % 3 AS g FROM pages),
dirs AS (SELECT DISTINCT regexp_replace(p, '/[^/]*$', '') AS dir FROM f), c AS (
SELECT dir, g, count(*) AS n FROM dirs JOIN f ON starts_with(p, dir || '/') GROUP BY ALL)
SELECT dir, g AS recorder_group FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, g) AS r FROM c) WHERE r = 1""")
def majority_group(spark, d):
    f = table(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "[?#].*", ""), "^https?://", "").alias("file"),
                                        (F.col("page_id") % 3).alias("recorder_group"))
    return relate.group_by_majority(f, f.select(F.regexp_replace("file", "/[^/]*$", "").alias("dir")))


@query("union_all", """SELECT event_id AS id, event_type AS kind, value FROM events UNION ALL SELECT o_orderkey, o_orderpriority, NULL FROM orders""")
def union_all(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    return (table(spark, d, "customer").select("c_custkey")
            .subtract(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))))


@query("key_union", "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def key_union(spark, d):
    return (table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k"))
            .union(table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("k"))).distinct())


@query("seeded_sample", """WITH h AS (SELECT o_orderkey, o_custkey, ((o_orderkey % 2147483647 + 8) * 48271) % 2147483647 AS a FROM orders)
SELECT o_orderkey, o_custkey FROM h ORDER BY (a * 48271 + 7) % 2147483647, o_orderkey LIMIT 100""")
def seeded_sample_q(spark, d):
    """A sampling operator: the row limit is the feature."""
    return seeded_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, seed=7)
