"""Names, paths and identifiers."""

from pyspark.sql import functions as F

from fieldecho.functions import text

from . import query
from .base import table, us

_STAMP = "strftime(ts, '%Y%m%dT%H%M%S.%f') || '+0000'"
_NAMES = f"""n AS (SELECT event_id, ts, value, CASE event_id % 8
  WHEN 0 THEN '/a/BARLT_' || lpad((event_id % 99)::VARCHAR, 8, '0') || '/S' || {_STAMP} || '_E' || {_STAMP} || '_+33.5-93.25.wav'
  WHEN 1 THEN '/a/BARLT_00000001/x/S' || {_STAMP} || '_E' || {_STAMP} || '_+33.5-93.25_00000_000.flac'
  WHEN 2 THEN '/a/BARLT_00000001/BARLT_00000002/' || strftime(ts, '%Y%m%dT%H%M%S') || '+0000_REC_+1.5-2.5.wav'
  WHEN 3 THEN '/a/BARLT_00000003/' || strftime(ts, '%Y%m%dT%H%M%S') || '+0000_REC.wav'
  WHEN 4 THEN '/a/S4A20001_1_' || strftime(ts, '%Y%m%d_%H%M%S') || '_000.wav'
  WHEN 5 THEN '/a/S4A20002_' || strftime(ts, '%Y%m%d') || '$' || strftime(ts, '%H%M%S') || '.w4v'
  WHEN 6 THEN '/a/S4A20003_' || strftime(ts, '%Y%m%d_%H%M%S') || '.wav'
  ELSE '/a/junk.WAV' END AS p FROM events)"""


def named(spark, d):
    e = table(spark, d, "events")
    full = F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss.SSSSSS"), F.lit("+0000"))
    short = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    k = F.col("event_id") % 8
    name = (F.when(k == 0, F.concat(F.lit("/a/BARLT_"), F.lpad((F.col("event_id") % 99).cast("string"), 8, "0"), F.lit("/S"), full, F.lit("_E"), full, F.lit("_+33.5-93.25.wav")))
            .when(k == 1, F.concat(F.lit("/a/BARLT_00000001/x/S"), full, F.lit("_E"), full, F.lit("_+33.5-93.25_00000_000.flac")))
            .when(k == 2, F.concat(F.lit("/a/BARLT_00000001/BARLT_00000002/"), short, F.lit("+0000_REC_+1.5-2.5.wav")))
            .when(k == 3, F.concat(F.lit("/a/BARLT_00000003/"), short, F.lit("+0000_REC.wav")))
            .when(k == 4, F.concat(F.lit("/a/S4A20001_1_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_000.wav")))
            .when(k == 5, F.concat(F.lit("/a/S4A20002_"), F.date_format("ts", "yyyyMMdd"), F.lit("$"), F.date_format("ts", "HHmmss"), F.lit(".w4v")))
            .when(k == 6, F.concat(F.lit("/a/S4A20003_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".wav"))).otherwise("/a/junk.WAV"))
    return e.select("event_id", name.alias("p"))


@query("filename_parse", f"""WITH {_NAMES}
SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'BARLT_' || lpad((event_id % 99)::VARCHAR, 8, '0') WHEN event_id % 8 = 1 THEN 'BARLT_00000001' WHEN event_id % 8 = 3 THEN 'BARLT_00000003'
    WHEN event_id % 8 = 2 THEN NULL WHEN event_id % 8 = 7 THEN '' ELSE 'S4A2000' || (event_id % 8 - 3) END AS recorder,
  CASE WHEN event_id % 8 < 4 THEN 'SOLARBAR' WHEN event_id % 8 < 7 THEN 'S4A' ELSE '' END AS recorder_type,
  CASE WHEN event_id % 8 = 4 THEN '1' END AS channel, event_id % 8 IN (0, 1, 5, 6) AS gps_sync,
  CASE WHEN event_id % 8 < 2 THEN epoch_us(ts) WHEN event_id % 8 < 4 THEN epoch_us(date_trunc('second', ts)) WHEN event_id % 8 < 7 THEN epoch_us(date_trunc('second', ts)) + 18000000000 END AS start_us,
  CASE WHEN event_id % 8 < 2 THEN epoch_us(ts) END AS end_us,
  CASE WHEN event_id % 8 < 2 THEN 33.5 WHEN event_id % 8 = 2 THEN 1.5 END::DOUBLE AS latitude, CASE WHEN event_id % 8 < 2 THEN -93.25 WHEN event_id % 8 = 2 THEN -2.5 END::DOUBLE AS longitude,
  regexp_replace(p, '.*/', '') AS filename FROM n""")
def filename_parse(spark, d):
    df = named(spark, d).withColumn("f", text.parse_filename(F.col("p")))
    return df.select("event_id", "f.recorder", "f.recorder_type", "f.channel", "f.gps_sync", us("f.start_datetime").alias("start_us"),
                     us("f.end_datetime").alias("end_us"), "f.latitude", "f.longitude", "f.filename")


@query("recorder_from_path", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'BARLT_' || lpad(c_custkey::VARCHAR, 8, '0') END AS recorder FROM customer""")
def recorder_from_path(spark, d):
    a = F.concat(F.lit("BARLT_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    p = (F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/x/"), a, F.lit("/"), a)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("/x/"), a, F.lit("/BARLT_99999999")))
         .otherwise("/x/none"))
    return table(spark, d, "customer").select("c_custkey", text.recorder_from_path(p).alias("recorder"))


@query("extension_tests", r"""SELECT page_id, lower(url) LIKE '%.wav' AS w, regexp_matches(lower(url), '\.(html?|php)$') AS h FROM (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '.WAV' WHEN page_id % 3 = 1 THEN '.Html' ELSE '' END AS url FROM pages)""")
def extension_tests(spark, d):
    u = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".WAV").when(F.col("page_id") % 3 == 1, ".Html").otherwise(""))
    return table(spark, d, "pages").select("page_id", text.is_wave(u).alias("w"), text.has_extension(u, "html?", "php").alias("h"))


@query("birdcode", "SELECT p_partkey, upper(regexp_replace(p_name || p_brand, '[^A-Za-z0-9]', '', 'g')) AS a, upper(regexp_replace(p_name || p_brand, '[^A-Za-z]', '', 'g')) AS b FROM part")
def birdcode(spark, d):
    n = F.concat("p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", text.birdcode(n).alias("a"), text.profile_code(n).alias("b"))


@query("call_id", """SELECT event_id, upper(event_type) || '_G' || (user_id % 3) || '_' || strftime(ts - INTERVAL 6 HOUR, '%Y%m%d-%H%M%S') AS call_id FROM events""")
def call_id(spark, d):
    """January: the site zone is six hours behind UTC."""
    e = table(spark, d, "events")
    g = F.concat(F.lit("G"), F.col("user_id") % 3)
    return e.select("event_id", text.call_id(F.col("event_type"), g, F.col("ts").cast("timestamp"), "America/Chicago").alias("call_id"))


@query("sanitize", r"""WITH s AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 9 = 1 THEN '  ' ELSE ' ' || url || '  (' || page_id || ') ' END AS u FROM pages)
SELECT page_id, CASE WHEN u IS NULL THEN '' WHEN trim(u) = '' THEN 'item' ELSE regexp_replace(replace(trim(u), ' ', '_'), '[^A-Za-z0-9._-]+', '_', 'g') END AS s FROM s""")
def sanitize(spark, d):
    k = F.col("page_id") % 9
    u = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit("  ("), "page_id", F.lit(") ")))
    return table(spark, d, "pages").select("page_id", text.sanitize(u).alias("s"))


@query("path_parts", "SELECT page_id, regexp_replace(url, '.*/', '') AS base, regexp_replace(url, '/[^/]*$', '') AS dir, regexp_replace(url, '/[^/]*$', '') || '/' || page_id AS rebuilt FROM pages")
def path_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.basename(u).alias("base"), text.dirname(u).alias("dir"),
                                           text.join_path(text.dirname(u), F.col("page_id").cast("string")).alias("rebuilt"))


@query("split_label", """SELECT p_partkey, split_part(s, '_', 1) AS species, CASE WHEN contains(s, '_') THEN s[strpos(s, '_') + 1:] END AS common_name
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || '_' || p_brand || '_' || p_type END AS s FROM part)""")
def split_label(spark, d):
    s = F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")).otherwise(F.concat_ws("_", "p_name", "p_brand", "p_type"))
    return table(spark, d, "part").withColumn("l", text.split_label(s)).select("p_partkey", "l.species", "l.common_name")


_DIRS = """n AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN '2023' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '15'
  WHEN 2 THEN 'BARLT_' || lpad(o_orderkey::VARCHAR, 8, '0') WHEN 3 THEN 'S4A' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') || 'x' WHEN 4 THEN 'LI5ZA' || (o_orderkey % 10) || '_2'
  WHEN 5 THEN 'Back' || (o_orderkey % 10) ELSE 'BARLT_00000001_20240101_20240131_2' END AS s FROM orders)"""


def dir_names(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    s = (F.when(k % 7 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k % 7 == 1, F.concat(F.lit("2023"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("15")))
         .when(k % 7 == 2, F.concat(F.lit("BARLT_"), F.lpad(k.cast("string"), 8, "0"))).when(k % 7 == 3, F.concat(F.lit("S4A"), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("x")))
         .when(k % 7 == 4, F.concat(F.lit("LI5ZA"), k % 10, F.lit("_2"))).when(k % 7 == 5, F.concat(F.lit("Back"), k % 10)).otherwise("BARLT_00000001_20240101_20240131_2"))
    return o.select("o_orderkey", s.alias("s"))


@query("directory_classes", f"""WITH {_DIRS} SELECT o_orderkey, o_orderkey % 7 IN (2, 3) AS recorder, (o_orderkey % 7 = 0 OR (o_orderkey % 7 = 1 AND o_orderkey % 100 BETWEEN 1 AND 12)) AS collection,
  o_orderkey % 7 IN (2, 4) AS card, o_orderkey % 7 = 6 AS canonical FROM n""")
def directory_classes(spark, d):
    s = F.col("s")
    return dir_names(spark, d).select("o_orderkey", text.is_recorder_dir(s).alias("recorder"), text.is_collection_date(s).alias("collection"),
                                      text.looks_like_card_id(s).alias("card"), text.is_canonical_dir(s).alias("canonical"))


@query("canonical_name", """SELECT o_custkey, 'R' || o_custkey || '_' || strftime(min(o_orderdate), '%Y%m%d') || '_' || CASE WHEN count(*) > 1 THEN strftime(max(o_orderdate), '%Y%m%d') ELSE 'UNKNOWN' END AS s
FROM orders GROUP BY 1""")
def canonical_name(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("n"))
    s = text.canonical_dir(F.concat(F.lit("R"), "o_custkey"), F.col("a"), F.when(F.col("n") > 1, F.col("b")))
    return g.select("o_custkey", s.alias("s"))


@query("clip_species", r"""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS species FROM part""")
def clip_species(spark, d):
    p = F.concat(F.lit("/lib/"), "p_name", F.when(F.col("p_partkey") % 4 != 0, F.lit(" 07 ")).otherwise("-"), F.lit("song.mp3"))
    return table(spark, d, "part").select("p_partkey", text.species_from_clip_name(p).alias("species"))


@query("deepest_first_rank", """SELECT page_id, row_number() OVER (ORDER BY len(string_split(url, '/')) DESC, url, page_id) AS pos FROM pages""")
def deepest_first_rank(spark, d):
    from fieldecho.operators.ranking import deepest_first, positions
    return positions(deepest_first(table(spark, d, "pages").select("page_id", "url"), "url", "page_id")).select("page_id", "pos")
