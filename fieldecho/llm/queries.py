"""The queries over the operators of this subpackage, with SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontam, langid, lines, packing, pages, quality, runs, secret_scan, shards, simhash, tokens
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return wrap


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    found = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "votes", "quality")


@query("op2_chat_format", r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id""")
def op2_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    found = chat.conversations(chat.linear(turns.unionByName(probe)))
    said, taught = chat.read_back(F.col("formatted")), chat.learned(F.col("formatted"), F.col("loss"))
    whole = F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(F.col("tree").alias("conv_id"), F.size(said).cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                        F.char_length(taught).cast("long").alias("loss_chars"), F.sha2(taught, 256).alias("loss_sha256"),
                        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kind = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kind) - F.size(F.array_remove(kind, k))).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), counts[3])


@query("op4_page_text")
def op4_page_text(spark, sf_dir):
    found = pages.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.col("path").alias("host_path"))


@query("op5_simhash")
def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_kd_shards")
def op6_kd_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    found = shards.kd_shards(docs, shards=16, by=["doc_id", "lang", "source"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    return lines.deduplicated(table(spark, sf_dir, "documents"), min_words=1).select("doc_id", "n_lines", "n_dropped", "text")


@query("op9_decontamination", r"""
    WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
    iw AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
    ip AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0),
    iwin AS (SELECT DISTINCT item, array_to_string(list_slice(ws, i, i + 9), ' ') AS g, least(len(ws), 10) AS w FROM ip),
    sizes AS (SELECT DISTINCT w FROM iwin),
    dp AS (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM dw, sizes WHERE len(ws) >= w),
    hit AS (SELECT d.doc_id, d.i, d.w, b.item FROM (SELECT doc_id, i, w, array_to_string(list_slice(ws, i, i + w - 1), ' ') AS g FROM dp) d
            JOIN iwin b ON d.g = b.g AND d.w = b.w),
    pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM hit) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
           sha256(coalesce(its.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
    FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id""")
def op9_decontamination(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, "lang", ~test & F.col("doc_id").isNotNull())
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op11_token_alignment")
def op11_token_alignment(spark, sf_dir):
    return alignment.linked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_token_counts")
def op12_token_counts(spark, sf_dir):
    found = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def repeating(text: str, doc_id: int) -> str:
    """The words of a text from a place on replaced by a repeated stretch, both set by the id."""
    ws = text.encode().split()
    n, g = len(ws), zlib.crc32(str(doc_id).encode()) // 10
    if n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws[a:] = [ws[a + (i - a) % p] for i in range(a, n)]
    return b" ".join(ws).decode()


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    @F.pandas_udf("string")
    def planted(texts: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else repeating(t, int(i)) for t, i in zip(texts, ids)], dtype=object)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    docs = docs.withColumn("_planted", planted(F.when(own, F.col("text")), F.coalesce("doc_id", F.lit(0))))
    found = runs.periodic_runs(docs.select("doc_id", F.when(own, F.col("_planted")).otherwise(F.col("text")).alias("text")))
    best = F.reduce("runs", F.lit(None).cast(runs.RUN), lambda m, r: F.when(m.isNull() | (r["length"] > m["length"]), r).otherwise(m))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("_best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in runs.RUN.names],
                        F.floor(F.col("_best.length") * 1000 / F.col("_best.period")).cast("long").alias("exponent_milli"),
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
