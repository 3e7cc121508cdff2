"""Benchmark decontamination: a prefix-filtered set join of documents with item-sized windows.

A benchmark item is cut into windows of ``window`` consecutive words (a shorter item is one
window). A window is a set of positioned word shingles; since a whole window must be found, its
necessary prefix is a single shingle, and the rarest one in the corpus is joined. Position and
length bounds drop anchors whose window would leave the document, and the words around the anchor
are then compared with the window, word by word. A window with a word that no document has is
dropped before the join.

Null texts and texts without words have no words. Items without words match nothing. A null
``item_id`` counts as the empty string. Rows that repeat a document come out as often as they came
in. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, stored

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Up to so many windows, of at most ``window`` words each, are broadcast; beyond it the anchors are joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: Characters of all broadcast windows together.
BROADCAST_CHARS = 64_000_000


def words_of(text: Column) -> Column:
    """ASCII letters lower-cased; runs of a-z, 0-9 and everything beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows (win, w, item_ids) of all items."""
    it = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("ws"))
    it = it.filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    wins = it.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("ws"), i, window))).alias("win"))
    return wins.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("item_ids")).withColumn("w", F.size("win"))


def anchored(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """Give each window its rarest word in the corpus and that word's offset."""
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    seen = (docs.select(F.explode(words_of(F.col("text"))).alias("word"))
            .join(_small(vocabulary, wins), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    spots = wins.select("win", F.posexplode("win").alias("off", "word"))
    rarest = (spots.join(seen, "word", "left").groupBy("win")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off")).alias("a")))
    return (wins.join(rarest, "win").filter("a.n > 0")
            .select(F.col("a.word").alias("anchor"), F.col("a.off").alias("off"), "w", "win", "item_ids"))


def _fits(wins: DataFrame) -> bool:
    n = wins.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.array_join("win", " ")) + F.length(F.array_join("item_ids", " "))).alias("c")).first()
    return n["n"] <= BROADCAST_WINDOWS and (n["c"] or 0) <= BROADCAST_CHARS


def _small(df: DataFrame, wins: DataFrame) -> DataFrame:
    """``df`` (bounded by the words of ``wins``) with a broadcast hint if the windows are within the bounds."""
    return F.broadcast(df) if _fits(wins) else df


def _occurrences(rows: DataFrame, anchors: DataFrame, small: bool) -> DataFrame:
    """Occurrences (key columns, n, start, w, item_ids); ``start`` counts from 1.

    Every row yields one more line with a null ``start``, so that no document is lost. With few
    windows, words are looked up and compared in the scan; otherwise anchors meet words by
    shuffle, and the surviving candidates fetch the document's words by key.
    """
    key = ["doc_id", "digest"]
    start, end = F.col("p") - F.col("off") + 1, F.col("p") - F.col("off") + F.col("w")
    bounds = (F.col("p") >= F.col("off")) & (end <= F.col("n"))
    agrees = F.slice("ws", start, F.col("w")) == F.col("win")
    end_mark = F.lit("")  # no word is empty
    if small:
        none = anchors.sparkSession.range(1).select(end_mark.alias("anchor"), *[F.lit(None).cast(t).alias(c) for c, t in anchors.dtypes[1:]])
        look = F.broadcast(anchors.unionByName(none))
        spots = rows.select("*", F.posexplode(F.concat("ws", F.array(end_mark))).alias("p", "word"))
        hit = F.col("off").isNull() | (bounds & agrees)
        return spots.join(look, (F.col("word") == F.col("anchor")) & hit).select(*key, "n", start.cast("int").alias("start"), "w", "item_ids")
    spots = rows.select(*key, "n", F.posexplode("ws").alias("p", "word"))
    candidates = spots.join(anchors, (F.col("word") == F.col("anchor")) & bounds).select(*key, "p", "off", "w", "win", "item_ids")
    found = (candidates.join(rows.dropDuplicates(key).select(*[F.col(k).alias(f"_{k}") for k in key], "ws", "n"),
                             [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
             .filter(agrees).select(*key, "n", start.cast("int").alias("start"), "w", "item_ids"))
    none = rows.select(*key, "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("w"),
                       F.lit(None).cast("array<string>").alias("item_ids"))
    return found.unionByName(none)


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document: (doc_id, digest of the text, n_words, n_hit, spans, item_ids), with the merged word spans
    (start from 0, end exclusive) that windows cover and the sorted ids of the items with an occurring window."""
    wins = stored(item_windows(items, window), "windows")
    anchors = stored(anchored(docs, wins), "anchors")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"), words_of(F.col("text")).alias("ws"))
    rows = rows.select("doc_id", "digest", "ws", F.size("ws").alias("n"))
    found = _occurrences(rows, anchors, _fits(anchors))
    own = Window.partitionBy("doc_id", "digest").orderBy("start")
    seen = F.coalesce(F.max(F.col("start") + F.col("w")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("opens", F.when(F.col("start") > seen, 1).otherwise(0))
    found = found.withColumn("island", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    islands = found.groupBy("doc_id", "digest", "island").agg(
        F.first("n").alias("n"), (F.min("start") - 1).alias("start"), (F.max(F.col("start") + F.col("w")) - 1).alias("end"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"), F.count(F.when(F.col("start").isNull(), 1)).alias("copies"))
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    per = islands.groupBy("doc_id", "digest").agg(
        F.first("n").cast("long").alias("n_words"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.sum("copies").alias("copies"))
    return (per.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("doc_id", "digest", "n_words", "n_hit", "spans", "item_ids"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Documents that no window of the benchmark occurs in, all columns kept."""
    hit = contamination(docs.select("doc_id", "text"), items, window).filter("n_hit > 0")
    hit = hit.select(F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_digest")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (digest(F.col("text")) == F.col("_hit_digest"))
    return docs.join(hit, same, "left_anti")
