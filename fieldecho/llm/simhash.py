"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected groups.

Texts with equal fingerprints are one node, so copies never meet in pairs. A null text is an empty
one; a text without words has fingerprint zero and is linked like any other. A text with fewer
words than a shingle is one shingle. Only ``doc_id`` and ``text`` are read by ``near_duplicates``;
a group's id is its smallest ``doc_id``, null if it has none. Repeated rows come out as often as
they came in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import fingerprint_links
from .common import stored, text_batches
from .components import components

SEED = 42
#: Hashes whose bits are counted at once.
STEP = 1 << 14


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """A hash for every word shingle in order, none for a text without words. A-Z count as a-z."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return []
    joined = b" ".join(ws)
    k = min(words, len(ws))
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts = (ends - [len(w) + 1 for w in ws])[:len(ws) - k + 1].tolist()
    return [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())]


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of word shingles, every occurrence counted once. A-Z count as a-z."""
    hashes = shingle_hashes(text, words)
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), STEP):
        part = np.array(hashes[i:i + STEP], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(words: int):
    """Column function: the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))
    return fp


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    text_batches(docs.sparkSession)
    fps = stored(docs.select("doc_id", fingerprints(words)(F.col("text")).alias("fp")), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(fps, distance)).select(F.col("id").alias("fp"), "root")
    placed = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    member = placed.join(smallest, "root").select("fp", "component_id")
    return fps.join(member, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, distance: int = 3) -> DataFrame:
    """The document with the smallest ``doc_id`` of each group, all columns kept. Of rows that share that id, the first by
    text stays. Documents without an id cannot be told apart; they stay."""
    return first_of_each(docs, near_duplicates(docs.select("doc_id", "text"), words, distance))


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without those that ``groups`` (doc_id, component_id) puts behind another, as ``one_of_each`` says."""
    found = stored(groups, "near-duplicates").filter("doc_id is not null")
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias("_again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_again")
    if repeated.isEmpty():
        return left
    again = F.col("doc_id") == F.col("_again")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    first = left.join(repeated, again, "left_semi").withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
    return left.join(repeated, again, "left_anti").unionByName(first)
