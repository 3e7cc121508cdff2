"""Best-fit packing of token sequences by minimum bin slack.

Documents are turned into token ids, closed by an end token and cut into pieces no longer than a
sequence. Which pieces share a sequence depends on their lengths alone, so the plan is made over
the histogram of lengths (never more rows than ``size``): the longest piece left opens a sequence,
a subset-sum over bitsets finds the fullest combination of the other lengths left, and the
combination is repeated as often as the counts allow. Pieces are numbered inside their length
without a gap and look their place up in the plan.

A null text is an empty one and still yields its end token. An empty table gives no rows. Repeated
rows are packed as often as they occur. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import numbered, stored, text_batches

#: Rows that one numbering task sorts, about.
PER_TASK = 100_000
#: Letters, digits and blanks of these code points are the same in every Unicode version.
LATER = re.compile("[^\u0000-\u036f]")
#: Runs of blanks as long as this take ``tokenizers`` too: the faster encoder's pattern backtracks over them.
BLANKS = " " * 1024
#: Fixed value: how byte-level BPE files of this kind split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _encoder(path: str) -> tiktoken.Encoding:
    """A faster encoder with the vocabulary of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str, path: str) -> list[int]:
    """Token ids as ``tokenizers`` gives them without special tokens added. Texts of long-settled characters take the
    faster encoder; the rest, whose character classes depend on the Unicode version, take ``tokenizers`` itself."""
    if LATER.search(text) or BLANKS in text:
        return _tokenizer(path).encode(text, add_special_tokens=False).ids
    return _encoder(path).encode(text, allowed_special="all")


def pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): only documents longer than ``size`` are cut, and then the first
    piece is the one that may be shorter."""
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
              *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                all_ids = np.array([*encode(text or "", path), end], dtype="<u4")
                cuts = [0, *range(len(all_ids) % size or size, len(all_ids), size), len(all_ids)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(all_ids[a:b].tobytes()))
                    if keep_ids:
                        ids.append(all_ids[a:b].astype(np.int32))
            cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    *[pa.array(x, pa.int64()) for x in (start, length, crc)], *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(work, T.StructType(fields))


def fullest(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """The combination (length, times) of available lengths that fills ``room`` best; longer lengths first among equals.

    Bit s of the reach says that the sum s can be made. A length that may be used m times is added in parts of 1, 2, 4, ...
    uses; a trail of reaches leads back from the best sum."""
    reach, trail, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        m, part = min(counts[length], room // length), 1
        while m > 0:
            take = min(part, m)
            grown = (reach | reach << (length * take)) & full
            if grown != reach:
                trail.append((reach, length, take))
                reach = grown
            m, part = m - take, part * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, per sequence, first sequence, offset)."""
    counts, done = {k: n for k, n in histogram.items() if n}, dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        rest = fullest(size - top, {k: n for k, n in counts.items() if n})
        counts[top] += 1
        mix = {top: 1}
        for length, k in rest:
            mix[length] = mix.get(length, 0) + k
        times, offset = min(counts[x] // k for x, k in mix.items()), 0
        for length, k in mix.items():
            rows.append((length, done[length], done[length] + k * times, k, sequence, offset))
            done[length] += k * times
            offset += k * length
            counts[length] -= k * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pieces with their place: ``sequence_id`` and ``offset``, from 0 without a gap."""
    spark = docs.sparkSession
    text_batches(spark)
    cut = stored(pieces(docs, path, size, end, keep_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    fields = ("length", "lo", "hi", "each", "first_sequence", "first_offset")
    places = spark.createDataFrame(plan(histogram, size), ", ".join(f"_{x} long" for x in fields))
    buckets = max(1, -(-max(histogram.values(), default=0) // PER_TASK))
    ranked = numbered(cut, ["length"], ["doc_id", "piece", "ids_crc32"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), "_rank")
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    nth = F.col("_rank") - F.col("_lo")
    placed = ranked.join(F.broadcast(places), here)  # at most a few rows per length of the histogram
    return placed.select(*cut.columns, (F.col("_first_sequence") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
                         (F.col("_first_offset") + nth % F.col("_each") * F.col("length")).alias("offset"))
