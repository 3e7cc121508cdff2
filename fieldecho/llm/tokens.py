"""Token counts: long texts are encoded in overlapping chunks that are spliced where both encodings provably agree.

A boundary is proven stable where the tokenizer's rules end one word and begin the next whatever stands around it: beside
white space, beside a digit, between a letter and a mark (``SAFE``), and not inside a special string. Neighbouring chunks
share an overlap. They are spliced at the first stable boundary of the overlap that no token of either encoding spans and
from which both give the same tokens up to the next such boundary. Where an overlap holds no such place, that text is
cut anew with chunks and overlaps twice as large, until it is one chunk at worst. Chunks are rows, so one huge text is spread over tasks.

Other texts are counted through their words between blanks and line feeds, both stable boundaries: the library encodes a word when a task meets it
first, and the task remembers its count.

The rules are those of BPE files that drop white space and close words (``word_bpe_49k.json``): runs of letters, single
digits, runs of marks. A null text is empty; an empty table gives no rows; rows that repeat come out as often as they came in.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import stored, text_batches

#: Characters of a chunk, and of the overlap with the next one at first.
CHUNK, OVERLAP = 1 << 15, 256
#: Words whose counts a task remembers at most before it starts afresh.
KNOWN = 1 << 19
#: Chunks that are encoded together.
TOGETHER = 32
#: A stable boundary lies behind the first character of a match: white space on either side, a digit on either side, a letter before a mark.
#: Only characters of long-settled classes count, and none that could join the one before it in normalisation.
SAFE = re.compile(r"[ \n](?=[!-~¡-ɏЀ-ԯぁ-ゖァ-ヺ一-龥])|[!-~¡-ɏЀ-҂、-。ァ-ヺ一-龥](?=[ \n])"
                  r"|[!-~](?=[0-9])|[0-9](?=[!-~])|[A-Za-zà-öぁ-ゖァ-ヺ一-龥](?=[!-/:-@\[-`{-~、。])")
PLACE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("at", "n", "crc")]))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _special(path: str) -> re.Pattern | None:
    own = [re.escape(t.content) for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(own)) if own else None


def stable(text: str, path: str) -> np.ndarray:
    """Stable boundaries of a text, as numbers of characters before them."""
    at = np.array([m.start() + 1 for m in SAFE.finditer(text)], dtype=np.int64)
    special = _special(path)
    for m in special.finditer(text) if special else ():
        at = at[(at <= m.start()) | (at >= m.end())]
    return at


def _places(at: np.ndarray, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
    """(boundary, tokens before it, checksum of the tokens up to the next one) of the boundaries in [lo, hi) that no token spans."""
    at = at[(at >= lo) & (at < hi)]
    n = np.searchsorted(ends, at, side="right")
    free = (n == len(starts)) | (np.append(starts, 0)[n] >= at)
    at, n = at[free], n[free]
    return [(int(p), int(a), zlib.crc32(ids[a:b].tobytes())) for p, a, b in zip(at[:-1], n[:-1], n[1:])]


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, k, first, last, body): the chunks of every text, ``k`` from 0."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                cuts = range(0, max(len(text), 1), chunk)
                for k, at in enumerate(cuts):
                    yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int32()), "last": [at == cuts[-1]],
                                                      "body": [text[at:] if at == cuts[-1] else text[at:at + chunk + overlap]]})

    return texts.select("key", "text").mapInArrow(work, "key string, k int, last boolean, body string").repartition("key", "k")


def _encoded(chunks: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(key, k, last, total, head, tail): the tokens of a chunk and its places in the overlaps with its neighbours, relative to them."""
    fields = T.StructType([T.StructField("key", T.StringType()), T.StructField("k", T.IntegerType()), T.StructField("last", T.BooleanType()),
                           T.StructField("total", T.LongType()), T.StructField("head", PLACE), T.StructField("tail", PLACE)])
    places = pa.list_(pa.struct([(n, pa.int64()) for n in ("at", "n", "crc")]))

    def as_places(rows: list) -> pa.Array:
        return pa.array([[{"at": p, "n": n, "crc": c} for p, n, c in r] for r in rows], places)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER)):
            bodies, total, head, tail = batch.column("body").to_pylist(), [], [], []
            for text, e in zip(bodies, _tokenizer(path).encode_batch(bodies, add_special_tokens=False)):
                ids, spans = np.array(e.ids, dtype="<u4"), np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                at = stable(text, path)
                total.append(len(ids))
                head.append(_places(at, ids, spans[:, 0], spans[:, 1], 1, overlap))
                tail.append([(p - chunk, n, c) for p, n, c in _places(at, ids, spans[:, 0], spans[:, 1], chunk + 1, chunk + overlap)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "k", "last")], pa.array(total, pa.int64()), as_places(head), as_places(tail)], names=fields.names)

    return chunks.mapInArrow(work, fields)


def _spliced(parts: DataFrame) -> DataFrame:
    """(key, n_tokens) of the texts whose chunks are spliced everywhere; ``n_tokens`` is null where an overlap holds no common place."""
    left = parts.filter("NOT last").select("key", (F.col("k") + 1).alias("k"), "tail")
    right = parts.filter("k > 0").select("key", "k", "head")
    both = F.filter("tail", lambda t: F.exists("head", lambda h: (h["at"] == t["at"]) & (h["crc"] == t["crc"])))
    met = left.join(right, ["key", "k"]).select("key", "head", F.get(both, F.lit(0)).alias("p"))
    # the left chunk counts up to the place, the right one from it on
    extra = met.select("key", (F.col("p.n") - F.filter("head", lambda h: h["at"] == F.col("p.at"))[0]["n"]).alias("n"))
    every = extra.unionByName(parts.filter("last").select("key", F.col("total").alias("n")))
    return every.groupBy("key").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n")).alias("n_tokens"))


def long_counts(texts: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of every text (key, text); keys are not null and each stands once."""
    left, done = texts, None
    while True:
        chunk = max(chunk, 2 * overlap)
        found = stored(_spliced(stored(_encoded(_chunks(left, chunk, overlap), path, chunk, overlap), "chunks")), "spliced")
        good = found.filter("n_tokens IS NOT NULL")
        done = good if done is None else done.unionByName(good)
        failed = found.filter("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            return done
        left, chunk, overlap = texts.join(failed, "key", "left_semi"), 2 * chunk, 2 * overlap


def _short_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): words between blanks and line feeds, each encoded by the library once while it is remembered."""
    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            split = [(t or "").replace("\n", " ").split(" ") for t in batch.column("text").to_pylist()]
            new = list({w for words in split for w in words if w not in known})
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list({w for words in split for w in words})
            known.update(zip(new, map(len, _tokenizer(path).encode_batch_fast(new, add_special_tokens=False))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([sum(map(known.__getitem__, w)) for w in split], pa.int64())], names=fields.names)

    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(work, fields)


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row. Texts of more than ``chunk`` characters are spliced, equal ones once."""
    text_batches(docs.sparkSession)
    long_one = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    own = docs.select("doc_id", "text")
    long_docs = own.filter(long_one).withColumn("key", F.sha2("text", 256))
    counts = long_counts(long_docs.select("key", "text").dropDuplicates(["key"]), path, chunk, overlap)
    met = long_docs.join(counts, "key").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")
    return _short_counts(own.filter(~long_one), path).unionByName(met)
