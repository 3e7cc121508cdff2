"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

A line is what stands between two ``\\n``. It is normalised by lower-casing and by turning white
space (ASCII) into single spaces. Lines of fewer than ``min_words`` words are left alone; with
``min_words=1`` only blank lines are. Equal normalised lines are one line; different ones are linked if they are compared and
their edit similarity, one minus the edit distance over the longer length in characters, is ``similarity`` or more. Compared are
lines

* whose SimHashes of words (those of ``TELLING`` bytes or more, if there are ``ENOUGH``) differ in at most three bits: they share pigeonhole blocks;
* that share one of the parts which the text itself marks (``near``), as lines of some length do after some edits;
* of up to ``SHORT`` characters that are one edit apart: they share what is left without one character.

Of each connected group the first occurrence by (doc_id, text hash, line number) stays and every other one goes.

A null text has no lines and stays null. Rows that repeat both id and text are one document and
come out alike. A document that loses all its lines stays, with an empty text. An empty table gives no rows. Other columns pass
through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import edits, near
from .bits import majority, spread
from .common import stored, text_batches
from .components import components

#: Bytes of text whose words are hashed at once, about, and documents taken from a batch at once.
STEP, ROWS = 1 << 18, 256
#: A word's hash is a polynomial in this odd number over its bytes, modulo 2 ** 64, and then mixed.
BASE = 0x9E3779B97F4A7C15
#: Bytes that a part of a line has at least, and characters of lines that are also compared with those one edit away.
LEAST, SHORT = 10, 25
#: Bytes of the words that a fingerprint is made of, and how many of them a line must have; all words count in other lines.
TELLING, ENOUGH = 5, 4
#: Characters up to which the edits of many pairs are counted together, and from which those of one pair are counted in a band.
LONG = 4096
#: Words that are looked at beyond a difference.
AHEAD = 8
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _bytes(line: str) -> bytes:
    return line.lower().encode("utf-8", "surrogatepass")


def normalised(line: str) -> str:
    """Lower case, runs of ASCII white space as one blank, none at the ends."""
    return b" ".join(_bytes(line).split()).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` from 0 to n, and of its inverse modulo 2 ** 64."""
    def row(base: int) -> np.ndarray:
        return np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64)), dtype=np.uint64)
    return row(BASE), row(pow(BASE, -1, 2**64))


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all lines, in order, where they begin and end, and where lines begin (with an end mark).

    A word's hash comes from differences of running sums, so words cost no Python objects."""
    data = np.frombuffer(raw, dtype=np.uint8)
    up, down = _powers(1 << max(18, len(raw).bit_length()))
    running = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64))
    word = np.concatenate(([False], ~BLANK[data], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    h = (running[end] - running[start]) * down[start]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    h ^= h >> np.uint64(33)
    lines = np.concatenate(([0], np.flatnonzero(data == 10) + 1, [len(data) + 1]))
    return h, start, end, lines


def line_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all lines, in order, how many words each line has, and where lines begin (with an end mark)."""
    h, start, _, lines = _words(raw)
    return h, np.diff(np.searchsorted(start, lines)), lines


def fingerprints(h: np.ndarray, size: np.ndarray, line: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each line over its telling words, and how many those are; ``line`` says whose a word is. 0 for a line without words."""
    telling = size >= TELLING
    few = np.bincount(line[telling], minlength=lines) < ENOUGH
    kept = telling | few[line]
    votes = np.bincount(line[kept], minlength=lines)
    fp, some = np.zeros(lines, dtype=np.uint64), np.flatnonzero(votes)
    if len(some):
        fp[some] = majority(spread(h[kept]), (np.cumsum(votes) - votes)[some])
    return fp, votes


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def edits_within(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or any number above ``most`` if it is above. A whole column of the table is held in the bits of a few
    integers; of long lines only the diagonals that ``most`` edits can reach."""
    cut = _shared(a, b)
    a, b = a[cut:], b[cut:]
    cut = _shared(a[::-1], b[::-1])
    a, b = a[:len(a) - cut], b[:len(b) - cut]
    if len(a) > len(b):
        a, b = b, a
    if not a or not most or len(b) - len(a) > most:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    if len(a) > LONG and 2 * most < len(a):
        k = 64
        while k < most and (found := _in_band(where, len(a), b, k)) > k:
            k *= 4
        return found if k < most else _in_band(where, len(a), b, most)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, most = full, 0, len(a), most + len(b)
    for c in b:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        score += bool(rise & top) - bool(fall & top)
        most -= 1
        if score > most:  # every column left lowers the score by one at best
            return score
        rise = (rise << 1 | 1) & full
        up, down = (fall << 1 | ~(diagonal | rise)) & full, rise & diagonal
    return score


def _in_band(where: dict[str, int], m: int, b: str, k: int) -> int:
    """Edit distance of a (``m`` characters, at the bits ``where``) and b if it is ``k`` at most, else more than k; k is below m. Column j keeps rows
    j - k to j + k, the lowest in the top bit, so the window moves down by one row with each column."""
    width = 2 * k + 1
    full = (1 << width) - 1
    up, down, score = full ^ ((1 << k) - 1), 0, k
    top, side = 1 << (width - 1), 1 << (width - 2)
    for j, c in enumerate(b):
        match = where.get(c, 0)
        match = (match >> (j - k) if j >= k else match << (k - j)) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        rise, fall = (down | ~(diagonal | up)) & full, up & diagonal
        if j < m - k:
            score += not diagonal & top
        else:  # the last row is in the window and moves up
            score += bool(rise & side) - bool(fall & side)
            side >>= 1
        if score > 2 * k + len(b) - m:  # the last row lowers it by what is left of b at best
            return score
        diagonal >>= 1
        up, down = (fall | ~(diagonal | rise)) & full, diagonal & rise
    return score


def replaced(a: list[str], b: list[str], most: int) -> int:
    """Characters that change if stretches of words are replaced whole: never fewer than the edits between the two lines. Ends above ``most``, once it is
    passed. Where words differ, the lines go on at the nearest word they have in common among the next ``AHEAD``."""
    i = j = cost = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        x, y = a[i:i + AHEAD], b[j:j + AHEAD]
        p, q = min(((k, y.index(w)) for k, w in enumerate(x) if w in y), key=sum, default=(len(x), len(y)))
        n, m = sum(map(len, x[:p])) + p, sum(map(len, y[:q])) + q
        cost += max(n, m) - (1 if p and q else 0)
        if cost > most:
            return cost
        i, j = i + p, j + q
    rest = a[i:] or b[j:]
    return cost + sum(map(len, rest)) + len(rest)


def edit_distance(a: str, b: str) -> int:
    return edits_within(a, b, max(len(a), len(b)))


def similar(a: str, b: str, least: float) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    return abs(len(a) - len(b)) <= most and edits_within(a, b, most) <= most


def checker(lines: list[str], least: float) -> Callable[[int | np.ndarray, np.ndarray], np.ndarray]:
    """Test of lines (one or as many as there are others) against others: lengths first, then the edits of many pairs together. Of very long lines replaced
    words may prove a pair similar before its edits are counted."""
    held = edits.Lines(lines)
    size = held.size

    def one(i: int, j: int, most: int) -> bool:
        return edits_within(lines[i], lines[j], most) <= most

    def test(i: int | np.ndarray, js: np.ndarray) -> np.ndarray:
        i = np.broadcast_to(i, js.shape)
        most = ((1 - least) * np.maximum(size[i], size[js]) + 1e-9).astype(np.int64)
        ok = np.abs(size[i] - size[js]) <= most
        at = np.flatnonzero(ok)
        long = np.minimum(size[i[at]], size[js[at]]) > LONG
        for k, x, y, edits_ in zip(at[long].tolist(), i[at[long]].tolist(), js[at[long]].tolist(), most[at[long]].tolist()):
            ok[k] = replaced(lines[x].split(" "), lines[y].split(" "), edits_) <= edits_ or one(x, y, edits_)
        at = at[~long]
        ok[at] = held.within(i[at], js[at], most[at], one)
        return ok
    return test


def without_one(line: str) -> list[int]:
    """Bucket keys of a short line: of itself and of what is left without one of its characters."""
    left = {line, *[line[:i] + line[i + 1:] for i in range(len(line))]}
    return [near.OWN << near.KIND | xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 64 - near.KIND for x in left]


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, version, line, h, fp, votes, size, parts, short) of the lines that count; ``version`` is a hash of the text, ``h`` 16 bytes of the line, ``votes`` the words of its fingerprint, ``size`` its
    characters, ``short`` the bucket keys of a short line."""
    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("version", T.LongType()),
                           T.StructField("line", T.IntegerType()), T.StructField("h", T.BinaryType()), T.StructField("fp", T.LongType()),
                           T.StructField("votes", T.LongType()), T.StructField("size", T.LongType()), T.StructField("parts", T.BinaryType()), T.StructField("short", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [_bytes(t or "") for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                first, held = at, 0
                while at < len(texts) and held < STEP:
                    held += len(texts[at]) + 1
                    at += 1
                raw = b"\n".join(texts[first:at])
                hashes, start, end, lines = _words(raw)
                n_words = np.diff(np.searchsorted(start, lines))
                kept = np.flatnonzero(n_words >= max(min_words, 1))
                if not len(kept):
                    continue
                row = np.repeat(np.arange(first, at), [t.count(b"\n") + 1 for t in texts[first:at]])
                line = np.arange(len(row)) - np.searchsorted(row, row)
                fp, votes = fingerprints(hashes, end - start, np.repeat(np.arange(len(n_words)), n_words), len(n_words))
                norms = [b" ".join(raw[a:b].split()) for a, b in zip(lines[kept].tolist(), (lines[kept + 1] - 1).tolist())]
                h = [xxhash.xxh3_128_digest(x) for x in norms]
                data = np.frombuffer(b"".join(norms), dtype=np.uint8)
                whose = np.repeat(np.arange(len(norms)), [len(x) for x in norms])
                size = np.bincount(whose[(data & 0xC0) != 0x80], minlength=len(norms))
                parts = near.parts(data.astype(np.uint64), whose, len(norms), LEAST)
                short = [without_one(x.decode("utf-8", "surrogatepass")) if n <= SHORT else None for x, n in zip(norms, size.tolist())]
                take = pa.array(row[kept])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("version").take(take), pa.array(line[kept].astype(np.int32)),
                                                  pa.array(h, pa.binary()), pa.array(fp[kept].view(np.int64)), pa.array(votes[kept]), pa.array(size), near.packed(parts),
                                                  pa.array(short, pa.list_(pa.int64()))], names=fields.names)

    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(work, fields)


def _texts(docs: DataFrame, wanted: DataFrame, *names: str) -> DataFrame:
    """``names`` and ``norm`` of the wanted lines, each read from its first occurrence; the first name tells them apart."""
    @F.pandas_udf("array<string>")
    def pick(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, at in zip(texts, lines):
            own = text.split("\n")
            out.append([normalised(own[i]) for i in at])
        return pd.Series(out)

    per = wanted.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.version").alias("_version")).agg(
        F.collect_list(F.struct(F.col("first.line").alias("line"), *names)).alias("at"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("version"), "text")
    met = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    got = met.select("at", pick("text", F.col("at.line")).alias("norms"))
    return got.select(F.explode(F.arrays_zip("at", "norms")).alias("x")).select(*[f"x.at.{c}" for c in names], F.col("x.norms").alias("norm")).dropDuplicates([names[0]])


def _groups(docs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """(h, root) of the lines that are linked to others."""
    bodies = lambda ids: _texts(docs, distinct.join(ids, "id"), "id").select("id", F.col("norm").alias("body"))
    short = distinct.select("id", F.explode("short").alias("bucket"))
    links = near.links(distinct.select("id", "fp", "votes", "size", "parts"), bodies, lambda own: checker(own, similarity), similarity, short)
    roots = stored(components(links), "line-roots")
    grouped = distinct.select("id", "h").join(roots, "id").select("h", "root")
    return grouped.unionByName(distinct.select("h", F.col("id").alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select("h", "root"))


def repeated_lines(docs: DataFrame, min_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, version, lines): the numbers of the lines that go, for documents that lose any."""
    text_batches(docs.sparkSession)
    occ = stored(occurrences(docs, min_words), "lines")
    distinct = occ.groupBy("h").agg(F.min(F.struct("doc_id", "version", "line")).alias("first"), F.min("fp").alias("fp"), F.min("votes").alias("votes"), F.min("size").alias("size"),
                                    F.min("parts").alias("parts"), F.first("short").alias("short"), F.count(F.lit(1)).alias("n"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-lines")
    grouped = stored(_groups(docs, distinct, similarity), "line-groups")
    in_group = distinct.join(grouped, "h").select("root", "first")
    keepers = in_group.groupBy("root").agg(F.min("first").alias("keep"))
    fuzzy = grouped.join(keepers, "root").select("h", "keep")
    same = distinct.filter("n > 1").join(grouped, "h", "left_anti").select("h", F.col("first").alias("keep"))
    here = F.struct("doc_id", "version", "line")
    gone = occ.select("doc_id", "version", "line", "h").join(fuzzy.unionByName(same), "h").filter(~here.eqNullSafe(F.col("keep"))).select("doc_id", "version", "line").distinct()
    return gone.groupBy("doc_id", "version").agg(F.collect_list("line").alias("lines"))


def deduplicated(docs: DataFrame, min_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; ``n_lines`` and ``n_dropped`` (long) are added or replaced."""
    docs = docs.drop("n_lines", "n_dropped")
    @F.pandas_udf("string")
    def without(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, lines):
            drop = set(gone)
            out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
        return pd.Series(out)

    gone = repeated_lines(docs.select("doc_id", "text"), min_words, similarity)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), F.col("lines").alias("_lines"))
    met = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    shorter = without(F.when(F.col("_lines").isNotNull(), F.col("text")).otherwise(F.lit("")), F.coalesce("_lines", F.array().cast("array<int>")))
    return met.select(*[F.when(F.col("_lines").isNotNull(), shorter).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns],
                      n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_dropped"))
