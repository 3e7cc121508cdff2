"""Two tokenizers over the same bytes: groups between common token ends, and how widely each pair of ids is linked.

Both token lists of a text are turned into byte offsets of token ends. Galloping intersection finds the common
ends: the shorter list drives, each of its ends is searched in the longer one from where an earlier end was found, in
steps that double, and then by halving. Ends of many texts are one ascending list, and all searches of one level
go at once: the middle of each gap starts where its left neighbour was found. Between two common ends lies a group; the
differences of the ranks say which tokens of either side it overlaps.

Every token of A is linked to every token of B in its group. ``linked`` adds, from the whole table, in how many rows' texts a
pair of ids is linked: pairs are folded inside a task, then over all, and looked up again. The counts travel to the tasks if they
are ``TABLE`` at most, and are joined otherwise; both ways give the same rows.

A null or empty text, and one whose joined token bytes differ from a blank and the text on either side, has no tokens: zeros,
an empty digest. Rows that repeat count as often as they occur; an empty table gives no rows; other columns are not read. A text is
worked off whole, so memory grows with the longest one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import stored, text_batches
from .packing import BLANKS, LATER, _encoder

#: Bytes of text that are aligned together, about.
TOGETHER = 1 << 20
#: Links of a group from which its ids are folded before they are paired.
WIDE = 1 << 12
#: Distinct pairs that a task holds before it passes its counts on.
HELD = 1 << 20
#: Distinct pairs whose counts are sent to the tasks, at 13 bytes each.
TABLE = 4_000_000
BYTE = re.compile("<0x([0-9A-F]{2})>")


@lru_cache(maxsize=2)
def _plain(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


@lru_cache(maxsize=2)
def _pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def byte_level(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    own = _plain(path)
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    names = [own.id_to_token(i) or "" for i in range(own.get_vocab_size())]
    return [n.encode() if n in special else bytes(shown[c] for c in n) for n in names]


@lru_cache(maxsize=2)
def piece_level(path: str) -> list[bytes]:
    """The bytes of each id of a sentencepiece model."""
    own = _pieces(path)
    names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := BYTE.fullmatch(n)) else n.replace("▁", " ").encode() for n in names]


@lru_cache(maxsize=2)
def _tables(a: str, b: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Byte lengths of A's and B's ids, and how ids are written: A inside and at the end of its part of a group, then B."""
    la, lb = (np.array([len(x) for x in t], dtype=np.int64) for t in (byte_level(a), piece_level(b)))
    shown = [f"{i}{end}" for i in range(len(la)) for end in ",|"] + [f"{i}{end}" for i in range(len(lb)) for end in ",;"]
    return la, lb, shown


def _encode_a(text: str, path: str) -> np.ndarray:
    """Ids of a text in which special strings are plain text; the faster encoder where it surely agrees."""
    if LATER.search(text) or BLANKS in text:
        return np.array(_plain(path).encode(text, add_special_tokens=False).ids, dtype=np.int64)
    return _encoder(path).encode_to_numpy(text, disallowed_special=()).astype(np.int64)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place in ``long`` whose value is not below it. Both ascend, and ``long`` ends with the largest value."""
    at = np.zeros(len(short), dtype=np.int64)
    gap = 1 << max(len(short) - 1, 0).bit_length()
    turn = np.zeros(min(len(short), 1), dtype=np.int64)  # the first value starts at the beginning
    while True:
        value, lo = short[turn], np.where(turn >= gap, at[np.maximum(turn - gap, 0)], 0)
        hi, live, width = lo.copy(), np.arange(len(turn)), 1
        while True:
            live = live[long[hi[live]] < value[live]]
            if not len(live):
                break
            lo[live] = hi[live] + 1
            hi[live] = np.minimum(hi[live] + width, len(long) - 1)
            width *= 2
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = long[mid] < value[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        at[turn] = lo
        if gap == 1:
            return at
        gap >>= 1
        turn = np.arange(gap, len(short), 2 * gap)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in a and in b of the values they share."""
    if len(a) > len(b):
        y, x = common_ends(b, a)
        return x, y
    at = gallop(a, b)
    same = b[at] == a if len(b) else np.zeros(len(a), dtype=bool)
    return np.flatnonzero(same), at[same]


def _folded(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sum of their times."""
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    return key[first], np.add.reduceat(times, first) if len(first) else times


class Aligned:
    """The token lists of many texts, their groups, and the pairs they link."""

    def __init__(self, texts: list[str | None], a: str, b: str):
        bytes_a, bytes_b = byte_level(a), piece_level(b)
        la, lb, self.shown = _tables(a, b)
        self.n, self.base, self.wide = len(texts), len(la), len(lb)
        some = [k for k, t in enumerate(texts) if t]
        pairs = zip(some, _pieces(b).encode([texts[k] for k in some], num_threads=1))
        kept, ids_a, ids_b = [], [], []
        for k, right in pairs:
            whole = " " + texts[k]
            left, raw = _encode_a(whole, a), whole.encode()
            if b"".join(map(bytes_b.__getitem__, right)) == raw and b"".join(map(bytes_a.__getitem__, left.tolist())) == raw:
                kept.append(k)
                ids_a.append(left)
                ids_b.append(np.array(right, dtype=np.int64))
        none = np.empty(0, dtype=np.int64)
        self.kept = np.array(kept, dtype=np.int64)
        self.a, self.b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
        sizes_a, sizes_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (ids_a, ids_b))
        self.n_a, self.n_b = self._per_row(sizes_a), self._per_row(sizes_b)
        self.last_a, self.last_b = common_ends(np.cumsum(la[self.a]), np.cumsum(lb[self.b]))
        self.first_a, self.first_b = (np.append(0, x[:-1] + 1)[:len(x)] for x in (self.last_a, self.last_b))
        self.in_a, self.in_b = self.last_a - self.first_a + 1, self.last_b - self.first_b + 1
        self.text = np.searchsorted(np.cumsum(sizes_a), self.last_a, side="right")  # of each group, a number in ``kept``
        self.n_groups = self._per_row(np.bincount(self.text, minlength=len(kept)))
        links = np.zeros(len(kept), dtype=np.int64)
        np.add.at(links, self.text, self.in_a * self.in_b)
        self.n_links = self._per_row(links)

    def _per_row(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n, dtype=np.int64)
        out[self.kept] = values
        return out

    def digests(self) -> list[str]:
        """Hex digest of the groups of each text, empty where there are no tokens."""
        end_a, end_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        end_a[self.last_a] = end_b[self.last_b] = 1
        code = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        code[np.arange(len(self.a)) + np.repeat(self.first_b, self.in_a)] = 2 * self.a + end_a
        code[np.arange(len(self.b)) + np.repeat(self.last_a + 1, self.in_b)] = 2 * (self.base + self.b) + end_b
        cuts = np.append(0, np.cumsum((self.n_a + self.n_b)[self.kept]))
        out = [""] * self.n
        for k, lo, hi in zip(self.kept.tolist(), cuts.tolist(), cuts[1:].tolist()):
            out[k] = hashlib.sha256("".join(map(self.shown.__getitem__, code[lo:hi].tolist()))[:-1].encode()).hexdigest()
        return out

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row its distinct pairs (A id * size of B + B id, ascending) and how often it links them."""
        span = self.base * self.wide
        many = self.in_a * self.in_b
        own = np.flatnonzero(many <= WIDE)
        rep = np.repeat(own, many[own])
        k = np.arange(len(rep)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        keys = [self.text[rep] * span + self.a[self.first_a[rep] + k // self.in_b[rep]] * self.wide + self.b[self.first_b[rep] + k % self.in_b[rep]]]
        times = [np.ones(len(rep), dtype=np.int64)]
        for g in np.flatnonzero(many > WIDE):
            x, nx = np.unique(self.a[self.first_a[g]:self.last_a[g] + 1], return_counts=True)
            y, ny = np.unique(self.b[self.first_b[g]:self.last_b[g] + 1], return_counts=True)
            keys.append((self.text[g] * span + x[:, None] * self.wide + y).ravel())
            times.append((nx[:, None] * ny).ravel())
        key, count = _folded(np.concatenate(keys), np.concatenate(times))
        cuts = np.searchsorted(key, np.arange(len(self.kept) + 1) * span)
        at = np.full(self.n, -1)
        at[self.kept] = np.arange(len(self.kept))
        for row in at.tolist():
            if row < 0:
                yield np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            else:
                yield key[cuts[row]:cuts[row + 1]] - row * span, count[cuts[row]:cuts[row + 1]]

    def groups(self) -> Iterator[list[dict]]:
        """For each row the ranks of the first and last token of either side, group by group."""
        cuts = np.searchsorted(self.text, np.arange(len(self.kept) + 1))
        starts_a = np.cumsum(self.n_a[self.kept]) - self.n_a[self.kept]
        starts_b = np.cumsum(self.n_b[self.kept]) - self.n_b[self.kept]
        out: list[list[dict]] = [[] for _ in range(self.n)]
        for k, row in enumerate(self.kept.tolist()):
            g = slice(cuts[k], cuts[k + 1])
            cols = [self.first_a[g] - starts_a[k], self.last_a[g] - starts_a[k], self.first_b[g] - starts_b[k], self.last_b[g] - starts_b[k]]
            out[row] = [dict(zip(GROUP.names, x)) for x in zip(*[c.tolist() for c in cols])]
        return iter(out)


GROUP = T.StructType([T.StructField(n, T.LongType()) for n in ("a_first", "a_last", "b_first", "b_last")])
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if most < 1 << 8 * w)).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}" if n else "<u1").astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, held = 0, 0
        for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            if k > first and held + size > TOGETHER:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += size
        if batch.num_rows:
            yield batch.slice(first)


def alignments(docs: DataFrame, a: str, b: str, keep_groups: bool = False, keep_links: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256) for every row; ``groups`` (ranks of tokens, group by group) and
    the packed links (``n_pairs``, ``steps`` from pair to pair, ``times``) on demand."""
    text_batches(docs.sparkSession)
    more = [T.StructField("groups", T.ArrayType(GROUP))] if keep_groups else []
    more += [T.StructField("n_pairs", T.LongType()), T.StructField("steps", T.BinaryType()), T.StructField("times", T.BinaryType())] if keep_links else []
    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
                           T.StructField("groups_sha256", T.StringType()), *more])
    group = pa.list_(pa.struct([(n, pa.int64()) for n in GROUP.names]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            found = Aligned(batch.column("text").to_pylist(), a, b)
            cols = [batch.column("doc_id"), *[pa.array(getattr(found, c)) for c in COUNTS], pa.array(found.digests(), pa.string())]
            if keep_groups:
                cols.append(pa.array(list(found.groups()), group))
            if keep_links:
                links = list(found.links())
                cols += [pa.array([len(x) for x, _ in links], pa.int64()), pa.array([_packed(np.diff(x, prepend=0)) for x, _ in links], pa.binary()),
                         pa.array([_packed(t) for _, t in links], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=fields.names)

    return docs.select("doc_id", "text").mapInArrow(work, fields)


def _pairs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for n, raw in zip(batch.column("n_pairs").to_pylist(), batch.column("steps").to_pylist()):
        yield np.cumsum(_unpacked(raw, n))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): in how many rows each pair stands. A task folds what it meets before anything is shuffled."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, dtype=np.int64),) * 2
        for batch in batches:
            keys = np.concatenate([held[0], *_pairs(batch)])
            held = _folded(keys, np.concatenate([held[1], np.ones(len(keys) - len(held[0]), dtype=np.int64)]))
            if len(held[0]) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "n"])
                held = (np.empty(0, dtype=np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["pair", "n"])

    part = links.select("n_pairs", "steps").mapInArrow(work, "pair long, n long")
    return part.groupBy("pair").agg(F.sum("n").alias("n"))


def _ranked(counts: DataFrame, size_b: int) -> DataFrame:
    """``counts`` with ``best``: whether the pair's count is the highest of its A id."""
    own = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    most = own.groupBy("a").agg(F.max("n").alias("most"))
    return own.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(links: DataFrame, ranked: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) with the counts sent to the tasks; they are ``TABLE`` at most."""
    t = ranked.orderBy("pair").toArrow()
    sent = links.sparkSession.sparkContext.broadcast(tuple(t[c].to_numpy() for c in ("pair", "n", "best")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            sizes = batch.column("n_pairs").to_numpy()
            times = [_unpacked(raw, k) for raw, k in zip(batch.column("times").to_pylist(), sizes.tolist())]
            none = np.empty(0, dtype=np.int64)
            at, times = np.searchsorted(pair, np.concatenate([none, *_pairs(batch)])), np.concatenate([none, *times])
            row = np.repeat(np.arange(len(sizes)), sizes)
            out = np.zeros((2, len(sizes)), dtype=np.int64)
            np.add.at(out[0], row, times * best[at])
            np.add.at(out[1], row, times * n[at])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out[0]), pa.array(out[1])], names=["row", "n_best", "count_sum"])

    return links.select("row", "n_pairs", "steps", "times").mapInArrow(work, "row long, n_best long, count_sum long")


def _joined_up(links: DataFrame, ranked: DataFrame) -> DataFrame:
    """The same by a join over all pairs, for any number of them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, pairs in enumerate(_pairs(batch)):
                times = _unpacked(batch.column("times")[k].as_py(), len(pairs))
                row = np.full(len(pairs), batch.column("row")[k].as_py(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pairs), pa.array(times)], names=["row", "pair", "times"])

    each = links.select("row", "n_pairs", "steps", "times").mapInArrow(work, "row long, pair long, times long")
    met = each.join(ranked, "pair")
    return met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def linked(docs: DataFrame, a: str, b: str, table: int = TABLE) -> DataFrame:
    """What ``alignments`` gives with ``n_best`` (links whose pair is linked in as many rows as any of its A id) and ``count_sum``
    (over the links, in how many rows their pairs are linked)."""
    own = alignments(docs, a, b, keep_links=True).withColumn("row", F.monotonically_increasing_id())
    own = stored(own, "aligned", compression="zstd")
    ranked = stored(_ranked(stored(pair_counts(own), "pair-counts"), len(piece_level(b))), "ranked-pairs")
    found = _looked_up(own, ranked) if ranked.count() <= table else _joined_up(own, ranked)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return own.select("row", "doc_id", *COUNTS, "groups_sha256").join(found, "row", "left").select("doc_id", *COUNTS, *zero, "groups_sha256")
