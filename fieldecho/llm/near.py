"""Similar sequences of units (bytes of a line, words of a document): SimHash blocks and shared parts find candidates, the caller's
exact check decides.

Each row has a SimHash fingerprint of the whole and up to ``PARTS`` parts. Two rows become candidates in one of two ways:

* fingerprints that differ in at most ``DISTANCE`` bits agree on a choice of blocks (pigeonhole), so they share a bucket;
* few edits leave some part of the sequence untouched. A sequence is cut where the hash of three units is the smallest around, so
  cuts move along with the text; a part reaches over two gaps between cuts, parts overlap, and those with the smallest hashes count.

A bucket holds ids alone. Buckets with one row are dropped before anything else is joined, large ones are worked off chunk by chunk.
A pair is looked at in one bucket only: in that of the first choice of blocks it shares, else of the smallest part. It is passed
on if sizes allow the similarity and if fingerprints, where they are built of many words, differ in ``FAR`` bits at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BITS, block_keys, groups, in_tasks, layout
from .common import stored

#: Parts of a row that count, bytes that one is held in, and units around a cut that it must be the smallest of, to each side.
PARTS, WIDTH, AROUND = 6, 5, 3
#: Bits in which fingerprints that share a block differ at most, and those of rows that are compared at all.
DISTANCE, FAR = 3, 24
#: Fingerprints of fewer hashes (``votes``) never keep rows from being compared: few words make few bits sure.
BRIEF = 6
#: Groups up to this size are compared row against shifted row, all groups of a batch at once.
SMALL = 32
#: Pairs that are compared at once.
STEP = 1 << 17
#: Pairs that the exact check gets at once, about.
TESTED = 1 << 13
#: Rows whose groups are worked off together, about, and bytes of them: the exact check counts many pairs for the price of a few.
TOGETHER, HELD = 1 << 14, 8 << 20
#: Bytes of bodies that one side of a task holds, about.
BYTES = 16 << 20
#: Where a bucket's kind stands in its key; blocks come first, then parts, then what the caller adds.
KIND, PART, OWN = 52, 100, 101
FACTOR = 0x9E3779B97F4A7C15
NONE = np.uint64(2**64 - 1)
LINKS = "a long, b long"
Check = Callable[[list], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def mixed(h: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``FACTOR`` from 0 to n at least, and of its inverse modulo 2 ** 64; the last table is kept."""
    size = 1 << max(18, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size, b, dtype=np.uint64)), dtype=np.uint64) for b in (FACTOR, pow(FACTOR, -1, 2**64)))
    return _POWERS[size]


def parts(units: np.ndarray, row: np.ndarray, rows: int, least: int) -> np.ndarray:
    """Packed parts (``PARTS`` numbers of ``WIDTH`` bytes, ascending, filled up with the largest) of each row. ``units`` are the hashes of
    all rows' units in order, ``row`` says whose a unit is; a part has ``least`` units at least."""
    out = np.full((rows, PARTS), (1 << 8 * WIDTH) - 1, dtype=np.uint64)
    n = len(units) - 2
    if n > 0:
        up, down = powers(len(units))
        running = np.append(np.uint64(0), np.cumsum((units + np.uint64(1)) * up[:len(units)], dtype=np.uint64))
        whole = row[:-2] == row[2:]
        tri = np.where(whole, mixed((running[3:] - running[:-3]) * down[:n]) >> np.uint64(1), NONE)
        low = tri.copy()
        for d in range(1, AROUND + 1):  # what stands in another row is no neighbour: its place is as large as can be
            same = row[d:n] == row[:n - d]
            np.minimum(low[d:], np.where(same, tri[:-d], NONE), out=low[d:])
            np.minimum(low[:-d], np.where(same, tri[d:], NONE), out=low[:-d])
        cut = np.flatnonzero(whole & (tri == low))
        start, last = cut[:-2], cut[2:]
        run = (last - start == 2) & (tri[start] == tri[last])  # one unit over and over: each place is a cut
        end = np.where(run, start + max(least, 5), last + 3)
        ok = (end - start >= least) & (end <= len(row))
        ok &= row[start] == row[np.minimum(end, len(row)) - 1]
        start, end = start[ok], end[ok]
        key = mixed((running[end] - running[start]) * down[start]) >> np.uint64(64 - 8 * WIDTH)
        owner = row[start]
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[:len(key)]
        key, owner = key[new], owner[new]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = rank < PARTS
        out[owner[kept], rank[kept]] = key[kept]
    return out


def packed(values: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(*values.shape, 8)[:, :, :WIDTH]).tobytes()
    size = values.shape[1] * WIDTH
    return pa.array([raw[i:i + size] for i in range(0, len(raw), size)], pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, PARTS, WIDTH)
    out = np.zeros((len(raw), PARTS, 8), dtype=np.uint8)
    out[:, :, :WIDTH] = raw
    return out.view("<u8")[:, :, 0]


class _Rows:
    """Fingerprints, sizes and parts of the rows of a task, and which pairs of them are candidates here."""

    def __init__(self, t: pa.Table, key: np.ndarray, blocks: int, agree: int, least: float):
        self.fp, self.size, self.parts = t["fp"].to_numpy().view(np.uint64), t["size"].to_numpy(), unpacked(t["parts"])
        self.votes = t["votes"].to_numpy()
        self.kind, self.low = key >> KIND, (key & ((1 << KIND) - 1)).view(np.uint64)
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        self.masks = np.array([((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])], dtype=np.uint64)
        self.choices = np.array(list(combinations(range(blocks), agree)))
        self.least = least

    def first_choice(self, far: np.ndarray) -> np.ndarray:
        """Number of the first choice of blocks on which fingerprints agree that differ by ``far``; -1 for none."""
        zero = (far[:, None] & self.masks) == 0
        hit = zero[:, self.choices].all(axis=2)
        return np.where(hit.any(axis=1), hit.argmax(axis=1), -1)

    def smallest_part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.parts[a], self.parts[b]
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        return np.where(same, x, NONE).min(axis=1)

    def candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Mask of the pairs of places that are to be looked at in this bucket."""
        lo, hi = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        far = self.fp[a] ^ self.fp[b]
        ok = (lo >= self.least * hi - 1e-9) & ((np.minimum(self.votes[a], self.votes[b]) < BRIEF) | (np.bitwise_count(far) <= FAR))
        at = np.flatnonzero(ok)
        first, kind = self.first_choice(far[at]), self.kind[a[at]]
        here = (first == kind) | (kind == OWN)
        rest = np.flatnonzero((first < 0) & (kind == PART))
        here[rest] = self.smallest_part(a[at[rest]], b[at[rest]]) == self.low[a[at[rest]]]
        ok[at] = here
        return ok


def forest(n: int, agrees: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Spanning forest over n nodes, as (index, newly reached indexes); ``agrees`` checks an index against others."""
    left = np.arange(n)
    while len(left) > 1:
        stack, left = [int(left[0])], left[1:]
        while stack and len(left):
            u = stack.pop()
            hit = agrees(u, left)
            new = left[hit]
            if len(new):
                yield u, new
                stack.extend(new.tolist())
                left = left[~hit]


def _spread(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index spreads over the links a-b."""
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def unlinked_pairs(edges: np.ndarray, likely: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: Callable[[np.ndarray, np.ndarray], np.ndarray]
                   ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that connect what all ``likely`` and ``exact`` pairs inside the groups between ``edges`` would, fewer than there are places. Places are compared
    with those one further on, then two, and so on, in all groups at once, so that the costly test always gets many pairs; places that are connected by then are not compared.
    A connected group passes on how the smallest places of its former groups hang together, not the pairs that were found."""
    size = np.diff(edges)
    after = np.repeat(edges[1:], size) - np.arange(edges[-1]) - 1  # places of the same group that follow
    root, at, lag = np.arange(edges[-1]), np.arange(edges[-1]), 0
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    while len(at):
        lag += 1
        at = at[after[at] >= lag]
        new = at[root[at] != root[at + lag]]
        for k in range(0, len(new), STEP):
            part = new[k:k + STEP]
            part = part[likely(part, part + lag)]
            kept.append((part, part + lag))
            held += len(part)
        if held >= TESTED or not len(at):
            a, b = (np.concatenate(x) for x in zip(*kept)) if kept else (at, at)
            some = root[a] != root[b]
            a, b = a[some], b[some]
            hit = exact(a, b) if len(a) else np.zeros(0, dtype=bool)
            a, b = root[a[hit]], root[b[hit]]
            root = _spread(root, a, b)
            joined = np.unique(np.concatenate((a, b)))
            joined = joined[root[joined] != joined]
            kept, held = [], 0
            yield root[joined], joined


def _clusters(dealt: DataFrame, blocks: int, agree: int, least: float) -> DataFrame:
    """(cluster, bucket, id): in each task of a bucket, the connected groups of candidates."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in groups(batches):
            bucket, ids = t["key"].to_numpy(), t["id"].to_numpy()
            rows = _Rows(t, bucket, blocks, agree, least)
            size = np.diff(edges)
            group, small = np.repeat(np.arange(len(size)), size), np.repeat(size <= SMALL, size)
            root, met, left, right = np.arange(len(ids)), np.zeros(len(ids), dtype=bool), [], []
            for lag in range(1, min(SMALL, len(ids))):
                at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
                if not len(at):
                    break
                for i in range(0, len(at), STEP):
                    part = at[i:i + STEP]
                    part = part[rows.candidates(part, part + lag)]
                    left.append(part)
                    right.append(part + lag)
            for g in np.flatnonzero(size > SMALL):
                at = edges[g]
                for u, new in forest(size[g], lambda u, js, at=at: rows.candidates(np.full(len(js), at + u), at + js)):
                    left.append(np.full(len(new), at + u))
                    right.append(at + new)
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                root = _spread(root, a, b)
                met[a] = met[b] = True
            at = np.flatnonzero(met)
            if len(at):
                task = np.stack([t[c].to_numpy()[at].astype(np.int64) for c in ("key", "lo", "hi")] + [ids[root[at]]], axis=1)
                name = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in task], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(bucket[at]), pa.array(ids[at])], ["cluster", "bucket", "id"])

    return dealt.select("key", "lo", "hi", "id", "fp", "votes", "size", "parts").mapInArrow(work, "cluster long, bucket long, id long")


def _part_buckets(rows: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = unpacked(batch.column("parts"))
                at, k = np.nonzero(held != (1 << 8 * WIDTH) - 1)
                key = held[at, k] | np.uint64(PART << KIND)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(key.view(np.int64))], ["id", "bucket"])

    return rows.select("id", "parts").mapInArrow(work, "id long, bucket long")


def links(rows: DataFrame, bodies: Callable[[DataFrame], DataFrame], check: Check, similarity: float, more: DataFrame | None = None, each: int = 1) -> DataFrame:
    """Links (a, b) that connect the ids of ``rows`` (id, fp, votes, size, parts) as all candidates that pass the check would. ``bodies`` makes (id, body) for
    a frame of distinct ids; ``check`` takes the bodies of a task and returns a test of places against as many others. ``more`` holds further
    buckets (id, bucket), which the caller marks with the kind ``OWN``. A body has about ``each`` bytes for each of its ``size``."""
    n = rows.count()
    blocks, agree = layout(DISTANCE, 64 * n)  # thin buckets: more keys cost less than long buckets
    keys = F.posexplode(block_keys(F.col("fp"), blocks, agree)).alias("_choice", "_bits")
    width = agree * -(-BITS // blocks)
    by_fp = rows.select("id", keys).select("id", (F.shiftleft(F.col("_choice").cast("long"), KIND)).bitwiseOR(F.col("_bits").bitwiseAND(F.lit((1 << width) - 1))).alias("bucket"))
    buckets = by_fp.unionByName(_part_buckets(rows))
    if more is not None:
        buckets = buckets.unionByName(more)
    dealt = in_tasks(buckets, F.col("bucket"), "id", rows.select("id", "fp", "votes", "size", "parts"))
    found = stored(_clusters(dealt, blocks, agree, similarity), "candidates")
    texts = stored(bodies(found.select("id").distinct()), "candidate-bodies")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in groups(batches, TOGETHER, HELD):
            here, ids, left, right = _Rows(t, t["bucket"].to_numpy(), blocks, agree, similarity), t["id"].to_numpy(), [], []
            exact = check(t["body"].to_pylist())
            for a, b in unlinked_pairs(edges, here.candidates, exact):
                left.append(ids[a])
                right.append(ids[b])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    held = texts.join(rows.select("id", "fp", "votes", "size", "parts"), "id").drop("size")
    met = in_tasks(found.join(rows.select("id", "size"), "id"), F.col("cluster"), "id", held, F.col("size"), BYTES // each)
    return met.select("key", "lo", "hi", "bucket", "id", "fp", "votes", "size", "parts", "body").mapInArrow(work, LINKS)
