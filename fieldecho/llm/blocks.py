"""Pigeonhole blocks over 64-bit fingerprints: close pairs share a bucket, buckets are worked off in bounded tasks.

A fingerprint is split into ``distance + r`` blocks. Two fingerprints with at most ``distance``
differing bits agree on at least ``r`` blocks, so every choice of ``r`` blocks gives one bucket key
and each close pair meets in some bucket; more fingerprints take a larger ``r``, which makes more
but thinner buckets. A bucket of any size is cut into chunks of about ``CHUNK`` rows by a hash of
what tells its rows apart, and every two chunks of a bucket meet in one task; small buckets stay whole. Inside a task only a spanning forest of the links is produced, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 64
#: Fingerprints that share a bucket on average, at most.
FULL = 64
#: Rows of a bucket that one side of a task holds, about.
CHUNK = 2048
#: Groups up to this size are compared row against shifted row, all groups of a batch at once.
SMALL = 6


def layout(distance: int, rows: int) -> tuple[int, int]:
    """How many blocks a fingerprint is split into, and how many of them make a key: as few as keep buckets of ``rows`` evenly
    spread fingerprints below ``FULL``. Close pairs agree on at least ``blocks - distance`` blocks, so no choice loses any."""
    for agree in (1, 2, 3):
        blocks = distance + agree
        if rows <= FULL << (agree * (BITS // blocks)):
            break
    return blocks, agree


def block_keys(fp: Column, blocks: int, agree: int) -> Column:
    """Array of bucket keys: for every choice of blocks, the choice's number and the blocks' bits, as one long."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    width = max(b - a for a, b in zip(edges, edges[1:]))
    part = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(blocks)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(k).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width) + part[i]
        keys.append(key)
    return F.array(*keys)


def in_tasks(rows: DataFrame, key: Column, own: str = "fp", more: DataFrame | None = None, weight: Column | None = None, most: int = 0) -> DataFrame:
    """Rows (one per item and key) dealt to tasks: columns ``key``, ``lo``, ``hi`` name the task. ``own`` is the column that
    tells the items of a key apart, so that no chunk gets more than its share. Keys with one row are left out. What ``more`` holds by ``own`` is joined to the rows that are left.
    With a ``weight`` of rows, chunks hold about ``most`` of it as well."""
    same = Window.partitionBy("key")
    counted = rows.withColumn("key", key).withColumn("_n", F.count(F.lit(1)).over(same))
    chunks = F.ceil(F.col("_n") / CHUNK)
    if weight is not None:
        counted = counted.withColumn("_w", F.sum(weight).over(same))
        chunks = F.greatest(chunks, F.ceil(F.col("_w") / most))
    counted = counted.filter("_n > 1").withColumn("_chunks", chunks.cast("int"))
    mine = F.pmod(F.xxhash64(own), F.col("_chunks")).cast("int")
    other = F.when(F.col("_chunks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("_chunks") - 1), lambda c: c != F.col("_mine")))
    dealt = (counted.withColumn("_mine", mine).withColumn("_other", F.explode(other))
             .withColumn("lo", F.least("_mine", "_other")).withColumn("hi", F.greatest("_mine", "_other")))
    dealt = dealt.drop("_n", "_w", "_chunks", "_mine", "_other")
    if more is not None:
        dealt = dealt.join(more, own)
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def close(x: np.uint64, others: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(others ^ x) <= distance


def forest(fps: np.ndarray, distance: int, agrees: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, np.ndarray]]:
    """Spanning forest of the graph of close pairs, as (index, newly reached indexes). ``agrees`` verifies an index
    against others and returns a mask."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            u = stack.pop()
            hit = close(fps[u], fps[left], distance)
            if agrees is not None and hit.any():
                hit[np.flatnonzero(hit)] = agrees(u, left[hit])
            new = left[hit]
            if len(new):
                out.append((u, new))
                stack.extend(new)
                left = left[~hit]
    return out


def groups(batches: Iterator[pa.RecordBatch], rows: int = 0, size: int = 0) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by (key, lo, hi), many at a time: a table and the groups' first rows, with its length at
    the end. Batches are gathered until they have ``rows`` rows or ``size`` bytes; the last group waits for the next ones."""
    kept: list[pa.RecordBatch] = []
    n = held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        n, held = n + batch.num_rows, held + batch.nbytes
        if n < rows and held < size:
            continue
        n = held = 0
        t = pa.Table.from_batches(kept).combine_chunks()
        edges = _edges(t)
        if len(edges) == 1:
            continue
        cut = int(edges[-1])
        yield t.slice(0, cut), np.append(edges[:-1], cut)
        kept = t.slice(cut).combine_chunks().to_batches()
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, np.append(_edges(t), t.num_rows)


def _edges(t: pa.Table) -> np.ndarray:
    change = np.zeros(t.num_rows - 1, dtype=bool)
    for name in ("key", "lo", "hi"):
        v = t[name].to_numpy()
        change |= v[1:] != v[:-1]
    return np.append(0, np.flatnonzero(change) + 1)


def fingerprint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` as all pairs within ``distance`` bits would."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, edges in groups(batches):
            fp = t["fp"].to_numpy().view(np.uint64)
            size = np.diff(edges)
            group = np.repeat(np.arange(len(size)), size)
            small = np.repeat(size <= SMALL, size)
            left, right = [], []
            for lag in range(1, SMALL):
                if lag >= len(fp):
                    break
                ok = (group[lag:] == group[:-lag]) & small[lag:]
                ok &= np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= distance
                at = np.flatnonzero(ok)
                left.append(fp[at])
                right.append(fp[at + lag])
            for g in np.flatnonzero(size > SMALL):
                own = fp[edges[g]:edges[g + 1]]
                for u, new in forest(own, distance):
                    left.append(np.repeat(own[u], len(new)))
                    right.append(own[new])
            if left:
                a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    own = stored(fps.select("fp").distinct(), "distinct-fingerprints")
    blocks, agree = layout(distance, own.count())
    keyed = own.select("fp", F.explode(block_keys(F.col("fp"), blocks, agree)).alias("bucket"))
    return in_tasks(keyed, F.col("bucket")).select("key", "lo", "hi", "fp").mapInArrow(work, "a long, b long")
