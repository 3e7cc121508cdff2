"""Periodic runs of words: a harmonic grid of comparisons, longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) of at least
``max(least, 2 * q)`` words that no neighbouring word extends under that period. For every period q the
words at multiples of q are compared with those q further on; each run of that period holds such a pair. How far
an equal pair extends to both sides is a longest common extension (LCE).

LCE: only suffixes at positions of a difference cover modulo ``MODULUS`` are sorted. Any two positions reach sorted ones
after the same few steps, so fewer than ``MODULUS`` words are compared and a range minimum over the neighbours' common
prefixes gives the rest. Texts in which no pair outlasts the few words never need the index.

A text is cut at ASCII white space. A null text and one without words have no runs. Rows that repeat come out as often as they
came in, whatever their id; an empty table gives no rows. Other columns are not read. Long texts are worked off alone, short
ones many at a time; memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A perfect difference set, every remainder is the difference of two of its members.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
#: Words that are worked off together, about.
TOGETHER = 1 << 18

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def _steps() -> np.ndarray:
    """[remainder of i, remainder of j - i]: steps after which both i and j stand on the cover."""
    out = np.zeros((MODULUS, MODULUS), dtype=np.int64)
    for a in COVER:
        for b in COVER:
            for i in range(MODULUS):
                out[i, (b - a) % MODULUS] = (a - i) % MODULUS
    out[:, 0] = [min((c - i) % MODULUS for c in COVER) for i in range(MODULUS)]
    return out


STEPS = _steps()


def common(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words from i and j on are equal, ``most`` at most. ``i < j``; w must end with a word that stands nowhere else."""
    found = np.zeros(len(i), dtype=np.int64)
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        live = live[w[i[live] + k] == w[j[live] + k]]
        k += 1
        found[live] = k
        live = live[most[live] > k]
    return found


class Extension:
    """LCE of any two positions of ``w``, whose last word stands nowhere else."""

    def __init__(self, w: np.ndarray):
        self.w, n = w, len(w)
        on = np.zeros(MODULUS, dtype=bool)
        on[COVER] = True
        self.at = np.flatnonzero(on[np.arange(n) % MODULUS])
        self.number = np.full(n, -1, dtype=np.int64)
        self.number[self.at] = np.arange(len(self.at))
        levels = self._sort()
        self._table(levels)

    def _refine(self, rank: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Ranks (the first place of each group of equals) after ``key`` has parted equals."""
        size = np.bincount(rank, minlength=len(rank))
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            return rank
        tied = tied[np.lexsort((key[tied], rank[tied]))]
        r, k = rank[tied], key[tied]
        head = np.append(True, r[1:] != r[:-1])
        new = head | np.append(True, k[1:] != k[:-1])
        place = np.arange(len(tied))
        inside = place - np.maximum.accumulate(np.where(head, place, 0))
        out = rank.copy()
        out[tied] = np.maximum.accumulate(np.where(new, r + inside, 0))
        return out

    def _sort(self) -> list[tuple[int, np.ndarray]]:
        """Sort the sampled suffixes; (words, ranks by so many words) for every length that was needed."""
        n, at = len(self.w), self.at
        rank = np.zeros(len(at), dtype=np.int64)
        for k in range(MODULUS):
            where = at + k
            before, rank = rank, self._refine(rank, np.where(where < n, self.w[np.minimum(where, n - 1)], np.iinfo(np.int64).min))
            if before is rank and k:
                break
        levels, width = [(MODULUS, rank)], MODULUS
        while len(at) and np.bincount(rank).max() > 1:
            where = at + width  # a multiple of the modulus away, so on the cover as well
            nxt = np.where(where < n, rank[self.number[np.minimum(where, n - 1)]], -1)
            rank = self._refine(rank, np.where(where < n, nxt, -1))
            width *= 2
            levels.append((width, rank))
        return levels

    def _table(self, levels: list[tuple[int, np.ndarray]]) -> None:
        """Common prefixes of neighbours in the sorted order, and the minima over ranges of 1, 2, 4, ... of them."""
        order = np.argsort(levels[-1][1], kind="stable")
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        i, j = self.at[order[:-1]].copy(), self.at[order[1:]].copy()
        prefix, n = np.zeros(len(i), dtype=np.int64), len(self.w)
        for width, rank in reversed(levels):
            ok = np.flatnonzero(np.maximum(i, j) + width <= n)
            ok = ok[rank[self.number[i[ok]]] == rank[self.number[j[ok]]]]
            prefix[ok] += width
            i[ok] += width
            j[ok] += width
        prefix += common(self.w, i, j, np.minimum(MODULUS, n - np.maximum(i, j)))
        self.least, half = [prefix], 1
        while 2 * half <= len(prefix):
            row = self.least[-1]
            self.least.append(np.minimum(row[:-half], row[half:]))
            half *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """LCE of ``i < j``."""
        n = len(self.w)
        steps = np.minimum(STEPS[i % MODULUS, (j - i) % MODULUS], n - j)
        found = common(self.w, i, j, steps)
        far = np.flatnonzero((found == steps) & (j + steps < n))
        a, b = self.place[self.number[i[far] + steps[far]]], self.place[self.number[j[far] + steps[far]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own, row = level == k, self.least[k]
            found[far[own]] += np.minimum(row[lo[own]], row[hi[own] - (1 << k)])
        return found


def _grid(w: np.ndarray, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions i and periods q, i a multiple of q, with equal words at i and i + q in the same text."""
    at, period = [], []
    for q in range(1, longest // 2 + 1):
        hit = np.flatnonzero(w[:-q:q] == w[q::q]) * q
        if len(hit):
            at.append(hit)
            period.append(np.full(len(hit), q))
    if not at:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, q = np.concatenate(at), np.concatenate(period)
    same = text[i] == text[i + q]
    return i[same], q[same]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of all words with a different end word after each text; the text of each place; where texts begin."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    w = np.concatenate([np.append(t, -1 - k) for k, t in enumerate(texts)]).astype(np.int64)
    return w, np.repeat(np.arange(len(texts)), sizes), starts


def _around(w: np.ndarray, i: np.ndarray, q: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Equal words from (i, i + q) on, and before them; without ``most`` by the index, which is built here."""
    n = len(w)
    back = np.append(w[::-1], -n - 2)  # read backwards, again with an end of its own
    if most is None:
        onward, backward = Extension(w), Extension(back)
        return onward(i, i + q), backward(n - i - q, n - i)
    return common(w, i, i + q, np.minimum(most, n - i - q)), common(back, n - i - q, n - i, np.minimum(most, i))


def runs_of(texts: list[np.ndarray], least: int = 12) -> list[np.ndarray]:
    """For each text (an array of word numbers from 0) its runs as rows (start, length, period), by start and then period."""
    w, text, starts = _joined(texts)
    i, q = _grid(w, text, max(map(len, texts)))
    if not len(i):
        return [np.empty((0, 3), dtype=np.int64)] * len(texts)
    ahead, behind = _around(w, i, q, MODULUS)
    far = (ahead == MODULUS) | (behind == MODULUS)
    if far.any():  # only these texts are indexed
        own = np.unique(text[i[far]])
        sub, _, sub_starts = _joined([texts[k] for k in own])
        moved = i[far] + (sub_starts[np.searchsorted(own, text[i[far]])] - starts[text[i[far]]])
        ahead[far], behind[far] = _around(sub, moved, q[far], None)
    length = behind + q + ahead
    ok = length >= np.maximum(least, 2 * q)
    found = np.stack([i[ok] - behind[ok], length[ok], q[ok]], axis=1)
    # a stretch is found under multiples of its period, too: the smallest counts
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[:len(found)]
    found = found[first]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owner = text[found[:, 0]]
    found[:, 0] -= starts[owner]
    return np.split(found, np.searchsorted(owner, np.arange(1, len(texts))))


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Mask of the words that stand in a run after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def _portions(sizes: list[int]) -> Iterator[list[int]]:
    """Indexes of texts to work off together: alike in length, so that a long one does not lengthen the grid of short ones."""
    held: list[int] = []
    words = 0
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k]):
        if held and (words + sizes[k] > TOGETHER or sizes[k] > 2 * sizes[held[0]] + 64):
            yield held
            held, words = [], 0
        held.append(k)
        words += sizes[k]
    if held:
        yield held


def text_runs(texts: list[str | None], least: int = 12) -> list[tuple[int, np.ndarray, bytes]]:
    """(number of words, runs, the text without repeated periods) of each text."""
    split = [(t or "").encode().split() for t in texts]
    out: list[tuple[int, np.ndarray, bytes]] = [(0, np.empty((0, 3), np.int64), b"")] * len(texts)
    for own in _portions([len(s) for s in split]):
        number: dict[bytes, int] = {}
        coded = [np.array([number.setdefault(x, len(number)) for x in split[k]], dtype=np.int64) for k in own]
        for k, runs in zip(own, runs_of(coded, least)):
            ws = split[k]
            if len(runs):
                gone = dropped(len(ws), runs)
                ws = [ws[x] for x in np.flatnonzero(~gone)]
            out[k] = (len(split[k]), runs, b" ".join(ws))
    return out


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: all runs, and the words that are left, joined by one blank."""
    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *FIELDS])
    types = [pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names])), pa.string()]

    def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Rows of a batch by bytes, so that few long texts are in hand at once."""
        first, held = 0, 0
        for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
            if k > first and held + size > 8 * TOGETHER:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += size
        yield batch.slice(first)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches if b.num_rows for p in portions(b)):
            found = text_runs(batch.column("text").to_pylist(), least)
            counts = [len(r) for _, r, _ in found]
            flat = np.concatenate([r for _, r, _ in found])
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()),
                                            pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], RUN.names))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _, _ in found], types[0]), runs,
                                              pa.array([c.decode() for _, _, c in found], types[2])], names=fields.names)

    return docs.select("doc_id", "text").mapInArrow(work, fields)


