"""Edit distances of many pairs of lines at once, compared with a limit of each pair.

The columns of all pairs of a batch are worked off together, 64 rows of a column in one word and carries between the words, so a step costs a few array
operations for thousands of pairs. What two lines share at either end is left out first. A pair whose limit is out of reach is dropped.
Similar lines are mostly proven so by pieces of one word laid one after another (``_laid``). Where the limit is narrower than the column, only the diagonals that so many edits can reach are held, in a window that moves down with each column.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

WORD = 64
#: Characters that the rows of a batch hold, and pairs of a batch at most.
CELLS, PAIRS = 1 << 20, 8192
#: Words of a batch's table of the rows that characters stand in; it is halved until it fits.
TABLE = 1 << 21
#: Columns after which finished pairs are taken out.
EVERY = 8
#: Pairs for each word of a column, and once more, below which they are counted one by one.
FEW = 12
#: The same for the words of a window.
FEW_IN_BAND = 8
#: Columns of a laid piece beyond its length.
BEYOND = 24
ONE = np.uint64(1)


class Lines:
    """Code points of lines, one after another."""

    def __init__(self, lines: list[str]):
        self.size = np.array([len(x) for x in lines], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.high = int(self.data.max(initial=0))
        self.data = np.append(self.data, np.uint32(0)).astype(np.uint8 if self.high < 256 else np.uint16 if self.high < 65536 else np.uint32)

    def matrix(self, start: np.ndarray, width: int) -> np.ndarray:
        """``width`` characters from each place on; places beyond the end hold any character."""
        return self.data[np.minimum(start[:, None] + np.arange(width), len(self.data) - 1)]

    def ends(self, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
        """How many characters are equal from places a and b on, forwards or backwards, ``room`` at most."""
        i = np.arange(int(room.max(initial=0)))
        if not len(i):
            return np.zeros(len(a), dtype=np.int64)
        last = len(self.data) - 1
        differ = self.data[np.clip(a[:, None] + step * i, 0, last)] != self.data[np.clip(b[:, None] + step * i, 0, last)]
        differ |= i >= room[:, None]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), room)

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, one: Callable[[int, int, int], bool] | None = None) -> np.ndarray:
        """Mask of the pairs of lines with at most ``most`` edits; ``one`` tells it of a single pair, where too few are left for columns of many."""
        out = np.zeros(len(a), dtype=bool)
        shorter = np.minimum(self.size[a], self.size[b])
        for part in _cut(np.argsort(shorter, kind="stable"), shorter):
            out[part] = self._within(a[part], b[part], most[part], one)
        return out

    def _within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, one: Callable[[int, int, int], bool] | None) -> np.ndarray:
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        m, n, at, to = self.size[a], self.size[b], self.start[a], self.start[b]
        cut = self.ends(at, to, m, 1)
        m, n, at, to = m - cut, n - cut, at + cut, to + cut
        cut = self.ends(at + m - 1, to + n - 1, m, -1)
        m, n = m - cut, n - cut
        out = n <= most  # never more edits than characters of the longer
        words = -(-m // WORD)
        room = (most - (n - m)) // 2
        band = (n - m + 2 * room) // WORD + 1
        todo = ~out & (n - m <= most) & (m > 0)
        long = np.flatnonzero(todo & (words > 1))
        proven = long[self._laid(at[long], m[long], to[long], n[long], most[long])]
        out[proven], todo[proven] = True, False
        by_band = todo & (band < words)
        for w in np.unique(band[by_band]):
            of_w = np.flatnonzero(by_band & (band == w))
            if one is not None and len(of_w) < FEW_IN_BAND * w:
                out[of_w] = [one(i, j, k) for i, j, k in zip(a[of_w].tolist(), b[of_w].tolist(), most[of_w].tolist())]
                continue
            for part in _cut(of_w[np.argsort(n[of_w], kind="stable")], n):
                out[part] = self._band(at[part], m[part], to[part], n[part], most[part], room[part], int(w))
        left = todo & ~by_band
        for w in np.unique(words[left]):
            todo = np.flatnonzero(left & (words == w))
            if one is not None and len(todo) < FEW * (w + 1):
                out[todo] = [one(i, j, k) for i, j, k in zip(a[todo].tolist(), b[todo].tolist(), most[todo].tolist())]
                continue
            for part in _cut(todo[np.argsort(n[todo], kind="stable")], n):
                out[part] = self._columns(at[part], m[part], to[part], n[part], most[part], int(w))
        return out

    def _laid(self, at: np.ndarray, m: np.ndarray, to: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Mask of the pairs whose pieces of ``WORD`` characters, each laid where the one before ends, take ``most`` edits at most: never fewer than the
        edits between the lines."""
        cost, begin, k = np.zeros(len(m), dtype=np.int64), np.zeros(len(m), dtype=np.int64), 0
        live = np.arange(len(m))
        while len(live):
            rows = np.minimum(m[live] - k * WORD, WORD)
            width = np.minimum(n[live] - begin[live], rows + BEYOND)
            for part in _cut(np.argsort(width, kind="stable"), width):
                i = live[part]
                found, end = self._piece(at[i] + k * WORD, rows[part], to[i] + begin[i], width[part])
                cost[i] += found
                begin[i] += end
            k += 1
            cost[live] += np.where(k * WORD >= m[live], n[live] - begin[live], 0)
            live = live[(cost[live] <= most[live]) & (k * WORD < m[live])]
        return cost <= most

    def _piece(self, at: np.ndarray, rows: np.ndarray, to: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits between a piece of ``rows`` characters and the first characters from ``to`` on, ``width`` at most, and how many those are: of equal
        ones the nearest to the piece's length. ``width`` ascends."""
        rank, kinds = self._ranks(at, rows)
        if len(at) > 1 and len(at) * kinds > TABLE:
            half = len(at) // 2
            both = [self._piece(at[x], rows[x], to[x], width[x]) for x in (slice(half), slice(half, None))]
            return np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both])
        base = np.arange(len(at)) * kinds
        places = np.zeros(len(at) * kinds, dtype=np.uint64)
        for i, c in enumerate(np.ascontiguousarray((rank[self.matrix(at, WORD)] * (np.arange(WORD) < rows[:, None])).T)):
            places[base + c] |= ONE << np.uint64(i)
        places[base] = 0
        wide = int(width.max())
        columns = np.ascontiguousarray((rank[self.matrix(to, wide)] + base[:, None])[::-1].T)  # the widest first: those at work are a slice
        rows = rows[::-1]
        bit, score, end = (rows - 1).astype(np.uint64), rows.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        up, down, best = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), dtype=np.uint64), score * 256 + rows
        live = len(at) - np.searchsorted(width, np.arange(wide), "right")
        for j in range(wide):
            x = slice(live[j])
            e, pv, mv = places[columns[j, x]], up[x], down[x]
            xh = (((e & pv) + pv) ^ pv) | e
            rise, fall = mv | ~(xh | pv), pv & xh
            score[x] += ((rise >> bit[x]) & ONE).astype(np.int64) - ((fall >> bit[x]) & ONE).astype(np.int64)
            xv = e | mv
            rise, fall = rise << ONE | ONE, fall << ONE
            up[x], down[x] = fall | ~(xv | rise), rise & xv
            here = score[x] * 256 + np.abs(rows[x] - (j + 1))
            less = here < best[x]
            best[x], end[x] = np.where(less, here, best[x]), np.where(less, j + 1, end[x])
        return (best // 256)[::-1], end[::-1]

    def _band(self, at: np.ndarray, m: np.ndarray, to: np.ndarray, n: np.ndarray, most: np.ndarray, room: np.ndarray, words: int) -> np.ndarray:
        """As ``_columns`` with the diagonals from ``room`` below the first character to ``room`` above the last one, held in ``words`` words. Column j keeps
        rows j - above to j + room, the lowest in the top bit. Rows are counted ``above`` places on, so that all windows of a column begin at the same place;
        where characters stand is made for a word of places when windows reach it."""
        rank, kinds = self._ranks(at, m)
        if len(m) > 1 and len(m) * kinds * (words + 1) > TABLE:
            half = len(m) // 2
            return np.concatenate([self._band(at[x], m[x], to[x], n[x], most[x], room[x], words) for x in (slice(half), slice(half, None))])
        above, out, own = n - m + room, np.zeros(len(m), dtype=bool), np.arange(len(m))
        base = own * kinds

        def places(k: int) -> np.ndarray:
            """The k-th word of the places that each character stands at."""
            row = k * WORD - above[:, None] + np.arange(WORD)
            chars = rank[self.data[np.clip(at[:, None] + row, 0, len(self.data) - 1)]] * ((row >= 0) & (row < m[:, None]))
            word = np.zeros(len(m) * kinds, dtype=np.uint64)
            for i, c in enumerate(np.ascontiguousarray(chars.T)):
                word[base + c] |= ONE << np.uint64(i)
            word[base] = 0
            return word

        held = [places(k) for k in range(words + 1)]
        columns = np.ascontiguousarray(rank[self.matrix(to, int(n.max()))].T)
        low = lambda k, w: np.where(k >= (w + 1) * WORD, ~np.uint64(0), (ONE << np.clip(k - w * WORD, 0, WORD - 1).astype(np.uint64)) - ONE)
        width, last = above + room + 1, words - 1
        full, top = low(width, last), ((width - 1) % WORD).astype(np.uint64)
        up, down = [~low(above, w) for w in range(words)], [np.zeros(len(m), dtype=np.uint64) for _ in range(words)]
        up[last] &= full
        score, bound, turn = room.copy(), most + above, m - room
        for j in range(len(columns)):
            if j and not j % WORD:
                held = [*held[1:], places(j // WORD + words)]
            col = base + columns[j]
            e = [x[col] for x in (held if j % WORD else held[:words])]
            if j % WORD:
                shift, back = np.uint64(j % WORD), np.uint64(WORD - j % WORD)
                e = [e[w] >> shift | e[w + 1] << back for w in range(words)]
            e[last] &= full
            diagonal, carry = [], None
            for w in range(words):
                t = (e[w] & up[w]) + up[w]
                over = t < up[w] if w < last else None
                if carry is not None:
                    t += carry
                    if w < last:
                        over |= t < carry
                carry = None if over is None else over.astype(np.uint64)
                diagonal.append((t ^ up[w]) | e[w] | down[w])
            diagonal[last] &= full
            rise = [down[w] | ~(diagonal[w] | up[w]) for w in range(words)]
            fall = [up[w] & diagonal[w] for w in range(words)]
            # the score goes down the lowest diagonal, then along the last row, which moves up in the window
            turned = turn <= j
            step = (ONE - (diagonal[last] >> top & ONE)).astype(np.int64)
            if turned.any():
                k = np.clip(width - 2 - (j - turn), 0, width - 1)
                word, bit = k // WORD, (k % WORD).astype(np.uint64)
                of = lambda x: ((x[0] if words == 1 else np.array(x)[word, np.arange(len(word))]) >> bit & ONE).astype(np.int64)
                step = np.where(turned, of(rise) - of(fall), step)
            score += step
            ends = np.flatnonzero(n == j + 1)
            out[own[ends]] = score[ends] <= most[ends]
            for w in range(words):
                lower = diagonal[w] >> ONE if w == last else diagonal[w] >> ONE | diagonal[w + 1] << np.uint64(WORD - 1)
                up[w], down[w] = fall[w] | ~(lower | rise[w]), lower & rise[w]
            up[last] &= full
            if j % EVERY == EVERY - 1:
                live = np.flatnonzero((n > j + 1) & np.where(turned, score - (n - 1 - j) <= most, score <= bound))
                if not len(live):
                    break
                if 4 * len(live) < 3 * len(own):
                    held = [x.reshape(-1, kinds)[live].ravel() for x in held]
                    own, at, m, n, most, above, width, score, bound, turn, full, top = (x[live] for x in (own, at, m, n, most, above, width, score, bound, turn, full, top))
                    up, down, columns, base = [x[live] for x in up], [x[live] for x in down], columns[:, live], np.arange(len(live)) * kinds
        return out

    def _ranks(self, at: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, int]:
        """Numbers of the characters that stand in some lines of length ``m`` from ``at`` on, 0 for all others, and how many numbers there are."""
        known = np.zeros(self.high + 1, dtype=bool)
        for k in range(0, int(m.max()), WORD):
            x = at[m > k] + k
            known[self.matrix(x, WORD)[np.arange(WORD) < (m[m > k] - k)[:, None]]] = True
        rank = np.cumsum(known) * known
        return rank, int(rank.max()) + 1

    def _columns(self, at: np.ndarray, m: np.ndarray, to: np.ndarray, n: np.ndarray, most: np.ndarray, words: int) -> np.ndarray:
        """Rows of ``words`` words (all of a's lengths ``m`` need as many) against the columns of the longer lines."""
        rows, inside = self.matrix(at, words * WORD), np.arange(words * WORD) < m[:, None]
        known = np.zeros(self.high + 1, dtype=bool)
        known[rows[inside]] = True
        rank = np.cumsum(known) * known  # 0 for characters that no row has
        kinds = int(rank.max()) + 1
        if len(m) > 1 and len(m) * kinds * words > TABLE:
            half = len(m) // 2
            return np.concatenate([self._columns(at[x], m[x], to[x], n[x], most[x], words) for x in (slice(half), slice(half, None))])
        out, own = np.zeros(len(m), dtype=bool), np.arange(len(m))
        places = np.zeros((len(m), kinds, words), dtype=np.uint64)  # in which rows a character stands
        rows = np.ascontiguousarray((rank[rows] * inside).T)
        for i, row in enumerate(rows):
            places[own, row, i // WORD] |= ONE << np.uint64(i % WORD)
        places[:, 0] = 0
        columns = np.ascontiguousarray(rank[self.matrix(to, int(n.max()))].T)
        bit = ((m - 1) % WORD).astype(np.uint64)
        up, down = np.full((words, len(m)), np.uint64(2**64 - 1)), np.zeros((words, len(m)), dtype=np.uint64)
        score = m.copy()
        for j in range(len(columns)):
            equal = places[own, columns[j]]
            plus, minus = np.ones(len(own), dtype=np.uint64), np.zeros(len(own), dtype=np.uint64)
            for w in range(words):
                e, pv, mv = equal[:, w], up[w], down[w]
                xv = e | mv
                e = e | minus
                xh = (((e & pv) + pv) ^ pv) | e
                rise, fall = mv | ~(xh | pv), pv & xh
                if w == words - 1:
                    score += ((rise >> bit) & ONE).astype(np.int64) - ((fall >> bit) & ONE).astype(np.int64)
                high, low = rise >> np.uint64(WORD - 1), fall >> np.uint64(WORD - 1)
                rise, fall = rise << ONE | plus, fall << ONE | minus
                up[w], down[w] = fall | ~(xv | rise), rise & xv
                plus, minus = high, low
            ends = np.flatnonzero(n == j + 1)
            out[own[ends]] = score[ends] <= most[ends]
            if j % EVERY == EVERY - 1:
                live = np.flatnonzero((n > j + 1) & (score - (n - 1 - j) <= most))  # a column lowers the score by one at best
                if not len(live):
                    break
                if 4 * len(live) < 3 * len(own):
                    own, n, most, bit, score = (x[live] for x in (own, n, most, bit, score))
                    up, down, columns = up[:, live], down[:, live], columns[:, live]
        return out


def _cut(order: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """Cuts places, ordered by ascending width, into batches of bounded size."""
    out, at = [], 0
    while at < len(order):
        k = PAIRS
        while k > 1 and k * int(width[order[min(at + k, len(order)) - 1]]) > CELLS:
            k //= 2
        out.append(order[at:at + k])
        at += k
    return out
