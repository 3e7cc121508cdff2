"""Cover of a polygon by cells of several sizes: inner cells need no test, border cells only the edges that matter inside them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A cell is cut into so many parts a side, and sizes of cells that come out.
PARTS, LEVELS = 8, 3
#: A border cell with up to so many edges is not cut any more.
FEW = 8


def _near(edges: np.ndarray, x0: float, y0: float, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of the edges that cross the cell, of those that lie right of it over its whole height, and of those right of a part of its height."""
    pad = size * 1e-6  # far above rounding, so what holds for the padded cell holds for its points
    x0, y0, x1, y1 = x0 - pad, y0 - pad, x0 + size + pad, y0 + size + pad
    ax, ay, bx, by = edges.T
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    level = (low <= y1) & (high >= y0)
    side = np.stack([(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x in (x0, x1) for y in (y0, y1)])
    after, before = np.minimum(ax, bx) > x1, np.maximum(ax, bx) < x0
    over, under = (side > 0).all(axis=0), (side < 0).all(axis=0)
    cross = level & ~after & ~before & ~over & ~under
    right = level & ~cross & ~before & (after | np.where(by > ay, over, under))
    whole = right & (low <= y0) & (high > y1)
    return cross, whole, right & ~whole


def cells(edges: np.ndarray, cell: float) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(level, column, row, crossings, edges) of the cells that hold any inner point; a cell of a level is ``PARTS ** level`` times ``cell`` wide.
    A point of a cell is inside if ``crossings`` and those of the cell's edges to its right are odd together. Edges are rows x1, y1, x2, y2."""
    edges = edges[np.isfinite(edges).all(axis=1)]
    if not len(edges):
        return
    (lx, ly), (hx, hy) = edges.reshape(-1, 2).min(axis=0), edges.reshape(-1, 2).max(axis=0)
    top = LEVELS - 1
    while cell * PARTS**top < max(hx - lx, hy - ly):
        top += 1
    size = cell * PARTS**top
    todo = [(top, cx, cy, 0, edges) for cx in range(int(lx // size), int(hx // size) + 1) for cy in range(int(ly // size), int(hy // size) + 1)]
    while todo:
        level, cx, cy, base, held = todo.pop()
        size = cell * PARTS**level
        cross, whole, part = _near(held, cx * size, cy * size, size)
        base += int(whole.sum())
        kept = held[cross | part]
        if not cross.any():  # all of its points are alike
            y = (cy + 0.5) * size
            base += int(((held[part, 1] > y) != (held[part, 3] > y)).sum())
            if base % 2 == 0:
                continue
            kept, base = held[:0], 1
        if level < LEVELS and (len(kept) <= FEW or level == 0):
            yield level, cx, cy, base % 2, kept
        else:
            todo += [(level - 1, cx * PARTS + i, cy * PARTS + j, base, kept) for i in range(PARTS) for j in range(PARTS)]
