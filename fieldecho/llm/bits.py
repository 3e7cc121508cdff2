"""Counting the set bits of many 64-bit hashes, position by position."""

from __future__ import annotations

import numpy as np

#: A byte's eight bits, one in each byte of a word: adding such words counts eight positions at once.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
#: So many additions fit into a byte.
FIT = 255


def spread(hashes: np.ndarray) -> np.ndarray:
    """Eight words per hash: one bit in each of their 64 bytes."""
    return SPREAD[hashes.astype("<u8").view(np.uint8)].reshape(-1, 8)


def majority(lanes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of spread hashes (they begin at ``starts``, none is empty) the number whose bits are set in over half of them."""
    sizes = np.diff(np.append(starts, len(lanes)))
    pieces = -(-sizes // FIT)
    first = np.append(0, np.cumsum(pieces)[:-1])
    cuts = np.repeat(starts, pieces) + FIT * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    ones = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64)
    if len(cuts) > len(starts):
        ones = np.add.reduceat(ones.astype(np.int64), first, axis=0)
    return np.packbits(2 * ones.astype(np.int64) > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
