"""Keys of the Hilbert curve in numpy."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of n x d integer cells of ``bits`` bits; d * bits is at most 62.

    From the highest bit down, a set bit of a coordinate inverts the lower bits of the first one, and a clear bit
    swaps them with the first one's; a Gray code over the coordinates then gives the digits of the position.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (np.int64(1) << level) - 1
        for i in range(d):
            bit = (x[i] >> level) & 1 == 1
            swap = np.where(bit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(bit, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> level) & 1 == 1, (np.int64(1) << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> level) & 1
    return key
