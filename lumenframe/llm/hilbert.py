"""Keys along a Hilbert curve."""

from __future__ import annotations

import numpy as np


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the curve of each row of whole coordinates in [0, 2**bits).

    Coordinates are turned, from the highest bit down, into the frame of the sub-cube that they lie
    in; the Gray code of the turned bits, read across the dimensions, is the place.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            upper = (x[d] & bit) > 0
            swap = np.where(upper, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key * 2 + ((x[d] >> level) & 1)
    return key
