"""Order statistics of sliding windows over an array, for long windows.

The values' ranks are sorted bit by bit from the top, stably, and for every bit the zeros are counted up to
each position. A window of consecutive positions stays one range at every bit, so the counts at its two ends
say on which side of the bit its k-th smallest value lies. All windows go down together: time grows with
values times bits of their number, whatever the length of a window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def sliding_smallest(values: np.ndarray, length: int, places: Sequence[int]) -> np.ndarray:
    """(places, windows): the value at each place, from 0, among every `length` consecutive ones in rising order."""
    count = len(values) - length + 1
    if count <= 0:
        return np.empty((len(places), 0))
    known, rank = np.unique(values, return_inverse=True)
    begin = np.tile(np.arange(count), (len(places), 1))
    end = begin + length
    rest = np.repeat(np.asarray(places)[:, None], count, axis=1)
    found = np.zeros_like(rest)
    for bit in range(max(len(known) - 1, 0).bit_length() - 1, -1, -1):
        upper = (rank >> bit) & 1 == 1
        zeros = np.concatenate([[0], np.cumsum(~upper)])
        first, last = zeros[begin], zeros[end]
        above = rest >= last - first
        rest = np.where(above, rest - (last - first), rest)
        begin = np.where(above, zeros[-1] + begin - first, first)
        end = np.where(above, zeros[-1] + end - last, last)
        found += above.astype(found.dtype) << bit
        rank = np.concatenate([rank[~upper], rank[upper]])
    return known[found]


def sliding_percentiles(values: np.ndarray, length: int, percents: Sequence[float]) -> np.ndarray:
    """(percents, values): interpolated percentiles of the last `length` values; NaN before there are so many."""
    at = [p / 100.0 * (length - 1) for p in percents]
    below = [int(a) for a in at]
    places = sorted({x for b in below for x in (b, min(b + 1, length - 1))})
    told = sliding_smallest(values, length, places)
    out = np.full((len(percents), len(values)), np.nan)
    for i, (a, b) in enumerate(zip(at, below)):
        under, over = told[places.index(b)], told[places.index(min(b + 1, length - 1))]
        out[i, length - 1:] = under + (over - under) * (a - b)
    return out
