"""Rolling order statistics of one ordered series, streamed in pieces."""

from bisect import bisect_left, insort

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

_CHUNK = 2_048


class RollingMedian:
    """Exact median of the last ``window`` values, kept in a sorted list: a search and a short move per row.

    Missing (NaN) values take up a place in the window but do not count.
    """

    def __init__(self, window: int, least: int):
        self.window, self.least = window, least
        self._sorted: list[float] = []
        self._recent: list[float] = []

    def of(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), np.nan)
        held, window, least = self._sorted, self.window, self.least
        line = self._recent + values.tolist()
        start = len(self._recent)
        for i in range(start, len(line)):
            x = line[i]
            if x == x:
                insort(held, x)
            if i >= window:
                old = line[i - window]
                if old == old:
                    del held[bisect_left(held, old)]
            n = len(held)
            if n >= least and n:
                low = held[(n - 1) // 2]
                out[i - start] = low + (held[n // 2] - low) * 0.5
        self._recent = line[-window:]
        return out


class RollingDeviation:
    """Sample deviation of the last ``window`` values, each window around its own mean (no running sums that drift)."""

    def __init__(self, window: int, least: int):
        self.window, self.least = window, max(least, 2)
        self._recent = np.full(window - 1, np.nan)

    def of(self, values: np.ndarray) -> np.ndarray:
        line = np.concatenate([self._recent, values])
        out = np.full(len(values), np.nan)
        for start in range(0, len(values), _CHUNK):
            piece = line[start : start + _CHUNK + self.window - 1]
            there = ~np.isnan(piece)
            windows = sliding_window_view(np.where(there, piece, 0.0), self.window)
            n = sliding_window_view(there, self.window).sum(axis=1)
            enough = n >= self.least
            mean = windows.sum(axis=1) / np.maximum(n, 1)
            apart = windows - mean[:, None]
            if not there.all():
                apart = apart * sliding_window_view(there, self.window)
            spread = np.sqrt(np.einsum("ij,ij->i", apart, apart) / np.maximum(n - 1, 1))
            out[start : start + len(n)] = np.where(enough, spread, np.nan)
        self._recent = line[len(line) - self.window + 1 :]
        return out
