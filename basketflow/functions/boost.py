"""Boosted trees on binned columns, in numpy: for samples of a bounded size that one task holds."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting; missing values are a bin of their own, below all others; a leaf's slopes add up to `least` or more."""

    def __init__(self, rounds: int = 30, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.where(np.isnan(c), 0, np.searchsorted(e, c, "right") + 1) for c, e in zip(x.T, self.edges, strict=True)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        x = np.asarray(x, float)
        self.edges = [np.unique(np.quantile(k, np.linspace(0, 1, self.bins)[1:-1])) if len(k := c[~np.isnan(c)]) else np.zeros(0) for c in x.T]
        return self.grow(self._codes(x), y)

    def grow(self, codes: np.ndarray, y: np.ndarray, n: np.ndarray | float = 1.0) -> Trees:
        """Fit to rows that are binned already, codes from 0 to bins; n: how many equal rows each stands for."""
        d, width, n = codes.shape[1], self.bins + 1, np.broadcast_to(np.asarray(n, float), len(y))
        small = np.int16 if width << self.depth < 1 << 15 else np.int64
        columns = np.ascontiguousarray(codes.T.astype(small))  # counted column by column, so that a column's bins stay in the cache
        varied = [i for i, c in enumerate(columns) if len(c) and c.min() < c.max()]
        self.start = float(np.log(((n * y).sum() + 1) / (n.sum() - (n * y).sum() + 1)))
        f, self.trees, self.gain = np.full(len(y), self.start), [], np.zeros(d)
        rows = np.arange(len(y))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            up, slope = n * (y - p), n * p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                k = 1 << level
                # of two children the smaller one is counted, the other is what is left of their parent
                half = np.bincount(node, minlength=k).reshape(-1, 2).argmin(1) if level else np.zeros(1, np.int64)
                at = np.flatnonzero(half[node >> 1] == node & 1) if level else slice(None)
                base, u, s = ((node[at] >> 1) * width).astype(small) if level else np.zeros(len(y), small), up[at], slope[at]
                counted = np.zeros((2, len(half), d, width))
                for i in varied:
                    place = base + columns[i][at]
                    counted[:, :, i] = [np.bincount(place, w, len(half) * width).reshape(-1, width) for w in (u, s)]
                if level:
                    both = np.empty((2, len(half), 2, d, width))
                    each = np.arange(len(half))
                    both[:, each, half], both[:, each, 1 - half] = counted, parent - counted
                    counted = both.reshape(2, k, d, width)
                parent = counted
                g, h = counted.cumsum(3)
                best = lambda a, b: a * a / (b + self.ridge)
                rise = best(g, h) + best(g[..., -1:] - g, h[..., -1:] - h) - best(g[..., -1:], h[..., -1:])
                rise[(h < self.least) | (h[..., -1:] - h < self.least)] = 0
                rise = rise.reshape(k, -1)
                at = rise.argmax(1)
                won = rise[np.arange(k), at]
                column, cut = at // width, np.where(won > 1e-9, at % width, width)
                np.add.at(self.gain, column, np.where(won > 1e-9, won, 0))
                splits.append((column, cut))
                node = 2 * node + (columns[column[node], rows] > cut[node])
            k = 1 << self.depth
            leaf = self.rate * np.bincount(node, up, k) / (np.bincount(node, slope, k) + self.ridge)
            self.trees.append((splits, leaf))
            f += leaf[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.apply(self._codes(np.asarray(x, float)))

    def apply(self, codes: np.ndarray) -> np.ndarray:
        """Scores of binned rows."""
        rows, f = np.arange(len(codes)), np.full(len(codes), self.start)
        for splits, leaf in self.trees:
            node = np.zeros(len(codes), np.int64)
            for column, cut in splits:
                node = 2 * node + (codes[rows, column[node]] > cut[node])
            f += leaf[node]
        return f
