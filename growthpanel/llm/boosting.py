"""Gradient-boosted trees for two classes, on binned features of a bounded table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROUNDS, DEPTH, RATE, BINS, RIDGE, LEAST = 60, 4, 0.15, 32, 1.0, 5.0


@dataclass
class Trees:
    """Complete trees of one depth: node k has the children 2 k + 1 and 2 k + 2; a row goes right where it is above."""

    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    base: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for every row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = (self.leaf.shape[1]).bit_length() - 1
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > above[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Trees grown level by level on sums of gradients per bin; a node without a worthwhile split passes all to the left."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    mean = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    base = np.log(mean / (1 - mean))
    f, inner, leaves = np.full(n, base), 2**depth - 1, 2**depth
    trees = Trees(np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves)), float(base))
    offset = np.arange(m) * BINS
    for t in range(rounds):
        p = 1 / (1 + np.exp(-f))
        gradient, hessian = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cells = ((at - first)[:, None] * (m * BINS) + offset + binned).ravel()
            shape = (width, m, BINS)
            g = np.bincount(cells, np.repeat(gradient, m), width * m * BINS).reshape(shape).cumsum(2)
            h = np.bincount(cells, np.repeat(hessian, m), width * m * BINS).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(h < LEAST / 4) | (h_all - h < LEAST / 4)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    trees.feature[t, first + k], trees.above[t, first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), trees.feature[t, at]] > trees.above[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        trees.leaf[t] = -RATE * g / (h + RIDGE)
        f += trees.leaf[t][leaf]
    return trees
