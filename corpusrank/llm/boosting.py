"""Gradient-boosted regression trees for a binary label, small enough to train on the driver and send to every task."""

from __future__ import annotations

import numpy as np

BINS = 16


class BoostedTrees:
    """Logistic boosting with trees of fixed depth over quantile bins; ``calibrate`` sets the score's threshold for each group of rows."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.thresholds = 0.0, {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        self.base = float(np.log(mean / (1 - mean)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])  # v <= cut k: code <= k
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(codes, cuts, p - y, p * (1 - p))
            self.trees.append(tree)
            raw += tree[2][leaf]
        return self

    def _grow(self, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[tuple, np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, value = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(grad), np.int64)
        for level in range(self.depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            split = np.full((width, 2), -1)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                cell = (node - first) * (len(c) + 1) + codes[f]
                g = np.bincount(cell, grad, width * (len(c) + 1)).reshape(width, -1).cumsum(1)
                h = np.bincount(cell, hess, width * (len(c) + 1)).reshape(width, -1).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best + 1e-9
                best = np.where(better, top, best)
                split[better] = np.stack([np.full(width, f), k], 1)[better]
            for n in range(width):
                if split[n, 0] >= 0:
                    feature[first + n], value[first + n] = split[n, 0], cuts[split[n, 0]][split[n, 1]]
            at = node - first
            right = (split[at, 0] >= 0) & (codes[np.maximum(split[at, 0], 0), np.arange(len(node))] > split[at, 1])
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return (feature, value, -self.rate * g / (h + self.ridge)), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label."""
        x = np.asarray(x, float)
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, value, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > value[node])
            raw += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-raw))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float, groups: np.ndarray) -> BoostedTrees:
        """``thresholds``: for each group the lowest one (0.5 at least) whose selection on held-out rows, and that of every higher one, keeps the precision."""
        score, y = self.score(x), np.asarray(y, float)
        for group in np.unique(groups).tolist():
            own = np.flatnonzero(groups == group)
            order = own[np.argsort(-score[own], kind="stable")]
            right = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(np.minimum.accumulate(right) >= precision)
            self.thresholds[group] = max(0.5, float(score[order[good[-1]]])) if len(good) else 2.0
        return self
