"""A small random forest of classification trees on numpy arrays."""

from __future__ import annotations

import numpy as np


class Forest:
    """Bagged Gini trees over quantile-binned features; trees are flat arrays, so predicting is vectorised and pickling cheap."""

    def __init__(self, trees: int = 40, depth: int = 9, leaf: int = 4, bins: int = 64, seed: int = 5):
        self.trees, self.depth, self.leaf, self.bins, self.seed = trees, depth, leaf, bins, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        n, p = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(p)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        tried = max(1, round(np.sqrt(p)))
        self.nodes = []
        for _ in range(self.trees):
            rows = rng.integers(0, n, n)
            tree: list[list[float]] = []  # feature (-1: leaf), edge, left, right, share of positives
            todo = [(rows, 0, self._new(tree))]
            while todo:
                at, depth, node = todo.pop()
                share = y[at].mean()
                tree[node][4] = share
                if depth == self.depth or len(at) < 2 * self.leaf or share in (0.0, 1.0):
                    continue
                best = (0.0, -1, -1)
                for j in rng.permutation(p)[:tried]:
                    total = np.bincount(binned[at, j], minlength=self.bins + 1).cumsum()[:-1]
                    ones = np.bincount(binned[at, j], weights=y[at], minlength=self.bins + 1).cumsum()[:-1]
                    rest, rest_ones = len(at) - total, y[at].sum() - ones
                    fits = (total >= self.leaf) & (rest >= self.leaf)
                    if not fits.any():
                        continue
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = ones * ones / total + rest_ones * rest_ones / rest
                    gain = np.where(fits, gain, -1.0) - len(at) * share * share
                    if gain.max() > best[0] + 1e-9:
                        best = (float(gain.max()), int(j), int(gain.argmax()))
                if best[1] < 0:
                    continue
                left = binned[at, best[1]] <= best[2]
                a, b = self._new(tree), self._new(tree)
                tree[node][:4] = best[1], best[2], a, b
                todo += [(at[left], depth + 1, a), (at[~left], depth + 1, b)]
            self.nodes.append(np.array(tree))
        return self

    @staticmethod
    def _new(tree: list[list[float]]) -> int:
        tree.append([-1, 0, 0, 0, 0.0])
        return len(tree) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees."""
        if not len(x):
            return np.zeros(0)
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for tree in self.nodes:
            at = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                feature = tree[at, 0].astype(int)
                inner = feature >= 0
                go_left = binned[rows, np.maximum(feature, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(go_left, tree[at, 2], tree[at, 3]).astype(int), at)
            out += tree[at, 4]
        return out / len(self.nodes)
