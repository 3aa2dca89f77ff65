"""A small ensemble of decision trees with calibrated confidence, in numpy."""

from __future__ import annotations

import numpy as np


class Forest:
    """Bagged classification trees over binned features. The confidence of the winning class is calibrated on out-of-bag rows by isotonic regression."""

    def __init__(self, edges: list[np.ndarray], trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], classes: int, steps: tuple[np.ndarray, np.ndarray]):
        self.edges, self.trees, self.classes, self.steps = edges, trees, classes, steps

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, classes: int, trees: int = 30, depth: int = 7, bins: int = 32, seed: int = 7) -> Forest:
        if not len(y):
            return cls([np.zeros(0)] * x.shape[1], [], classes, (np.array([0.0]), np.array([0.0])))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = _binned(x, edges)
        rng = np.random.default_rng(seed)
        grown, votes = [], np.zeros((len(y), classes))
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            tree = _grow(b[rows], y[rows], classes, depth, bins, rng)
            grown.append(tree)
            out = np.ones(len(y), bool)
            out[rows] = False
            votes[out] += _walk(tree, b[out])
        seen = votes.sum(1) > 0
        p = votes[seen] / votes[seen].sum(1, keepdims=True)
        sure, right = p.max(1), p.argmax(1) == y[seen]
        return cls(edges, grown, classes, _isotonic(sure, right.astype(float)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and calibrated confidence of each row."""
        if not self.trees:
            return np.zeros(len(x), np.int64), np.zeros(len(x))
        b = _binned(x, self.edges)
        p = sum(_walk(t, b) for t in self.trees) / len(self.trees)
        return p.argmax(1), np.interp(p.max(1), *self.steps)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)


def _grow(b: np.ndarray, y: np.ndarray, classes: int, depth: int, bins: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 for a leaf), threshold bin, and class shares of each node; the children of node k are 2k+1 and 2k+2."""
    n = (1 << (depth + 1)) - 1
    feature, cut, share = np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, classes))
    at = np.zeros(len(y), np.int64)
    for node in range(n):
        rows = np.flatnonzero(at == node)
        if not len(rows):
            continue
        count = np.bincount(y[rows], minlength=classes).astype(float)
        share[node] = (count + 0.1) / (count.sum() + 0.1 * classes)
        if 2 * node + 2 >= n or len(rows) < 10 or count.max() == len(rows):
            continue
        best = (0.0, -1, 0)
        gini = len(rows) - (count**2).sum() / len(rows)
        for f in rng.permutation(b.shape[1])[: max(2, b.shape[1] // 2 + 1)]:
            table = np.bincount(b[rows, f] * classes + y[rows], minlength=(bins + 1) * classes).reshape(-1, classes).cumsum(0)
            left = table[:-1]
            right = table[-1] - left
            nl, nr = left.sum(1), right.sum(1)
            ok = (nl > 2) & (nr > 2)
            if not ok.any():
                continue
            rest = np.where(ok, len(rows) - (left**2).sum(1) / np.maximum(nl, 1) - (right**2).sum(1) / np.maximum(nr, 1), np.inf)
            k = int(rest.argmin())
            if gini - rest[k] > best[0] + 1e-9:
                best = (gini - rest[k], int(f), k)
        if best[1] >= 0:
            feature[node], cut[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
    return feature, cut, share


def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    feature, cut, share = tree
    at = np.zeros(len(b), np.int64)
    rows = np.arange(len(b))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return share[at]
        at = np.where(inner, 2 * at + 1 + (b[rows, np.maximum(f, 0)] > cut[at]), at)


def _isotonic(score: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: scores and non-decreasing accuracy."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, r in zip(score[order], right[order]):
        blocks.append([r, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            r2, n2, s2 = blocks.pop()
            blocks[-1][0] += r2
            blocks[-1][1] += n2
            blocks[-1][2] = s2
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
