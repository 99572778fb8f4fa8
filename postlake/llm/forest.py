"""A random forest on numpy: histogram splits by Gini impurity, bootstrapped rows, random features."""

from __future__ import annotations

import numpy as np

BINS = 32


class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), bin edge, left child (right is the next), share."""

    def __init__(self, edges: np.ndarray, trees: list[tuple[np.ndarray, ...]]):
        self.edges, self.trees = edges, trees

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        if not len(x):
            return total
        b = _binned(x, self.edges)
        rows = np.arange(len(x))
        for feature, cut, left, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                right = b[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(f < 0, node, left[node] + right)
            total += share[node]
        return total / len(self.trees)


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(x.shape[1])], axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 10, least: int = 3, seed: int = 5) -> Forest:
    """Fits 0/1 labels; ties between splits go to the lower feature and bin."""
    rng = np.random.default_rng(seed)
    n, width = x.shape
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T.copy()
    b = _binned(x, edges)
    tries = max(1, int(np.ceil(np.sqrt(width))) + 1)
    out = []
    for _ in range(trees):
        feature, cut, left, share = [-1], [0], [0], [0.0]
        work = [(0, rng.integers(0, n, n), 0)]
        while work:
            node, rows, level = work.pop()
            own = y[rows]
            share[node] = float(own.mean())
            if level == depth or len(rows) < 2 * least or share[node] in (0.0, 1.0):
                continue
            best = None
            for f in np.sort(rng.choice(width, tries, replace=False)):
                v = b[rows, f]
                all_ = np.cumsum(np.bincount(v, minlength=BINS))[:-1].astype(float)
                ones = np.cumsum(np.bincount(v, own, BINS))[:-1]
                rest, more = len(rows) - all_, own.sum() - ones
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = ones * (all_ - ones) / all_ + more * (rest - more) / rest
                score[(all_ < least) | (rest < least)] = np.inf
                k = int(np.argmin(score))
                if np.isfinite(score[k]) and (best is None or score[k] < best[0]):
                    best = (score[k], int(f), k)
            if best is None:
                continue
            _, f, k = best
            feature[node], cut[node], left[node] = f, k, len(feature)
            right = b[rows, f] > k
            for side in (rows[~right], rows[right]):
                work.append((len(feature), side, level + 1))
                feature.append(-1)
                cut.append(0)
                left.append(0)
                share.append(0.0)
        out.append((np.array(feature), np.array(cut), np.array(left), np.array(share)))
    return Forest(edges, out)
