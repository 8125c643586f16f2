"""Small models fitted on the driver from a bounded sample of labelled rows: boosted trees, logistic and isotonic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, limit: int) -> DataFrame:
    """(doc_id, text, y, weight) of at most `limit` documents of each label, whole, the same ones each time.

    The choice is by a hash of doc_id among all labels that `learn` (a condition on doc_id) allows; weight undoes the
    difference in sampling. The chosen labels are 2 * limit rows at most, so they may be broadcast. Where an id repeats, the
    text with the smallest hash stands for it, so that one hot id cannot swamp the sample.
    """
    clean = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = dict(clean.groupBy("y").count().collect())
    parts = []
    for y, n in counts.items():
        one = clean.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        parts.append(one.withColumn("weight", F.lit(max(1.0, n / limit))))
    if not parts:
        return docs.select("doc_id", "text", F.lit(0).alias("y"), F.lit(1.0).alias("weight")).limit(0)
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "y", "weight").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "t.text", "y", "weight")


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients (intercept last) of a ridge logistic regression on standardised columns, folded back to raw ones."""
    mean, std = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    b = np.zeros(z.shape[1])
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (w * (p - y)) + ridge * w.sum() * np.append(b[:-1], 0)
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.eye(len(b)) * (ridge * w.sum() + 1e-6)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = b[:-1] / std
    return np.append(raw, b[-1] - raw @ mean)


class Trees:
    """Gradient-boosted trees for the logistic loss over histogram bins of dense features."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 5.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int, float]]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        if not len(x):
            return self
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
        b = self._binned(x)
        rate = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, where = self._grow(b, w * (p - y), w * p * (1 - p))
            self.trees.append(tree)
            f += np.array([t[2] for t in tree])[where]
        return self

    def _grow(self, b, g, h):
        """Nodes in heap order: (feature, bin) sends larger bins right, feature -1 is a leaf; (…, value)."""
        size = 2 ** (self.depth + 1) - 1
        tree = [(-1, 0, 0.0)] * size
        where = np.zeros(len(g), np.int64)
        for node in range(size):
            at = np.flatnonzero(where == node)
            if not len(at):
                continue
            gs, hs = g[at].sum(), h[at].sum()
            tree[node] = (-1, 0, float(-self.rate * gs / (hs + self.ridge)))
            if node >= 2**self.depth - 1:
                continue
            best = (1e-6, -1, 0)
            for k in range(b.shape[1]):
                n = len(self.edges[k]) + 1
                gl = np.cumsum(np.bincount(b[at, k], g[at], n))[:-1]
                hl = np.cumsum(np.bincount(b[at, k], h[at], n))[:-1]
                cl = np.cumsum(np.bincount(b[at, k], minlength=n))[:-1]
                gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(cl < self.least) | (len(at) - cl < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
            if best[1] >= 0:
                tree[node] = (best[1], best[2], 0.0)
                where[at] = 2 * node + 1 + (b[at, best[1]] > best[2])
        return tree, where

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        f = np.full(len(x), self.start)
        if not self.trees:
            return f
        b = self._binned(x)
        for tree in self.trees:
            feature, cut, value = (np.array(v) for v in zip(*tree, strict=True))
            where = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = feature[where]
                go = k >= 0
                where = np.where(go, 2 * where + 1 + (b[np.arange(len(x)), np.maximum(k, 0)] > cut[where]), where)
            f += value[where]
        return f


class Isotonic:
    """Non-decreasing map from scores to rates (pool adjacent violators), linear between the pools' centres."""

    def fit(self, s: np.ndarray, y: np.ndarray, w: np.ndarray) -> Isotonic:
        order = np.argsort(s, kind="stable")
        pools: list[list[float]] = []  # weight, weighted sum of y, weighted sum of s
        for a, b, c in zip(s[order], y[order], w[order], strict=True):
            pools.append([c, b * c, a * c])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                top = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], top, strict=True)]
        self.x = np.array([p[2] / p[0] for p in pools]) if pools else np.zeros(1)
        self.y = np.array([p[1] / p[0] for p in pools]) if pools else np.full(1, 0.5)
        return self

    def predict(self, s: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(s, self.x, self.y), 0.0, 1.0)
