"""A generalised additive model with pairwise terms, fitted by cyclic boosting.

Each feature is cut into bins. Training goes round the features; in its turn a
feature gets a small tree on the current residuals, added to its lookup table
with a low learning rate, so no feature runs ahead of the others. Then the
pairs of features that explain most of what is left get two-way tables in the
same way. A score is the sum of one table entry per feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


@dataclass
class Gam:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins):
            total += table[b]
        coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points half-way between neighbouring values, near the quantiles."""
    known = np.unique(values)
    if len(known) < 2:
        return np.empty(0)
    if len(known) > bins:
        at = np.unique(np.searchsorted(known, np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])))
        at = at[(at > 0) & (at < len(known))]
        at = at if len(at) else np.array([len(known) // 2])
    else:
        at = np.arange(1, len(known))
    return (known[at - 1] + known[at]) / 2


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, prior: float) -> np.ndarray:
    """Leaf values per bin of a tree that splits the ordered bins best first."""
    g, h = np.concatenate(([0.0], np.cumsum(gradient))), np.concatenate(([0.0], np.cumsum(weight)))

    def best(low: int, high: int):
        if high - low < 2:
            return (0.0, 0, low, high)
        at = np.arange(low + 1, high)
        gl, hl, gr, hr = g[at] - g[low], h[at] - h[low], g[high] - g[at], h[high] - h[at]
        gain = gl**2 / (hl + prior) + gr**2 / (hr + prior) - (g[high] - g[low]) ** 2 / (h[high] - h[low] + prior)
        k = int(np.argmax(gain))
        return (float(gain[k]), int(at[k]), low, high)

    parts = [best(0, len(gradient))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][0])
        gain, at, low, high = parts[k]
        if gain <= 1e-12:
            break
        parts[k : k + 1] = [best(low, at), best(at, high)]
    out = np.empty(len(gradient))
    for _, _, low, high in parts:
        out[low:high] = (g[high] - g[low]) / (h[high] - h[low] + prior)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, leaves: int = 3,
        pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 60, prior: float = 2.0) -> Gam:
    """``x`` (rows, features), ``y`` 0 or 1. Without both labels the score is
    the smoothed share of label 1. Deterministic."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    model = Gam([_quantiles(x[:, j], bins) if n else np.empty(0) for j in range(width)], float(np.log(share / (1 - share))), [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if n == 0 or y.min() == y.max():
        return model
    codes = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    margin = np.full(n, model.base)

    def residuals():
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, code in enumerate(codes):
            size = len(model.tables[j])
            if size > 1:
                r, h = residuals()
                step = rate * _tree(np.bincount(code, r, size), np.bincount(code, h, size), leaves, prior)
                model.tables[j] += step
                margin += step[code]
    model.pair_cuts = [_quantiles(x[:, j], pair_bins) for j in range(width)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]
    sizes = [len(c) + 1 for c in model.pair_cuts]
    r, h = residuals()
    gains = []
    for i, j in combinations(range(width), 2):
        if sizes[i] > 1 and sizes[j] > 1:
            cell = coarse[i] * sizes[j] + coarse[j]
            g, w = np.bincount(cell, r, sizes[i] * sizes[j]), np.bincount(cell, h, sizes[i] * sizes[j])
            gains.append((float((g**2 / (w + prior)).sum()), i, j))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1], t[2]))[:pairs]
    model.pairs = [(i, j) for _, i, j in chosen]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    cells = [coarse[i] * sizes[j] + coarse[j] for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, cell in enumerate(cells):
            i, j = model.pairs[k]
            r, h = residuals()
            step = rate * np.bincount(cell, r, sizes[i] * sizes[j]) / (np.bincount(cell, h, sizes[i] * sizes[j]) + prior)
            model.pair_tables[k] += step.reshape(sizes[i], sizes[j])
            margin += step[cell]
    return model
