"""A small gradient boosting machine: logistic loss, shallow trees over binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Tree = list[tuple[int, float, int, int, float]]


@dataclass
class Boosted:
    """Each tree is a list of nodes (feature, limit, left, right, value); a leaf has feature -1."""

    base: float
    trees: list[Tree]
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            f = np.array([n[0] for n in tree])
            lim, left, right, val = (np.array([n[k] for n in tree]) for k in range(1, 5))
            while len(go := np.flatnonzero(f[at] >= 0)):
                here = at[go]
                at[go] = np.where(x[go, f[here]] <= lim[here], left[here], right[here]).astype(int)
            out += val[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, limits: list[np.ndarray], depth: int, rate: float, ridge: float) -> Tree:
    tree: Tree = []

    def node(own: np.ndarray, d: int) -> int:
        k = len(tree)
        tree.append((-1, 0.0, 0, 0, rate * float(g[own].sum() / (h[own].sum() + ridge))))
        best, gs, hs = (1e-6, -1, 0.0), g[own].sum(), h[own].sum()
        if d and len(own) >= 8:
            for f, cuts in enumerate(limits):
                if not len(cuts):
                    continue
                below = x[own, f][:, None] <= cuts[None]
                gl, hl = g[own] @ below, h[own] @ below
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                c = int(np.argmax(gain))
                if gain[c] > best[0] and 0 < below[:, c].sum() < len(own):
                    best = (float(gain[c]), f, float(cuts[c]))
        if best[1] >= 0:
            low = x[own, best[1]] <= best[2]
            left, right = node(own[low], d - 1), node(own[~low], d - 1)
            tree[k] = (best[1], best[2], left, right, 0.0)
        return k

    node(np.arange(len(g)), depth)
    return tree


def boost(x: np.ndarray, y: np.ndarray, fit: np.ndarray, hold: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Trained on the rows of mask fit; slope and shift of the probability are fitted on those of hold (Platt)."""
    fit, hold = np.flatnonzero(fit), np.flatnonzero(hold)
    limits = []
    for f in range(x.shape[1]):
        v = np.unique(x[fit, f])
        limits.append(np.unique(np.quantile((v[1:] + v[:-1]) / 2, np.linspace(0, 1, 12))) if len(v) > 1 else np.zeros(0))
    mean = y[fit].mean()
    model = Boosted(float(np.log(mean / (1 - mean))), [])
    raw = np.full(len(fit), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(x[fit], y[fit] - p, p * (1 - p), limits, depth, rate, ridge)
        model.trees.append(tree)
        raw += Boosted(0.0, [tree]).raw(x[fit])
    raw = model.raw(x[hold])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(model.slope * raw + model.shift, -30, 30)))
        e = y[hold] - p
        model.slope += 0.05 * float((e * raw).mean() - 1e-3 * model.slope)
        model.shift += 0.5 * float(e.mean())
    return model
