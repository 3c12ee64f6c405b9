"""Gradient-boosted trees with monotonic constraints, flattened into node arrays. Numpy only; for bounded samples and for use inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class BoostParams:
    trees: int = 60
    depth: int = 4
    rate: float = 0.2
    #: Candidate cuts per feature, at quantiles of the sample.
    cuts: int = 64
    penalty: float = 1.0
    #: Least sum of second derivatives in a child.
    least: float = 1.0


@dataclass(frozen=True)
class Forest:
    """All trees' nodes one after another. A leaf is its own child on both sides, so every row takes the same number of steps."""

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The raw score of every row of ``x`` (rows, features): all rows go down all trees together, one level a step."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.low[at], self.high[at])
        return self.base + self.value[at].sum(axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(x)))


def _objective(g, h, w, penalty):
    return g * w + 0.5 * (h + penalty) * w * w


class _Nodes:
    def __init__(self):
        self.feature, self.threshold, self.low, self.high, self.value, self.bounds = [], [], [], [], [], []

    def leaf(self, value: float, bounds: tuple[float, float]) -> int:
        n = len(self.value)
        for column, v in ((self.feature, 0), (self.threshold, np.inf), (self.low, n), (self.high, n), (self.value, value), (self.bounds, bounds)):
            column.append(v)
        return n


def _best_cut(g: np.ndarray, h: np.ndarray, cuts: int, sign: int, bounds: tuple[float, float], p: BoostParams):
    """(gain, cut, value below, value above) of the best allowed cut of one node and feature, from sums per bin."""
    if not cuts:
        return None
    gl, hl = np.cumsum(g)[:cuts], np.cumsum(h)[:cuts]
    gr, hr = g.sum() - gl, h.sum() - hl
    wl, wr = (np.clip(-a / (b + p.penalty), *bounds) for a, b in ((gl, hl), (gr, hr)))
    whole = np.clip(-g.sum() / (h.sum() + p.penalty), *bounds)
    gain = _objective(g.sum(), h.sum(), whole, p.penalty) - _objective(gl, hl, wl, p.penalty) - _objective(gr, hr, wr, p.penalty)
    gain[(hl < p.least) | (hr < p.least) | (sign * (wr - wl) < 0)] = -np.inf
    k = int(gain.argmax())
    return (float(gain[k]), k, float(wl[k]), float(wr[k])) if gain[k] > 1e-9 else None


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, signs: tuple[int, ...], p: BoostParams = BoostParams()) -> Forest:
    """Log loss of ``y`` (0 or 1). ``signs``: per feature, -1 if the score must not rise with it, 1 if it must not fall, 0 if free.

    A cut against a feature's sign is not taken, and what is below and above a cut that follows one is bounded by the middle of the two
    values; so no later cut can cross it, every tree is monotonic and their sum too.
    """
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, p.cuts + 2)[1:-1], method="inverted_cdf")) for column in x.T]
    edges = [e[e < column.max()] for e, column in zip(edges, x.T)]
    bins = [np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)]
    width = max(len(e) for e in edges) + 1
    share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes, roots = _Nodes(), []
    for _ in range(p.trees):
        chance = 1.0 / (1.0 + np.exp(-margin))
        g, h = weight * (chance - y), weight * chance * (1 - chance)
        root = nodes.leaf(0.0, (-np.inf, np.inf))
        roots.append(root)
        at, level = np.full(len(y), root), [root]
        for _ in range(p.depth):
            slot = np.full(len(nodes.value), -1)
            slot[level] = np.arange(len(level))
            held = np.flatnonzero(slot[at] >= 0)
            place = slot[at[held]] * width
            sums = [
                [np.bincount(place + b[held], s[held], minlength=len(level) * width).reshape(-1, width) for s in (g, h)] for b in bins
            ]
            following = []
            for i, node in enumerate(level):
                tried = [(_best_cut(sg[i], sh[i], len(edges[f]), signs[f], nodes.bounds[node], p), f) for f, (sg, sh) in enumerate(sums)]
                tried = [(c, f) for c, f in tried if c is not None]
                if not tried:
                    continue
                (_, cut, below, above), f = max(tried, key=lambda t: (t[0][0], -t[1]))
                low, high = nodes.bounds[node]
                middle = (below + above) / 2
                lows, highs = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
                nodes.feature[node], nodes.threshold[node] = f, float(edges[f][cut])
                nodes.low[node], nodes.high[node] = nodes.leaf(below, lows), nodes.leaf(above, highs)
                here = at == node
                at[here] = np.where(bins[f][here] <= cut, nodes.low[node], nodes.high[node])
                following += [nodes.low[node], nodes.high[node]]
            level = following
            if not level:
                break
        margin += p.rate * np.array(nodes.value)[at]
    return Forest(
        base, p.depth, np.array(roots), np.array(nodes.feature, np.int64), np.array(nodes.threshold), np.array(nodes.low), np.array(nodes.high),
        p.rate * np.array(nodes.value),
    )
