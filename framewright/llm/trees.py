"""Gradient-boosted trees for two classes, with monotonic constraints: small, exact about order, plain numpy.

Trees grow level by level on binned features. A feature may be held to a direction: a split against it
is refused, and the children's scores are kept on their sides of the middle between them, so the whole forest
is monotonic in that feature. A fitted forest is flat node arrays; scoring walks all rows through a
tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """feature (-1 at leaves), threshold, left, right, value: all trees' nodes; roots: where trees begin."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                at = self.feature[node]
                inner = at >= 0
                down = np.where(x[rows, np.maximum(at, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(inner, down, node)
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_forest(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """x: rows by features, y: 0 or 1. directions: 1, 0 or -1 a feature. least: smallest sum of second derivatives in a leaf.
    With no rows, or one class only, the forest has no trees."""
    p = np.clip((y.sum() + 0.5) / (len(y) + 1), 1e-3, 1 - 1e-3)
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(p / (1 - p)))
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
        raw = np.full(len(y), base)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-raw))
            raw += _grow(nodes, roots, binned, edges, q - y, q * (1 - q), directions, depth, rate, bins, least, ridge)
    columns = list(zip(*nodes)) if nodes else [[]] * 5
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Forest(*(np.array(c, k) for c, k in zip(columns, kinds)), np.array(roots, np.int64), base, depth)


def _grow(nodes, roots, binned, edges, g, h, directions, depth, rate, bins, least, ridge) -> np.ndarray:
    """Adds a tree; returns its value for each row."""
    roots.append(len(nodes))
    nodes.append([-1, 0.0, -1, -1, 0.0])
    at = np.zeros(len(g), np.int64)
    open_ = {0: (roots[-1], -np.inf, np.inf)}  # place in the level: node and bounds of its score
    done = np.zeros(len(g))
    live = np.ones(len(g), bool)
    for level in range(depth + 1):
        width = len(open_)
        following, moves = {}, {}
        sums = {}
        for f in range(binned.shape[1]):
            cell = at[live] * bins + binned[live, f]
            sums[f] = tuple(np.bincount(cell, w[live], width * bins).reshape(width, bins).cumsum(1) for w in (g, h))
        for place, (node, low, high) in open_.items():
            total_g, total_h = sums[0][0][place, -1], sums[0][1][place, -1]
            own = float(np.clip(-total_g / (total_h + ridge), low, high))
            nodes[node][4] = rate * own
            best = (1e-6, -1, 0, 0.0, 0.0)
            if level < depth:
                for f, (cg, ch) in sums.items():
                    lg, lh = cg[place, : len(edges[f])], ch[place, : len(edges[f])]
                    rg, rh = total_g - lg, total_h - lh
                    lv, rv = np.clip(-lg / (lh + ridge), low, high), np.clip(-rg / (rh + ridge), low, high)
                    loss = lambda s, t, v: s * v + 0.5 * (t + ridge) * v * v
                    gain = loss(total_g, total_h, own) - loss(lg, lh, lv) - loss(rg, rh, rv)
                    gain[(lh < least) | (rh < least) | (directions[f] * (rv - lv) < 0)] = 0
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), f, k, float(lv[k]), float(rv[k]))
            _, f, k, lv, rv = best
            if f < 0:
                continue
            nodes[node][:4] = [f, float(edges[f][k]), len(nodes), len(nodes) + 1]
            middle = (lv + rv) / 2
            sides = ((low, middle), (middle, high)) if directions[f] > 0 else ((middle, high), (low, middle)) if directions[f] < 0 else ((low, high),) * 2
            first = len(following)
            moves[place] = (f, k, first)
            for side in sides:
                following[len(following)] = (len(nodes), *side)
                nodes.append([-1, 0.0, -1, -1, 0.0])
        new_at = at.copy()
        for place, (node, *_) in open_.items():
            own_rows = live & (at == place)
            if place in moves:
                f, k, first = moves[place]
                new_at[own_rows] = first + (binned[own_rows, f] > k)
            else:
                done[own_rows] = nodes[node][4]
                live[own_rows] = False
        at, open_ = new_at, following
        if not open_:
            break
    return done


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability), to be read by interpolation. No rows: none."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, t in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([t, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])
