"""Small gradient-boosted trees on dense features, with calibrated output."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 24


def _best_split(features: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, slope: np.ndarray, curve: np.ndarray):
    """Feature, edge and gain of the best split of `rows`."""
    best = (0.0, 0, 0.0)
    total_s, total_c = slope[rows].sum(), curve[rows].sum()
    base = total_s**2 / (total_c + 1)
    for k, cuts in enumerate(edges):
        if not len(cuts):
            continue
        place = np.searchsorted(cuts, features[rows, k], "left")
        left_s = np.cumsum(np.bincount(place, slope[rows], len(cuts) + 1))[:-1]
        left_c = np.cumsum(np.bincount(place, curve[rows], len(cuts) + 1))[:-1]
        gain = left_s**2 / (left_c + 1) + (total_s - left_s) ** 2 / (total_c - left_c + 1) - base
        at = int(gain.argmax())
        if gain[at] > best[0] + 1e-9:
            best = (float(gain[at]), k, float(cuts[at]))
    return best


@dataclass
class Boosted:
    """Trees of depth two: a root split and a split on each side, with four leaves."""

    trees: list[tuple] = field(default_factory=list)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, features: np.ndarray) -> np.ndarray:
        out = np.full(len(features), self.start)
        for root, left, right, leaves in self.trees:
            low = features[:, root[0]] <= root[1]
            second = np.where(low, features[:, left[0]] <= left[1], features[:, right[0]] <= right[1])
            out += np.where(low, np.where(second, leaves[0], leaves[1]), np.where(second, leaves[2], leaves[3]))
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(features) + self.shift, -30, 30)))


def boost(features: np.ndarray, target: np.ndarray, trees: int = 40, rate: float = 0.3) -> Boosted:
    """Newton boosting on the log loss; the last fifth of the rows calibrates the scores."""
    model = Boosted()
    held = np.arange(len(target)) % 5 == 4
    fit_x, fit_y = features[~held], target[~held].astype(float)
    share = (fit_y.sum() + 1) / (len(fit_y) + 2)
    model.start = float(np.log(share / (1 - share)))
    if len(fit_y) < 20 or fit_y.min() == fit_y.max():
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[:-1])) for column in fit_x.T]
    score = np.full(len(fit_y), model.start)
    every = np.arange(len(fit_y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = fit_y - p, p * (1 - p)
        gain, feature, cut = _best_split(fit_x, edges, every, slope, curve)
        if gain <= 0:
            break
        low = fit_x[:, feature] <= cut
        sides, leaves = [], []
        for rows in (every[low], every[~low]):
            _, k, c = _best_split(fit_x, edges, rows, slope, curve)
            second = fit_x[rows, k] <= c
            sides.append((k, c))
            leaves += [rate * slope[r].sum() / (curve[r].sum() + 1) for r in (rows[second], rows[~second])]
        model.trees.append(((feature, cut), sides[0], sides[1], tuple(leaves)))
        tree = Boosted(trees=model.trees[-1:])
        score = score + tree.raw(fit_x)
    calibrate(model, features[held], target[held])
    return model


def calibrate(model: Boosted, features: np.ndarray, target: np.ndarray) -> None:
    """Platt's line over rows the trees have not seen."""
    if not 0 < target.sum() < len(target):
        return
    raw = model.raw(features)
    good, bad = target.sum(), len(target) - target.sum()
    goal = np.where(target, (good + 1) / (good + 2), 1 / (bad + 2))
    line, design = np.array([1.0, 0.0]), np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        curve = (design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-6 * np.eye(2)
        line = line - np.clip(np.linalg.solve(curve, design.T @ (p - goal)), -1, 1)
    model.slope, model.shift = float(max(line[0], 0.0)), float(line[1])
