"""Growth and scores of symmetric trees over blocks of binned rows: numpy only, so that a Python task loads little.

A block holds ``bins[feature, row]``. A tree is ``(levels, values)``: per level its ``(feature, split bin)``, per leaf its
value. Gradients and hessians are rounded to a power of two that makes all their sums exact: sums don't depend on the
order or the blocks of the rows, and the sums of one side of a split are those of the parent less those of the other.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np

Tree = tuple[list[tuple[int, int]], list[float]]


def exact_step(total_weight: float) -> float:
    """A power of two; sums of its multiples are exact while their absolute values add up to ``total_weight`` at most."""
    return 2.0 ** (np.ceil(np.log2(total_weight)) - 51) if np.isfinite(total_weight) and total_weight > 0 else 2.0**-51


def narrow(largest: int) -> type:
    """The smallest unsigned type for bins up to ``largest``."""
    return next(t for t in (np.uint8, np.uint16, np.uint32) if largest <= np.iinfo(t).max)


def leaves_of(bins: np.ndarray, levels: Sequence[tuple[int, int]]) -> np.ndarray:
    """Leaf of each row: bit ``l`` is set where level ``l`` sends the row right (its bin above the split bin)."""
    leaf = np.zeros(bins.shape[1], narrow((1 << len(levels)) - 1))
    for level, (feature, split) in enumerate(levels):
        leaf |= (bins[feature] > split).astype(leaf.dtype) << leaf.dtype.type(level)
    return leaf


def add_trees(scores: np.ndarray, bins: np.ndarray, trees: Iterable[Tree]) -> np.ndarray:
    """``scores`` plus the values of ``trees``, tree by tree."""
    for levels, values in trees:
        scores = scores + np.asarray(values)[leaves_of(bins, levels)]
    return scores


def in_finer_bins(trees: Iterable[Tree], lookups: Sequence[np.ndarray]) -> list[Tree]:
    """The same trees for the bins that ``lookups`` are indexed by: a split bin is the last that stands for it or less."""
    return [([(j, int(np.searchsorted(lookups[j], split, "right")) - 1) for j, split in levels], values) for levels, values in trees]


def slopes(scores: np.ndarray, y: np.ndarray, w: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted gradient and hessian of the logistic loss of each row, as multiples of ``step``."""
    p = 1 / (1 + np.exp(-scores))
    return np.rint(w * (p - y) / step) * step, np.rint(w * p * (1 - p) / step) * step


def histogram(
    bins: np.ndarray,
    g: np.ndarray,
    h: np.ndarray,
    levels: Sequence[tuple[int, int]],
    right: bool | None,
    width: int,
    lookups: Sequence[np.ndarray] | None = None,
) -> np.ndarray:
    """Sums ``[feature, (g, h), leaf, bin]``: of all rows without ``right``, else of the rows that the last level sends
    to that side, by their leaf before it. With ``lookups``, sums are by the bins that those of the rows stand for.
    """
    if right is None:
        at, leaves = leaves_of(bins, levels), 1 << len(levels)
    else:
        feature, split = levels[-1]
        rows = np.flatnonzero((bins[feature] > split) == right)
        at, leaves = leaves_of(bins, levels[:-1])[rows], 1 << (len(levels) - 1)
        g, h = g[rows], h[rows]
    start = at.astype(np.int64) * width
    sums = np.empty((len(bins), 2, leaves * width))
    for j, of_feature in enumerate(bins):
        own = of_feature if right is None else of_feature.take(rows)
        cell = start + (own if lookups is None else lookups[j].take(own))
        sums[j, 0] = np.bincount(cell, g, leaves * width)
        sums[j, 1] = np.bincount(cell, h, leaves * width)
    return sums.reshape(len(bins), 2, leaves, width)


def part(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``g**2 / h``, 0 where ``h`` is 0 (a leaf without rows, or without hessian and penalty)."""
    return np.divide(g * g, h, out=np.zeros(np.broadcast(g, h).shape), where=h > 0)


def best_split(hist: np.ndarray, l2: float, noise: float, rng: np.random.Generator) -> tuple[int, int, float]:
    """(feature, split bin, gain) of the best symmetric split from sums ``hist[feature, (g, h), leaf, bin]``.

    Split bin ``s`` sends bins ``<= s`` left; a split must leave rows' hessian on both sides of some leaf.
    """
    left = np.cumsum(hist, axis=3)
    gt, ht = left[:, 0, :, -1:], left[:, 1, :, -1:]
    gl, hl = left[:, 0, :, :-1], left[:, 1, :, :-1]
    gr, hr = gt - gl, ht - hl
    gain = (part(gl, hl + l2) + part(gr, hr + l2) - part(gt, ht + l2)).sum(axis=1)
    useful = ((hl > 0) & (hr > 0)).any(axis=1)
    gain = np.where(useful, gain, -np.inf)
    if not useful.any():
        return -1, -1, 0.0
    noisy = gain
    if noise > 0:
        finite = gain[useful]
        noisy = gain + rng.normal(0.0, noise * (finite.std() if len(finite) > 1 else 0.0), gain.shape)
    feature, split = np.unravel_index(int(np.argmax(noisy)), gain.shape)
    return int(feature), int(split), float(gain[feature, split])


def leaf_totals(hist: np.ndarray, last: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian sums of each final leaf: the last histograms' leaves, cut by the last split if it was taken."""
    g, h = hist[0].sum(axis=2)
    if last is None:
        return g, h
    feature, split = last
    gl, hl = hist[feature, :, :, : split + 1].sum(axis=2)
    return np.concatenate([gl, g - gl]), np.concatenate([hl, h - hl])


@dataclass
class Growth:
    """A forest while it grows: ``wanted`` says which histogram it needs next, ``take`` is given it."""

    setting: dict
    width: int
    seed: int
    trees: list[Tree] = field(default_factory=list)
    gains: list[list[float]] = field(default_factory=list)

    def __post_init__(self):
        self._rng = np.random.default_rng(self.seed)
        self._levels, self._gains, self._hist, self._right = [], [], None, None

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.setting["iterations"]

    def wanted(self) -> tuple[list[tuple[int, int]], bool | None]:
        """The levels of the open tree, and the side of the last one whose sums are needed (None: all rows)."""
        return list(self._levels), self._right

    def take(self, sums: np.ndarray) -> None:
        """Split by the histogram; a tree that is deep enough, or has no useful split left, is closed."""
        if self._right is None:
            hist = sums
        else:
            other = self._hist - sums
            hist = np.concatenate([other, sums] if self._right else [sums, other], axis=2)
        feature, split, gain = best_split(hist, self.setting["l2_leaf_reg"], self.setting["random_strength"], self._rng)
        if feature >= 0:
            self._levels.append((feature, split))
            self._gains.append(gain)
            if len(self._levels) < self.setting["depth"]:
                # The sums of the side with less hessian are asked for; those of the other follow.
                all_h, left_h = hist[feature, 1].sum(), hist[feature, 1, :, : split + 1].sum()
                self._hist, self._right = hist, bool(2 * left_h > all_h)
                return
        g, h = leaf_totals(hist, self._levels[-1] if feature >= 0 else None)
        below = h + self.setting["l2_leaf_reg"]
        values = -self.setting["learning_rate"] * np.divide(g, below, out=np.zeros_like(g), where=below > 0)
        self.trees.append((self._levels, values.tolist()))
        self.gains.append(self._gains)
        self._levels, self._gains, self._hist, self._right = [], [], None, None


def grown_here(growth: Growth, bins: np.ndarray, y: np.ndarray, w: np.ndarray, base: float, step: float) -> Growth:
    """The whole forest from rows that are all here."""
    scores, seen = np.full(len(y), base), -1
    while not growth.done:
        if len(growth.trees) > seen:
            scores = add_trees(scores, bins, growth.trees[max(seen, 0) :])
            seen = len(growth.trees)
            g, h = slopes(scores, y, w, step)
        growth.take(histogram(bins, g, h, *growth.wanted(), growth.width))
    return growth
