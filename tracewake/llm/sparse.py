"""Logistic regression on sparse text features with Platt scaling, for the scored detectors.

The fit reads its rows through sums over blocks of them, so they may lie in one
place or in many.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np

Row = tuple[list[str], int]


@dataclass
class Block:
    """Distinct rows: numbers of their features one row after the other, where each row begins, copies of each row and how many of them are true."""

    flat: np.ndarray
    start: np.ndarray
    n: np.ndarray
    true: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.start, append=len(self.flat))


#: (rows to fit, rows held out to calibrate)
Blocks = tuple[Block, Block]
#: the sum of f over all blocks, wherever they are
Total = Callable[[Callable[[Blocks], np.ndarray]], np.ndarray]


def is_held(features: list[str]) -> bool:
    """A fifth of the rows calibrates."""
    return zlib.crc32(repr(features).encode()) % 5 == 0


def number(features: list[str], index: dict[str, int]) -> tuple[int, ...]:
    return tuple(index[f] for f in dict.fromkeys(features) if f in index)


def blocks(rows: Iterable[tuple[tuple[int, ...], int, bool]]) -> Blocks:
    """Rows of (feature numbers, label, whether held out), equal ones as one."""
    parts: tuple[dict[tuple[int, ...], list[int]], ...] = ({}, {})
    for ids, y, held in rows:
        c = parts[held].setdefault(ids, [0, 0])
        c[0] += 1
        c[1] += y
    return tuple(_block(p) for p in parts)


def _block(rows: dict[tuple[int, ...], list[int]]) -> Block:
    rows = {ids: c for ids, c in rows.items() if ids}
    counts = np.array(list(rows.values()), float).reshape(-1, 2)
    ends = np.cumsum([len(ids) for ids in rows], dtype=np.int64)
    flat = np.fromiter((i for ids in rows for i in ids), np.int32)
    return Block(flat, np.append(0, ends[:-1]) if len(ends) else ends, counts[:, 0], counts[:, 1])


def fit(rows: list[Row], least: int = 3) -> tuple[dict[str, float], tuple[float, float]]:
    """(weight of each feature seen at least so often, Platt scale and offset from a held-out fifth)."""
    counts = Counter(f for fs, _ in rows for f in set(fs))
    index = {f: k for k, f in enumerate(f for f, n in counts.items() if n >= least)}
    held = [is_held(fs) for fs, _ in rows]
    if not any(held) or all(held):
        held = [i % 5 == 0 for i in range(len(rows))]
    local = blocks((number(fs, index), y, h) for (fs, y), h in zip(rows, held, strict=True))
    return solve(lambda f: f(local), index, max(len(fs) for fs, _ in rows))


def solve(total: Total, index: dict[str, int], width: int) -> tuple[dict[str, float], tuple[float, float]]:
    """Weights of the numbered features, Platt scale and offset. width: features of the longest row."""
    w = logistic(total, len(index), width)
    return {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, _platt(total, w)


def scores(b: Block, w: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w[b.flat], b.start) if len(b.start) else np.zeros(0)


def _spread(b: Block, values: np.ndarray, n: int) -> np.ndarray:
    """For each feature the sum of the values of the rows that have it."""
    return np.bincount(b.flat, weights=np.repeat(values, b.lengths), minlength=n)


def logistic(total: Total, n: int, width: int, rounds: int = 250, ridge: float = 0.3) -> np.ndarray:
    """Weights of n features by accelerated gradient steps scaled per feature."""
    seen = total(lambda x: _spread(x[0], x[0].n, n)) + 4 * ridge
    step = 4.0 / (seen * width**0.5)
    w, v = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        v = 0.8 * v - 0.5 * step * (total(lambda x, w=w: _spread(x[0], _probabilities(scores(x[0], w)) * x[0].n - x[0].true, n)) + ridge * w)
        w = w + v
    return w


def _probabilities(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _platt(total: Total, weights: np.ndarray) -> tuple[float, float]:
    w = np.array([1.0, 0.0])

    def sums(x: Blocks, w: np.ndarray) -> np.ndarray:
        """Second and first derivatives."""
        b = x[1]
        a = np.stack([s := scores(b, weights), np.ones_like(s)], axis=1)
        p = _probabilities(a @ w)
        return np.append((a * (p * (1 - p) * b.n)[:, None]).T @ a, a.T @ (b.true - p * b.n))

    for _ in range(50):
        got = total(lambda x, w=w: sums(x, w))
        d = np.linalg.solve(got[:4].reshape(2, 2) + 0.1 * np.eye(2), got[4:] - 0.1 * (w - np.array([1.0, 0.0])))
        w = w + d
        if np.abs(d).max() < 1e-9:
            break
    return float(max(w[0], 0.1)), float(w[1])


def probability(logit: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
