"""Linear machines with hinge loss on random Fourier features.

The features are worked out anew from the packed rows in every pass, so nothing as
wide as they are is ever stored. One pass serves all classes: each class has its
own L-BFGS run, and a pass evaluates the point every run asks for next.
"""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tabwright.plans.packed import TILE, summed

MEMORY = 10
TOLERANCE = 1e-6
HALVINGS = 20


@dataclass(frozen=True)
class Waves:
    """cos(x W + b) scaled: inner products of these approximate the RBF kernel (Rahimi and Recht, 2007)."""

    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def of(cls, width: int, count: int, seed: int = 42) -> Waves:
        random = np.random.default_rng(seed)
        weights = random.normal(scale=np.sqrt(2.0 / width), size=(width, count))
        return cls(weights.astype(np.float32), random.uniform(0, 2 * np.pi, size=count).astype(np.float32))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        phase = vectors.astype(np.float32) @ self.weights
        phase += self.shift
        np.cos(phase, out=phase)
        phase *= np.float32(np.sqrt(2.0 / len(self.shift)))
        return phase


def margins(waves: Waves, machines: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One column per machine; a machine is a row of weights with the intercept last."""
    parts = [waves(vectors[at : at + TILE]) @ machines[:, :-1].T.astype(np.float32) for at in range(0, len(vectors), TILE)]
    return np.concatenate(parts).astype(float) + machines[:, -1]


def descend(start: np.ndarray, rounds: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS: yields points, is sent their value and gradient, returns the best point."""
    x = start
    f, g = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q = g.copy()
        kept = []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            q += (a - (y @ q) / (s @ y)) * s
        if q @ g <= 0:
            q, steps = g.copy(), []
        size = 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12)) * 4
        for _ in range(HALVINGS):
            trial = x - size * q
            value, slope = yield trial
            if value <= f - 1e-4 * size * (q @ g):
                break
            size /= 2
        else:
            return x
        s, y = trial - x, slope - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-MEMORY:]
        done = abs(f - value) <= TOLERANCE * max(abs(f), abs(value), 1e-12)
        x, f, g = trial, value, slope
        if done:
            return x
    return x


def fit(blocks: DataFrame, waves: Waves, targets: list[int], rows: int, rounds: int, penalty: float) -> np.ndarray:
    """One machine per target class, a row each: mean hinge loss plus ``penalty`` / 2 times the squared weights.

    ``blocks`` are packed vectors with their class numbers.
    """
    width = len(waves.shift) + 1
    runs = {c: descend(np.zeros(width), rounds) for c in targets}
    asked = {c: next(run) for c, run in runs.items()}
    machines: dict[int, np.ndarray] = {}
    while asked:
        classes = np.array(list(asked))
        points = np.stack([asked[c] for c in asked])

        def kernel(vectors: np.ndarray, labels: np.ndarray) -> np.ndarray:
            flat = points[:, :-1].T.astype(np.float32)
            loss, slope = np.zeros(len(classes)), np.zeros((len(classes), width))
            for at in range(0, len(vectors), TILE):
                lifted = waves(vectors[at : at + TILE])
                side = np.where(labels[at : at + TILE, None] == classes, 1.0, -1.0)
                gap = 1.0 - side * ((lifted @ flat).astype(float) + points[:, -1])
                loss += np.maximum(gap, 0.0).sum(axis=0)
                push = np.where(gap > 0, -side, 0.0)
                slope[:, :-1] += push.T.astype(np.float32) @ lifted
                slope[:, -1] += push.sum(axis=0)
            return np.concatenate([loss, slope.ravel()])

        total = summed(blocks, kernel, len(classes) * (1 + width)) / rows
        slopes = total[len(classes) :].reshape(len(classes), width)
        following = {}
        for k, c in enumerate(asked):
            w = points[k].copy()
            w[-1] = 0.0
            try:
                following[c] = runs[c].send((total[k] + penalty / 2 * float(w @ w), slopes[k] + penalty * w))
            except StopIteration as end:
                machines[c] = end.value
        asked = following
    return np.stack([machines[c] for c in targets])
