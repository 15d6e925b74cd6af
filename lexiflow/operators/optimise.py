"""Smooth minimisation of many models at once, one evaluation at a time.

Each model is an ``Lbfgs``: ask it for the ``trial`` point, evaluate loss and gradient there in
whatever way fits (here: one Spark job for all models that still run), and ``tell`` it.  The driver holds a
model's point and ``memory`` pairs of vectors of its size, nothing that grows with the rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np

SLOPE = 1e-4  # share of the promised decrease that a step must bring
LEAST_STEP = 1e-12


class Lbfgs:
    """Limited-memory quasi-Newton descent with a backtracking line search."""

    def __init__(self, start: np.ndarray, tolerance: float = 1e-4, rounds: int = 1000, memory: int = 8):
        self.trial = np.array(start, float)
        self.tolerance, self.rounds = tolerance, rounds
        self.point = self.loss = self.gradient = self.direction = None
        self.step, self.round, self.done = 1.0, 0, False
        self.history: deque = deque(maxlen=memory)

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        """Loss and gradient at ``trial``: accept it and take the next direction, or shorten the step."""
        if self.point is not None:
            slope = float(self.gradient @ self.direction)
            if not loss <= self.loss + SLOPE * self.step * slope:
                self._shorten(loss, slope)
                return
            moved, bent = self.trial - self.point, gradient - self.gradient
            if (curve := float(moved @ bent)) > 1e-12 * float(np.linalg.norm(moved) * np.linalg.norm(bent)):
                self.history.append((moved, bent, curve))
            self.round += 1
        self.point, self.loss, self.gradient = self.trial, loss, gradient
        if np.abs(gradient).max(initial=0.0) <= self.tolerance or self.round >= self.rounds:
            self.done = True
            return
        self.direction = self._downhill()
        if self.gradient @ self.direction >= 0:
            self.history.clear()
            self.direction = -gradient
        self.step = 1.0 if self.history else min(1.0, 1.0 / np.abs(gradient).sum())
        self.trial = self.point + self.step * self.direction

    def _shorten(self, loss: float, slope: float) -> None:
        fitted = -slope * self.step / (2 * (loss - self.loss - slope * self.step)) if np.isfinite(loss) else 0.1  # of a parabola
        self.step *= min(max(fitted, 0.1), 0.5)
        if self.step < LEAST_STEP:
            self.done = True
            self.trial = self.point
        else:
            self.trial = self.point + self.step * self.direction

    def _downhill(self) -> np.ndarray:
        q, shares = -self.gradient, []
        for moved, bent, curve in reversed(self.history):
            shares.append(a := float(moved @ q) / curve)
            q = q - a * bent
        if self.history:
            _, bent, curve = self.history[-1]
            q = q * (curve / float(bent @ bent))
        for (moved, bent, curve), a in zip(self.history, reversed(shares)):
            q = q + (a - float(bent @ q) / curve) * moved
        return q
