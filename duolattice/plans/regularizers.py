"""Regularizers: penalty and gradient at given parameters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class L2:
    """beta/2 of the squared norm; with w_beta or u_beta the two parts of the parameters have their own (one that is not set is free)."""

    beta: float = 1.0
    w_beta: float | None = None
    u_beta: float | None = None
    width: int | None = None

    def coefficients(self, dim: int) -> np.ndarray:
        if self.w_beta is None and self.u_beta is None:
            return np.full(dim, self.beta)
        width = dim if self.width is None else self.width
        return np.concatenate([np.full(width, self.w_beta or 0.0), np.full(dim - width, self.u_beta or 0.0)])

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        c = self.coefficients(len(theta))
        return float(0.5 * (c * theta * theta).sum()), c * theta

    def setup(self, theta: np.ndarray, seed: int = 0) -> np.ndarray:
        return theta


class NoRegularizer:
    beta = 0.0

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        return 0.0, np.zeros(len(theta))

    def setup(self, theta: np.ndarray, seed: int = 0) -> np.ndarray:
        return theta


class SoftTying:
    """Draws each label's weights to shared ones, and those to zero. Parameters are [w u shared_w shared_u]; u may be missing.

    Of the four betas all or none are given; by default the shared w is free and the shared u has a tenth of beta."""

    def __init__(self, labels: int, size: int, has_u: bool = False, beta: float = 1.0, w_beta: float | None = None, u_beta: float | None = None, shared_w_beta: float | None = None, shared_u_beta: float | None = None):
        given = [b is not None for b in (w_beta, u_beta, shared_w_beta, shared_u_beta)]
        if any(given) and not all(given):
            raise ValueError("give all four betas or none")
        self.labels, self.size, self.has_u, self.beta = labels, size, has_u, beta
        self.betas = (w_beta, u_beta, shared_w_beta, shared_u_beta) if all(given) else (beta, beta, 0.0, 0.1 * beta)

    @property
    def parts(self) -> int:
        return 2 if self.has_u else 1

    def setup(self, theta: np.ndarray, seed: int = 0) -> np.ndarray:
        """theta with shared parameters after it; those with a positive beta start at small random values."""
        shared = [np.random.default_rng(seed + k).normal(0, 0.01, self.size) if self.betas[2 + k] > 0 else np.zeros(self.size) for k in range(self.parts)]
        return np.concatenate([theta, *shared])

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        width, grad, value = self.labels * self.size, np.zeros(len(theta)), 0.0
        for k in range(self.parts):
            own = slice(k * width, (k + 1) * width)
            common = slice(self.parts * width + k * self.size, self.parts * width + (k + 1) * self.size)
            away = theta[own].reshape(self.labels, self.size) - theta[common]
            value += 0.5 * self.betas[k] * float((away**2).sum()) + 0.5 * self.betas[2 + k] * float((theta[common] ** 2).sum())
            grad[own] = self.betas[k] * away.ravel()
            grad[common] = self.betas[2 + k] * theta[common] - self.betas[k] * away.sum(axis=0)
        return value, grad


#: Regularizers by name.
REGULARIZERS = {"L2": L2, "None": NoRegularizer, "SoftTying": SoftTying}


class Regularized:
    """A loss with a penalty. Parameters beyond the loss's own belong to the regularizer alone."""

    def __init__(self, loss, regularizer):
        self.loss, self.regularizer = loss, regularizer

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        d = self.loss.objective.dim if hasattr(self.loss, "objective") else len(theta)
        f, g = self.loss(theta[:d])
        r, h = self.regularizer(theta)
        return f + r, np.concatenate([g, np.zeros(len(theta) - d)]) + h
