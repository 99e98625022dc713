"""Dense and sparse vectors and matrices in the real and the log domain, for the kernels and the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def log_vector(v: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(v)


def exp_vector(v: np.ndarray) -> np.ndarray:
    return np.exp(v)


exp_matrix = exp_vector


def log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def add_exponentiated(dest: np.ndarray, logs: np.ndarray, scale: float = 1.0) -> np.ndarray:
    dest += np.exp(logs) * scale
    return dest


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a - b


def add_outer_lower_log(dest: np.ndarray, log_scale: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dest (logs) plus the lower triangle of scale * a b', all in the log domain."""
    lower = np.tri(len(a), len(b), dtype=bool)
    dest[lower] = np.logaddexp(dest[lower], (log_scale + a[:, None] + b[None, :])[lower])
    return dest


def add_lower_triangular(dest: np.ndarray, source: np.ndarray) -> np.ndarray:
    dest += np.tril(source)
    return dest


def add_scaled(dest: np.ndarray, source: np.ndarray, scale: float) -> np.ndarray:
    dest += source * scale
    return dest


def lower_to_symmetric(lower: np.ndarray) -> np.ndarray:
    return np.tril(lower) + np.tril(lower, -1).T


def symmetric_product(lower: np.ndarray, x: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """The symmetric matrix of a lower triangle times x, added to onto if given."""
    out = lower_to_symmetric(lower) @ x
    return out if onto is None else onto + out


def lower_covariance(log_second: np.ndarray, first: np.ndarray) -> np.ndarray:
    """exp(log second moments) - v v' where both entries of v are not zero; lower triangle."""
    out = np.tril(np.exp(log_second))
    some = first != 0
    return np.where(np.outer(some, some), out - np.tril(np.outer(first, first)), out)


def scale_rows_by_sigmoid_slope(m: np.ndarray, s: np.ndarray) -> np.ndarray:
    return m * (s * (1 - s))[:, None]


def sigmoid_vector(v: np.ndarray) -> np.ndarray:
    """Dense: zero entries give 0.5."""
    return 1 / (1 + np.exp(-np.asarray(v, float)))


@dataclass
class WeightVector:
    """Weights that grow when a larger index is set; reading from files adds up what stands at an index."""

    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def dim(self) -> int:
        return len(self.values)

    def resize(self, n: int) -> None:
        if n > self.dim:
            self.values = np.concatenate([self.values, np.zeros(n - self.dim)])

    def inner(self, other) -> float:
        """With a dense array or a mapping of indices; 0 without weights."""
        if not self.dim:
            return 0.0
        if isinstance(other, dict):
            return float(sum(self.values[i] * v for i, v in other.items()))
        return float(self.values[: len(other)] @ np.asarray(other))

    def add(self, index: int, value: float) -> None:
        self.resize(index + 1)
        self.values[index] += value

    def set(self, index: int, value: float) -> None:
        self.resize(index + 1)
        self.values[index] = value

    def zero(self) -> None:
        self.values[:] = 0

    def scale(self, by: float) -> None:
        self.values *= by

    def squared_l2(self) -> float:
        return float(self.values @ self.values)


class Parameters:
    """Up to four weight vectors in a row: w, u, shared w, shared u."""

    def __init__(self, n_w: int, n_u: int = 0, n_shared_w: int = 0, n_shared_u: int = 0):
        self.sizes = (n_w, n_u, n_shared_w, n_shared_u)
        self.starts = tuple(np.cumsum([0, *self.sizes])[:4].tolist())
        self.values = np.zeros(sum(self.sizes))

    def part(self, k: int) -> np.ndarray:
        return self.values[self.starts[k] : self.starts[k] + self.sizes[k]]

    w = property(lambda self: self.part(0))
    u = property(lambda self: self.part(1))
    shared_w = property(lambda self: self.part(2))
    shared_u = property(lambda self: self.part(3))

    def index_w(self) -> int:
        return self.starts[0]

    def index_u(self) -> int:
        return self.starts[1]

    def index_shared_w(self) -> int:
        return self.starts[2]

    def index_shared_u(self) -> int:
        return self.starts[3]

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int) -> float:
        return float(self.values[i])

    def add(self, i: int, v: float) -> None:
        self.values[i] += v

    def set_all(self, values: np.ndarray) -> None:
        self.values[:] = values

    def inner(self, v: np.ndarray) -> float:
        return float(self.values @ v)

    def squared_l2(self) -> float:
        return float(self.values @ self.values)


def gaussian_samples(n: int, mean: float = 0.0, deviation: float = 1.0, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).normal(mean, deviation, n)


def random_permutation(n: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).permutation(n)


def numerical_gradient(f, theta: np.ndarray, i: int, eps: float = 1e-4) -> float:
    """Central difference of f along coordinate i."""
    step = np.zeros(len(theta))
    step[i] = eps
    return (f(theta + step) - f(theta - step)) / (2 * eps)
