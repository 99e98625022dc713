"""Optimizers over functions that give a value and a gradient; they run on the driver, the function on the cluster."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

import numpy as np

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


class Status(Enum):
    CONVERGED = "converged"
    MAX_ITERS_CONVEX = "iterations of the convex solver used up"
    MAX_ITERS_ALTERNATING = "alternations used up"
    BACKWARD_PROGRESS = "the value went up"
    FAILURE = "failure"


@dataclass
class Result:
    theta: np.ndarray
    value: float
    status: Status
    iterations: int = 0
    history: list[float] = field(default_factory=list)


@dataclass
class Validation:
    """Keeps the best parameters by a measure of held-out data; says when it hasn't improved for long enough."""

    measure: Callable[[np.ndarray], float]
    every: int = 1
    patience: int = 10
    best_score: float = -np.inf
    best_theta: np.ndarray | None = None
    stale: int = 0

    def evaluate(self, theta: np.ndarray, t: int) -> bool:
        """True if it is time to stop."""
        if t % self.every:
            return False
        score = self.measure(theta)
        if score > self.best_score:
            self.best_score, self.best_theta, self.stale = score, theta.copy(), 0
        else:
            self.stale += 1
        return self.stale >= self.patience

    def clear(self) -> None:
        self.best_score, self.best_theta, self.stale = -np.inf, None, 0


def _direction(g: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    q, coefficients = g.copy(), []
    for s, y, rho in reversed(memory):
        a = rho * (s @ q)
        q -= a * y
        coefficients.append(a)
    if memory:
        s, y, rho = memory[-1]
        q *= (s @ y) / (y @ y)
    for (s, y, rho), a in zip(memory, reversed(coefficients)):
        q += (a - rho * (y @ q)) * s
    return -q


def lbfgs(loss: Loss, theta: np.ndarray, tol: float = 1e-4, max_iters: int = 250, vectors: int = 20, line_search: int = 20, restarts: int = 3, validation: Validation | None = None) -> Result:
    """Limited-memory BFGS with a line search for the weak Wolfe conditions; starts again from where it stopped, `restarts` times."""
    theta = np.array(theta, float)
    f, g = loss(theta)
    history, t, status = [f], 0, Status.MAX_ITERS_CONVEX
    for _ in range(1 + restarts):
        memory: list[tuple[np.ndarray, np.ndarray, float]] = []
        begin, status = f, Status.MAX_ITERS_CONVEX
        for _ in range(max_iters):
            if np.linalg.norm(g) <= tol * max(1.0, np.linalg.norm(theta)):
                status = Status.CONVERGED
                break
            d = _direction(g, memory)
            slope = g @ d
            if slope >= 0:
                memory, d, slope = [], -g, -(g @ g)
            low, high = 0.0, np.inf
            step = 1.0 if memory else min(1.0, 1.0 / np.linalg.norm(g))
            found = None
            for _ in range(line_search):
                f2, g2 = loss(theta + step * d)
                if f2 > f + 1e-4 * step * slope:
                    high = step
                elif g2 @ d < 0.9 * slope:
                    found, low = (step, f2, g2), step
                else:
                    found = (step, f2, g2)
                    break
                step = 2 * step if np.isinf(high) else (low + high) / 2
            if found is None:
                status = Status.CONVERGED if memory == [] else Status.MAX_ITERS_CONVEX
                if memory == []:
                    break
                memory = []
                continue
            step, f2, g2 = found
            s, y = step * d, g2 - g
            if s @ y > 1e-12:
                memory = [*memory, (s, y, 1 / (s @ y))][-vectors:]
            theta, f, g = theta + s, f2, g2
            history.append(f)
            t += 1
            if validation and validation.evaluate(theta, t):
                return Result(theta, f, Status.CONVERGED, t, history)
        if status is not Status.CONVERGED and begin - f < tol * max(1.0, abs(f)):
            status = Status.CONVERGED
        if status is Status.CONVERGED and abs(begin - f) <= 1e-12:
            break
    return Result(theta, f, status, t, history)


def lbfgs_minibatch(batch_loss: Callable[[int, int], Loss], theta: np.ndarray, batches: int = 10, epochs: int = 5, per_batch: int = 5, tol: float = 1e-4, validation: Validation | None = None) -> Result:
    """A few iterations on one minibatch after the other; batch_loss(k, epoch) gives the loss of minibatch k of an epoch's shuffle."""
    t, f = 0, np.inf
    for epoch in range(epochs):
        for k in range(batches):
            r = lbfgs(batch_loss(k, epoch), theta, tol, max_iters=per_batch, restarts=0)
            theta, f, t = r.theta, r.value, t + 1
            if validation and validation.evaluate(theta, t):
                return Result(theta, f, Status.CONVERGED, t)
    return Result(theta, f, Status.CONVERGED, t)


def simplex_qp(gram: np.ndarray, b: np.ndarray, start: np.ndarray | None = None, tol: float = 1e-12, steps: int = 100_000) -> np.ndarray:
    """The point of the simplex that minimises a'Ga/2 - b'a: solved exactly on one set of coordinates after the other (those that become
    negative leave, that of the least slope joins), a few systems in all.

    Where rounding ends that too early, weight moves between the pair of coordinates that gains the most. No slope is known better than
    it can be worked out, so tol is at least that."""
    a = np.full(len(b), 1.0 / len(b)) if start is None else start / start.sum()
    tol = max(tol, 8 * np.finfo(float).eps * (np.abs(gram).max() + np.abs(b).max()))
    a = _active_set(gram, b, a, tol)
    slope = gram @ a - b
    for _ in range(steps):
        i = int(np.argmin(slope))
        held = np.where(a > 0, slope, -np.inf)
        curve = np.maximum(gram[i, i] + np.diag(gram) - 2 * gram[i], 1e-15)
        gap = held - slope[i]
        if gap.max() <= tol:
            break
        gain = np.where(gap > 0, gap**2 / curve, -np.inf)
        j = int(np.argmax(gain))
        move = min(a[j], gap[j] / curve[j])
        a[i] += move
        a[j] = 0.0 if move >= a[j] else a[j] - move
        slope += move * (gram[:, i] - gram[:, j])
    return a


def _active_set(gram: np.ndarray, b: np.ndarray, a: np.ndarray, tol: float) -> np.ndarray:
    a, joined = a.copy(), -1
    for _ in range(10 * len(b) + 50):
        on = np.flatnonzero(a > 0) if joined < 0 else np.append(np.flatnonzero(a > 0), joined)
        system = np.ones((len(on) + 1, len(on) + 1))
        system[:-1, :-1], system[-1, -1] = gram[np.ix_(on, on)], 0.0
        try:
            to = np.linalg.solve(system, np.append(b[on], 1.0))[:-1]
        except np.linalg.LinAlgError:
            break
        if not np.isfinite(to).all():
            break
        low = to <= 0
        if low.any():
            part = a[on][low] / (a[on][low] - to[low])
            if joined >= 0 and part.min() <= 0:
                break
            a[on] += part.min() * (to - a[on])
            a[on[low][part <= part.min()]], joined = 0.0, -1
            a /= a.sum()
            continue
        a[on], joined = to / to.sum(), -1
        slope = gram @ a - b
        j = int(np.argmin(slope))
        if a[j] > 0 or a @ slope - slope[j] <= tol:
            break
        joined = j
    return a


def bmrm(loss: Loss, theta: np.ndarray, beta: float, tol: float = 1e-4, max_iters: int = 250, shrink: bool = True, validation: Validation | None = None) -> Result:
    """Bundle method for a convex loss plus beta/2 of the squared norm: cutting planes, whose dual is solved over the simplex.

    The Gram matrix of the planes grows by a row each time; planes without weight are dropped, never the latest. What is added to its
    diagonal, so that systems of almost equal planes can be solved, is no part of the bound: else the gap would never fall below it."""
    w = np.array(theta, float)
    f, g = loss(w)
    planes, offsets = np.zeros((0, len(w))), np.zeros(0)
    gram, weights = np.zeros((0, 0)), None
    best, best_w, history = f + 0.5 * beta * w @ w, w.copy(), []
    for t in range(1, max_iters + 1):
        row = planes @ g / beta
        gram = np.block([[gram, row[:, None]], [row[None, :], np.array([[g @ g / beta + max(min(1e-6, tol), 1e-15 * (g @ g) / beta)]])]])
        planes = np.vstack([planes, g])
        offsets = np.append(offsets, f - w @ g)
        weights = simplex_qp(gram, offsets, None if weights is None else np.append(weights * 0.999, 0.001))
        w = -(weights @ planes) / beta
        bound = offsets @ weights - 0.5 * beta * w @ w
        f, g = loss(w)
        value = f + 0.5 * beta * w @ w
        if value < best:
            best, best_w = value, w.copy()
        history.append(best)
        if validation and validation.evaluate(w, t) or best - bound <= tol:
            return Result(best_w, best, Status.CONVERGED, t, history)
        if shrink:
            keep = weights > 1e-12
            keep[-1] = True
            planes, offsets, gram, weights = planes[keep], offsets[keep], gram[np.ix_(keep, keep)], weights[keep]
    return Result(best_w, best, Status.MAX_ITERS_CONVEX, max_iters, history)


def sgd(batch_loss: Callable[[int, int], Loss], theta: np.ndarray, beta: float, batches: int, rate: float = 0.01, epochs: int = 250, seed: int = 0, validation: Validation | None = None, early_stop: bool = False) -> Result:
    """Stochastic gradient steps over fixed minibatches in a new order each epoch; the rate falls as rate / (1 + rate * beta * t), and
    the penalty is beta/2 of the squared norm whatever the regularizer."""
    theta, t, f, history = np.array(theta, float), 0, 0.0, []
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        total = 0.0
        for k in rng.permutation(batches):
            f, g = batch_loss(int(k), 0)(theta)
            eta = rate / (1 + rate * beta * t)
            theta = (1 - beta * eta) * theta - eta * g
            total, t = total + f, t + 1
        history.append(total / batches)
        if validation and validation.evaluate(theta, epoch + 1) and early_stop:
            break
    return Result(theta, history[-1] if history else f, Status.CONVERGED, t, history)


def estimate_rate(loss: Loss, theta: np.ndarray, beta: float, steps: int = 10, start: float = 0.1) -> float:
    """Half of the best of some improving rates, found by doubling or halving from 0.1."""
    def after(rate: float) -> float:
        x, f = np.array(theta, float), np.inf
        for t in range(3):
            f, g = loss(x)
            eta = rate / (1 + rate * beta * t)
            x = (1 - beta * eta) * x - eta * g
        return loss(x)[0] + 0.5 * beta * x @ x

    begin = loss(theta)[0] + 0.5 * beta * theta @ theta
    rate, tried = start, {}
    factor = 2.0 if after(start) < begin else 0.5
    while len(tried) < steps and 1e-8 < rate < 1e8:
        value = after(rate)
        if value < begin:
            tried[rate] = value
        elif factor > 1:
            break
        rate *= factor
    return 0.5 * (min(tried, key=tried.get) if tried else start)


def em(loss, theta: np.ndarray, inner: Callable[[object, np.ndarray], Result], value: Callable[[object, np.ndarray], float], tol: float = 1e-4, max_iters: int = 20, ignore_increase: bool = False) -> Result:
    """Alternates between fixing the latent vectors at the present parameters and training with them fixed."""
    theta = np.array(theta, float)
    last, history = value(loss.fix(theta), theta), []
    for t in range(1, max_iters + 1):
        r = inner(loss.fix(theta), theta)
        if r.status is Status.FAILURE:
            return Result(theta, last, r.status, t, history)
        now = value(loss.fix(r.theta), r.theta)
        history.append(now)
        if now > last + 1e-12 and not ignore_increase:
            return Result(theta, last, Status.BACKWARD_PROGRESS, t, history)
        theta, drop, last = r.theta, last - now, now
        if drop < tol:
            return Result(theta, last, Status.CONVERGED, t, history)
    return Result(theta, last, Status.MAX_ITERS_ALTERNATING, max_iters, history)


#: Optimizers that objectives take by default.
def default_optimizer(objective: str) -> str:
    return "Lbfgs" if objective.startswith("LogLinear") else "Bmrm"
