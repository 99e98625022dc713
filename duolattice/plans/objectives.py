"""Training objectives: each sums a loss and a gradient over examples, and scores examples for each label.

An objective works on an ExampleBatch: lattices of its pairs (built once), observed features, labels. `partial` gives a batch's
loss and gradient as numpy arrays; `DistributedLoss` runs it in Arrow batches and sums by coordinate with a grouped aggregate.

Parameters lie as w (base features of each label in turn; binary models have label 1 only), then u in the same way.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import sigmoid_vector
from ..operators.dictionary import Dictionary
from ..operators.latent import NoLatent
from ..operators.lattice import Batch, LatticeOptions
from ..operators.machine import Allowed, Machine
from ..operators.metrics import kept
from ..operators.observed import mismatches, phrase_pairs


@dataclass
class ModelSpec:
    """What a model looks at. index: base id of each feature name (models of observed features alone don't need it, only how many
    there are: n_features); labels: those of a multiclass model."""

    machine: Machine
    latent: object
    options: LatticeOptions = LatticeOptions(final_features=False)
    allowed: Allowed | None = None
    index: dict[str, int] = field(default_factory=dict)
    labels: tuple[int, ...] = (0, 1)
    k_best: int = 5
    global_size: int = 2
    n_features: int = 0

    @property
    def size(self) -> int:
        return len(self.index) or self.n_features

    @property
    def has_latent(self) -> bool:
        return not isinstance(self.latent, NoLatent)


def _copies(row: tuple) -> int:
    return row[5] if len(row) > 5 else 1


class ExampleBatch:
    """Examples (source, target, y, observed ids, observed values, number of copies: one if left out) ready for evaluation. Sums over
    pairs take each as often as it has copies."""

    def __init__(self, spec: ModelSpec, rows: list[tuple], need_lattice: bool = True):
        self.spec, self.n, self.d = spec, len(rows), spec.size
        self.pairs = [(r[0], r[1]) for r in rows]
        self.y = np.array([r[2] for r in rows], np.int64)
        self.obs_pair = np.repeat(np.arange(self.n), [len(r[3] or ()) for r in rows])
        self.obs_ids = np.array([i for r in rows for i in r[3] or ()], np.int64)
        self.obs_values = np.array([v for r in rows for v in r[4] or ()], float)
        self.copies = np.array([_copies(r) for r in rows], float)
        if need_lattice and not spec.has_latent:
            raise ValueError("without latent features only objectives on observed features can be used")
        self.lattice = Batch(self.pairs, spec.machine, spec.latent, spec.index, spec.options, spec.allowed) if need_lattice else None

    @classmethod
    def of_columns(cls, spec: ModelSpec, columns: pa.RecordBatch) -> "ExampleBatch":
        """Without lattices: taken from the columns y, obs_ids, obs_values and copies as they lie."""
        out = object.__new__(cls)
        out.spec, out.n, out.d, out.lattice = spec, columns.num_rows, spec.size, None
        y, ids, values, copies = (columns.column(c) for c in ("y", "obs_ids", "obs_values", "copies"))
        if y.null_count:
            raise TypeError("an example has no label")
        out.y, out.copies = (c.to_numpy(zero_copy_only=False) for c in (y.cast(pa.int64()), copies.cast(pa.float64())))
        out.obs_pair = np.repeat(np.arange(out.n), pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
        out.obs_ids, out.obs_values = (c.flatten().cast(t).to_numpy(zero_copy_only=False) for c, t in ((ids, pa.int64()), (values, pa.float64())))
        return out

    def total(self, x: np.ndarray) -> float:
        """Sum over the pairs and their copies."""
        return float((x * self.copies).sum())

    def observed_scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.obs_pair, w[self.obs_ids] * self.obs_values, self.n) if len(self.obs_ids) else np.zeros(self.n)

    def observed_sum(self, c: np.ndarray) -> np.ndarray:
        """Sum of the observed vectors, weighted by pair."""
        return np.bincount(self.obs_ids, (c * self.copies)[self.obs_pair] * self.obs_values, self.d) if len(self.obs_ids) else np.zeros(self.d)

    def log_z(self, w: np.ndarray) -> np.ndarray:
        return self.lattice.log_partition(self.lattice.weigh(w)) + self.observed_scores(w)

    def paths(self) -> np.ndarray:
        """Log number of alignments."""
        return self.lattice.log_partition(np.zeros(self.lattice.n_edges))

    def expected(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log mass, and expectations of the latent features at the lattice's places."""
        z, e = self.lattice.expected(self.lattice.weigh(w))
        return z + self.observed_scores(w), e

    def expected_scores(self, w: np.ndarray, e: np.ndarray) -> np.ndarray:
        """w . expected features of each pair."""
        b = self.lattice
        return np.bincount(b.place_pair, w[b.place_id] * e, self.n) + self.observed_scores(w)

    def expected_sum(self, c: np.ndarray, e: np.ndarray) -> np.ndarray:
        b = self.lattice
        return np.bincount(b.place_id, (c * self.copies)[b.place_pair] * e, self.d) + self.observed_sum(c)

    def best(self, w: np.ndarray) -> tuple[np.ndarray, list[dict[int, float]]]:
        """Best score, observed part included, and the latent vector of the best path."""
        score, vectors = self.lattice.max_features(self.lattice.weigh(w))
        return score + self.observed_scores(w), vectors

    def vectors_scores(self, w: np.ndarray, vectors: list[dict[int, float]]) -> np.ndarray:
        """w . (path vector and observed vector)."""
        return np.array([sum(w[i] * v for i, v in x.items()) for x in vectors]) + self.observed_scores(w)

    def vectors_sum(self, c: np.ndarray, vectors: list[dict[int, float]]) -> np.ndarray:
        out = self.observed_sum(c)
        for k, x in zip(c * self.copies, vectors):
            if k:
                for i, v in x.items():
                    out[i] += k * v
        return out

    def covariance_product(self, u: np.ndarray, v: np.ndarray, c: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Sum over pairs of c * Cov_u[phi] v (v: one vector, or a row for each pair)."""
        b = self.lattice
        if not len(b.ids):
            return np.zeros(self.d)
        direction = v[b.ids] if v.ndim == 1 else v[b.pair[b.edge_of_value], b.ids]
        f = np.bincount(b.edge_of_value, direction * b.values, b.n_edges)
        second = np.bincount(b.place_of_value, b.along(b.weigh(u), f)[b.edge_of_value] * b.values, len(b.places))
        mean = np.bincount(b.place_pair, e * (v[b.place_id] if v.ndim == 1 else v[b.place_pair, b.place_id]), self.n)
        return np.bincount(b.place_id, (c * self.copies)[b.place_pair] * (second - e * mean[b.place_pair]), self.d)


def _softmax(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = s.max(axis=1, keepdims=True)
    p = np.exp(s - top)
    z = p.sum(axis=1, keepdims=True)
    return (top + np.log(z))[:, 0], p / z


def _log1p_exp(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


class Objective:
    """binary: one weight vector, scores +s and -s. needs_u: a second vector. impute: parameters that latent vectors are fixed by."""

    binary = False
    needs_u = False
    needs_lattice = True
    uses_em = False

    def __init__(self, spec: ModelSpec, impute: np.ndarray | None = None):
        self.spec, self.impute = spec, impute

    @property
    def width(self) -> int:
        """Length of w."""
        return self.spec.size * (1 if self.binary else len(self.spec.labels))

    @property
    def dim(self) -> int:
        return self.width * (2 if self.needs_u else 1)

    def w(self, theta: np.ndarray) -> np.ndarray:
        return theta[: self.width].reshape(-1, self.spec.size)

    def u(self, theta: np.ndarray) -> np.ndarray:
        return theta[self.width : 2 * self.width].reshape(-1, self.spec.size)

    def slots(self, batch: ExampleBatch) -> np.ndarray:
        return np.searchsorted(self.spec.labels, batch.y)

    def signs(self, batch: ExampleBatch) -> np.ndarray:
        return np.where(batch.y == 1, 1.0, -1.0)

    def partial(self, batch: ExampleBatch, theta: np.ndarray) -> tuple[float, np.ndarray]:
        raise NotImplementedError

    def decision(self, batch: ExampleBatch, theta: np.ndarray) -> np.ndarray:
        """Binary: score of label 1. Otherwise: a column for each label."""
        raise NotImplementedError

    def scores(self, batch: ExampleBatch, theta: np.ndarray) -> np.ndarray:
        s = self.decision(batch, theta)
        return np.stack([-s, s], axis=1) if self.binary else s

    def fixed(self, theta: np.ndarray) -> np.ndarray:
        return theta if self.impute is None else self.impute


class LogLinearBinary(Objective):
    binary, scaled = True, True

    def decision(self, batch, theta):
        return batch.log_z(theta) - (batch.paths() if self.scaled else 0.0)

    def partial(self, batch, theta):
        z, e = batch.expected(theta)
        s, y = z - (batch.paths() if self.scaled else 0.0), self.signs(batch)
        return batch.total(_log1p_exp(-y * s)), batch.expected_sum(-y * (1 - sigmoid_vector(y * s)), e)


class LogLinearBinaryUnscaled(LogLinearBinary):
    scaled = False


class LogLinearBinaryObs(Objective):
    binary, needs_lattice = True, False

    def decision(self, batch, theta):
        return batch.observed_scores(theta)

    def partial(self, batch, theta):
        s, y = batch.observed_scores(theta), self.signs(batch)
        return batch.total(_log1p_exp(-y * s)), batch.observed_sum(-y * (1 - sigmoid_vector(y * s)))


class LogLinearMulti(Objective):
    def decision(self, batch, theta):
        return np.stack([batch.log_z(w) for w in self.w(theta)], axis=1)

    def partial(self, batch, theta):
        found = [batch.expected(w) for w in self.w(theta)]
        total, p = _softmax(np.stack([z for z, _ in found], axis=1))
        own = self.slots(batch)
        loss = batch.total(total - np.stack([z for z, _ in found], axis=1)[np.arange(batch.n), own])
        grad = [batch.expected_sum(p[:, k] - (own == k), e) for k, (_, e) in enumerate(found)]
        return loss, np.concatenate(grad)


class LogLinearMultiELFV(Objective):
    """Scores are w . E_u[phi]."""

    needs_u = True

    def decision(self, batch, theta):
        return np.stack([batch.expected_scores(w, batch.expected(u)[1]) for w, u in zip(self.w(theta), self.u(theta))], axis=1)

    def partial(self, batch, theta):
        means = [batch.expected(u)[1] for u in self.u(theta)]
        s = np.stack([batch.expected_scores(w, e) for w, e in zip(self.w(theta), means)], axis=1)
        total, p = _softmax(s)
        own = self.slots(batch)
        c = [p[:, k] - (own == k) for k in range(len(means))]
        grad_w = [batch.expected_sum(ck, e) for ck, e in zip(c, means)]
        grad_u = [batch.covariance_product(u, w, ck, e) for u, w, ck, e in zip(self.u(theta), self.w(theta), c, means)]
        return batch.total(total - s[np.arange(batch.n), own]), np.concatenate([*grad_w, *grad_u])


class LogLinearMultiELFVSigmoid(LogLinearMultiELFV):
    """As ELFV on the sigmoid of the expectations; features that a pair lacks stand at one half."""

    def _means(self, batch, e):
        """Dense expectations, observed features included."""
        b, out = batch.lattice, np.zeros((batch.n, batch.d))
        np.add.at(out, (b.place_pair, b.place_id), e)
        np.add.at(out, (batch.obs_pair, batch.obs_ids), batch.obs_values)
        return out

    def decision(self, batch, theta):
        half = 0.5 * theta[: self.width].sum()
        return np.stack([half + (sigmoid_vector(self._means(batch, batch.expected(u)[1])) - 0.5) @ w for w, u in zip(self.w(theta), self.u(theta))], axis=1)

    def partial(self, batch, theta):
        found = [batch.expected(u)[1] for u in self.u(theta)]
        slopes = [sigmoid_vector(self._means(batch, e)) for e in found]
        s = self.decision(batch, theta)
        total, p = _softmax(s)
        own = self.slots(batch)
        grad_w, grad_u = [], []
        for k, (e, m) in enumerate(zip(found, slopes)):
            c = p[:, k] - (own == k)
            # The halves of all labels cancel, as the coefficients of each example sum to zero.
            grad_w.append((m - 0.5).T @ (c * batch.copies))
            grad_u.append(batch.covariance_product(self.u(theta)[k], self.w(theta)[k] * m * (1 - m), c, e))
        return batch.total(total - s[np.arange(batch.n), own]), np.concatenate([*grad_w, *grad_u])


class LogLinearMultiUW(Objective):
    """Bounds the log-linear loss with latent vectors from a second model u."""

    needs_u = True

    def decision(self, batch, theta):
        out = []
        for w, u in zip(self.w(theta), self.u(theta)):
            z, e = batch.expected(u)
            out.append(batch.expected_scores(w - u, e) + z)
        return np.stack(out, axis=1)

    def partial(self, batch, theta):
        found = [batch.expected(w) for w in self.w(theta)]
        total, p = _softmax(np.stack([z for z, _ in found], axis=1))
        own, loss = self.slots(batch), batch.total(total)
        grad_w, grad_u = [], []
        for k, (w, u) in enumerate(zip(self.w(theta), self.u(theta))):
            mine = (own == k).astype(float)
            z, e = batch.expected(u)
            loss += batch.total(mine * (batch.expected_scores(u - w, e) - z))
            grad_w.append(batch.expected_sum(p[:, k], found[k][1]) - batch.expected_sum(mine, e))
            grad_u.append(batch.covariance_product(u, u - w, mine, e))
        return loss, np.concatenate([*grad_w, *grad_u])


class MaxMarginBinary(Objective):
    binary, uses_em = True, True

    def decision(self, batch, theta):
        return batch.best(theta)[0]

    def partial(self, batch, theta):
        score, vectors = batch.best(theta)
        _, fixed = batch.best(self.fixed(theta))
        margin = np.where(batch.y == 1, batch.vectors_scores(theta, fixed), -score)
        short = margin < 1
        grad = batch.vectors_sum(np.where(short & (batch.y != 1), 1.0, 0.0), vectors) + batch.vectors_sum(np.where(short & (batch.y == 1), -1.0, 0.0), fixed)
        return batch.total(np.maximum(0, 1 - margin)), grad


class MaxMarginBinaryObs(Objective):
    binary, needs_lattice = True, False

    def decision(self, batch, theta):
        return batch.observed_scores(theta)

    def partial(self, batch, theta):
        y = self.signs(batch)
        margin = y * batch.observed_scores(theta)
        return batch.total(np.maximum(0, 1 - margin)), batch.observed_sum(np.where(margin < 1, -y, 0.0))


class MaxMarginMulti(Objective):
    uses_em = True

    def decision(self, batch, theta):
        return np.stack([batch.best(w)[0] for w in self.w(theta)], axis=1)

    def partial(self, batch, theta):
        found = [batch.best(w) for w in self.w(theta)]
        own = self.slots(batch)
        s = np.stack([z for z, _ in found], axis=1) + 1.0
        s[np.arange(batch.n), own] -= 1.0
        worst = s.argmax(axis=1)
        loss, grad = batch.total(s[np.arange(batch.n), worst]), []
        fixed_w = self.w(self.fixed(theta))
        for k, w in enumerate(self.w(theta)):
            mine = (own == k).astype(float)
            _, fixed = batch.best(fixed_w[k])
            loss -= batch.total(mine * batch.vectors_scores(w, fixed))
            grad.append(batch.vectors_sum((worst == k).astype(float), found[k][1]) - batch.vectors_sum(mine, fixed))
        return loss, np.concatenate(grad)


class _Pipeline(Objective):
    """Two layers: u scores alignments by latent features, w scores whole alignments by global features (phrase pairs, mismatches and bias)."""

    needs_u = True

    def candidates(self, batch: ExampleBatch, u: np.ndarray, k: int) -> list[list[tuple[dict, dict]]]:
        """For each pair the k best alignments under u: latent vector, global vector."""
        if self.impute is not None and k > 1:
            u = self.impute[self.width :].reshape(-1, self.spec.size)[0] if u is None else u
        out = []
        for p, found in enumerate(batch.lattice.k_best(batch.lattice.weigh(u), k)):
            rows = []
            for _, path in found:
                steps = [x for x in batch.lattice.steps(path) if x[0] != "None"]
                rows.append((batch.lattice.path_vector(path), self.global_vector([x[1] for x in steps], [x[2] for x in steps])))
            out.append(rows)
        return out

    def global_vector(self, s: list[str], t: list[str]) -> dict[int, float]:
        names = [*(f for a in range(1, self.spec.global_size + 1) for b in range(1, self.spec.global_size + 1) for f in phrase_pairs(s, t, a, b)), *(mismatches(s, t) if s else []), "Bias"]
        size, out = max(1, sum(x != "-" for x in s), sum(x != "-" for x in t)), {}
        for f in names:
            if f in self.spec.index:
                i = self.spec.index[f]
                out[i] = out.get(i, 0.0) + 1.0 / size
        return out

    @staticmethod
    def dot(w: np.ndarray, v: dict[int, float]) -> float:
        return float(sum(w[i] * x for i, x in v.items()))

    def best_global(self, w: np.ndarray, rows: list[tuple[dict, dict]]) -> tuple[float, dict]:
        scored = [(self.dot(w, g), g) for _, g in rows]
        return max(scored, key=lambda x: x[0]) if scored else (-np.inf, {})


class MaxMarginBinaryPipelineUW(_Pipeline):
    """Prediction only: the best alignment under u, scored by w."""

    binary = True

    def decision(self, batch, theta):
        w, u = self.w(theta)[0], self.u(theta)[0]
        return np.array([self.best_global(w, rows)[0] for rows in self.candidates(batch, u, 1)])

    def partial(self, batch, theta):
        raise NotImplementedError("the binary pipeline can't be trained")


class MaxMarginMultiPipelineUW(_Pipeline):
    uses_em = True

    def decision(self, batch, theta):
        return np.stack([[self.best_global(w, rows)[0] for rows in self.candidates(batch, self._list_u(theta, k), self.spec.k_best)] for k, w in enumerate(self.w(theta))], axis=1)

    def _list_u(self, theta: np.ndarray, k: int) -> np.ndarray:
        """Lists of alignments come from the fixed parameters while training."""
        return self.u(self.fixed(theta))[k]

    def partial(self, batch, theta):
        own, w, u = self.slots(batch), self.w(theta), self.u(theta)
        lists = [self.candidates(batch, self._list_u(theta, k), self.spec.k_best) for k in range(len(w))]
        loss, grad_w, grad_u = 0.0, np.zeros_like(w), np.zeros_like(u)
        fixed_u = self.u(self.fixed(theta))

        def add(to: np.ndarray, v: dict[int, float], c: float) -> None:
            for i, x in v.items():
                to[i] += c * x

        for i in range(batch.n):
            y, n = own[i], batch.copies[i]
            rows = lists[y][i]
            value, latent, glob = max(((self.dot(u[y], a) - self.dot(w[y], g), a, g) for a, g in rows), key=lambda x: x[0])
            held = max((a for a, _ in rows), key=lambda a: self.dot(fixed_u[y], a))
            rivals = [((k != y) + (best := self.best_global(w[k], lists[k][i]))[0], k, best[1]) for k in range(len(w))]
            score, k, rival = max(rivals, key=lambda x: x[0])
            loss += n * (value + score - self.dot(u[y], held))
            add(grad_u[y], latent, n)
            add(grad_w[y], glob, -n)
            add(grad_w[k], rival, n)
            add(grad_u[y], held, -n)
        return loss, np.concatenate([grad_w.ravel(), grad_u.ravel()])


#: Objectives by name.
OBJECTIVES = {
    "LogLinearBinary": LogLinearBinary, "LogLinearBinaryUnscaled": LogLinearBinaryUnscaled, "LogLinearBinaryObs": LogLinearBinaryObs,
    "LogLinearMulti": LogLinearMulti, "LogLinearMultiELFV": LogLinearMultiELFV, "LogLinearMultiELFV_sigmoid": LogLinearMultiELFVSigmoid, "LogLinearMultiUW": LogLinearMultiUW,
    "MaxMarginBinary": MaxMarginBinary, "MaxMarginBinaryObs": MaxMarginBinaryObs, "MaxMarginMulti": MaxMarginMulti,
    "MaxMarginBinaryPipelineUW": MaxMarginBinaryPipelineUW, "MaxMarginMultiPipelineUW": MaxMarginMultiPipelineUW,
}

#: Batches that a worker keeps between evaluations, by content; they can always be built again.
_KEPT: "OrderedDict[str, ExampleBatch]" = OrderedDict()
KEEP = 16


def _example_batch(objective: Objective, key: str, rows: list[tuple]) -> ExampleBatch:
    digest = hashlib.sha1(pickle.dumps((key, objective.needs_lattice, rows))).hexdigest()
    if digest in _KEPT:
        _KEPT.move_to_end(digest)
        return _KEPT[digest]
    batch = _KEPT[digest] = ExampleBatch(objective.spec, rows, objective.needs_lattice)
    while len(_KEPT) > KEEP:
        _KEPT.popitem(last=False)
    return batch


def together(examples: DataFrame) -> DataFrame:
    """Examples that are equal in all but their ids as one: the smallest id, the other columns, and copies, their number."""
    columns = [c for c in examples.columns if c not in ("id", "copies")]
    number = F.sum("copies") if "copies" in examples.columns else F.count("*")
    return examples.groupBy(*columns).agg(F.min("id").alias("id"), number.alias("copies")).select("id", *columns, "copies")


#: Different examples of a partition, at least.
PER_PARTITION = 64


@contextmanager
def different(examples: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """together(), kept meanwhile, and the partitions that are enough for so many: kept tables aren't coalesced by adaptive execution.

    Kept also because filters that are inferred from features would go below the grouping, to all copies. What has copies already comes
    from here and is left as it is."""
    if "copies" in examples.columns:
        yield examples, examples.count() // PER_PARTITION + 1
        return
    with kept(together(examples)) as found:
        parts = found.count() // PER_PARTITION + 1
        yield found.coalesce(parts), parts


def counted(examples: DataFrame) -> DataFrame:
    """Examples with a column copies."""
    return examples if "copies" in examples.columns else examples.withColumn("copies", F.lit(1).cast("long"))


def _batches(objective: Objective, key: str, rows: pa.RecordBatch, per_batch: int) -> Iterator[ExampleBatch]:
    """Examples of an Arrow batch: whole without lattices, else per_batch at a time."""
    if not objective.needs_lattice:
        yield ExampleBatch.of_columns(objective.spec, rows)
        return
    for a in range(0, rows.num_rows, per_batch):
        yield _example_batch(objective, key, list(zip(*(c.to_pylist() for c in rows.slice(a, per_batch).columns))))


def vectorize(examples: DataFrame, observed: DataFrame | None, dictionary: Dictionary) -> DataFrame:
    """id, source, target, y, obs_ids, obs_values: examples with their observed features by base id; and copies, if they have it."""
    copies = [c for c in examples.columns if c == "copies"]
    if observed is None:
        none = lambda t: F.expr(f"cast(array() as array<{t}>)")
        return examples.select("id", "source", "target", "y", none("int").alias("obs_ids"), none("double").alias("obs_values"), *copies)
    vectors = dictionary.transform(observed)
    return examples.join(vectors, "id", "left").select("id", "source", "target", "y", F.col("indices").alias("obs_ids"), F.col("values").alias("obs_values"), *copies)


def vectorize_columns(examples: DataFrame, values: dict[str, Column]) -> DataFrame:
    """vectorize() for features that every example has, each a column: base ids by byte order of the names. Nothing is shuffled."""
    names = sorted(values, key=str.encode)
    ids, held = F.array(*(F.lit(k) for k in range(len(names)))), F.array(*(values[n].cast("double") for n in names))
    return examples.select("id", "source", "target", "y", ids.alias("obs_ids"), held.alias("obs_values"), *(c for c in examples.columns if c == "copies"))


def gather_latent(examples: DataFrame, spec: ModelSpec, per_batch: int = 256) -> DataFrame:
    """feature: the names that the edges of all lattices show."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, per_batch):
                part, names = b.slice(a, per_batch), {}
                Batch(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), spec.machine, spec.latent, names, spec.options, spec.allowed, gather=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string())], ["feature"])

    return examples.select("source", "target").mapInArrow(kernel, "feature string").distinct()


class LocalLoss:
    """Average loss and gradient over rows on the driver (small data and tests). rows: source, target, y, obs_ids, obs_values, copies (one if left out)."""

    def __init__(self, objective: Objective, rows: list[tuple]):
        self.objective, self.n = objective, sum(map(_copies, rows))
        self.rows = rows
        self.batch = ExampleBatch(objective.spec, rows, objective.needs_lattice)

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        f, g = self.objective.partial(self.batch, theta)
        return f / self.n, g / self.n

    def subset(self, rows: np.ndarray) -> "LocalLoss":
        return LocalLoss(self.objective, [self.rows[i] for i in rows])

    def minibatch(self, buckets: int, k: int, seed: int = 0) -> "LocalLoss":
        """Copies of a row are dealt to one bucket after the other."""
        if buckets == 1:
            return self
        copies = np.array([_copies(r) for r in self.rows], np.int64)
        mine = copies // buckets + ((k - np.random.default_rng(seed).permutation(len(copies))) % buckets < copies % buckets)
        return LocalLoss(self.objective, [(*self.rows[i][:5], int(mine[i])) for i in np.flatnonzero(mine)])

    def fix(self, theta: np.ndarray | None) -> "LocalLoss":
        other = object.__new__(LocalLoss)
        other.__dict__.update(self.__dict__)
        other.objective = type(self.objective)(self.objective.spec, theta)
        return other


class DistributedLoss:
    """Average loss and gradient over a DataFrame of vectorize(): one job for each evaluation.

    Tasks sum over their batches and give out what isn't zero by coordinate; a grouped sum brings them together, so the driver
    receives one vector whatever the number of tasks."""

    def __init__(self, objective: Objective, examples: DataFrame, per_batch: int = 256):
        self.objective, self.examples, self.per_batch = objective, counted(examples), per_batch
        self.n = self.examples.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
        self.key = hashlib.sha1(pickle.dumps(objective.spec)).hexdigest()
        self.sent = examples.sparkSession.sparkContext.broadcast(objective)

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        shared, dim, key, per_batch = self.sent, self.objective.dim, self.key, self.per_batch
        sent = self.examples.sparkSession.sparkContext.broadcast(np.asarray(theta, float))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            objective, loss, grad = shared.value, 0.0, np.zeros(dim)
            for b in batches:
                for batch in _batches(objective, key, b, per_batch):
                    f, g = objective.partial(batch, sent.value)
                    loss += f
                    grad += g
            at = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at]), pa.int64()), pa.array(np.concatenate([[loss], grad[at]]))], ["idx", "val"])

        texts = ["source", "target"] if self.objective.needs_lattice else []
        parts = self.examples.select(*texts, "y", "obs_ids", "obs_values", "copies").mapInArrow(kernel, "idx long, val double")
        loss, grad = 0.0, np.zeros(dim)
        for r in parts.groupBy("idx").agg(F.sum("val").alias("val")).collect():
            if r.idx < 0:
                loss = r.val
            else:
                grad[r.idx] = r.val
        sent.unpersist()
        return loss / max(1, self.n), grad / max(1, self.n)

    def minibatch(self, buckets: int, k: int, seed: int = 0) -> "DistributedLoss":
        """The examples whose hash falls into bucket k of so many; copies are dealt to one bucket after the other."""
        if buckets == 1:
            return self
        away = F.pmod(F.lit(k) - F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)), F.lit(buckets))
        mine = F.floor(F.col("copies") / buckets) + (away < F.col("copies") % buckets).cast("long")
        return DistributedLoss(self.objective, self.examples.withColumn("copies", mine).filter("copies > 0"), self.per_batch)

    def fix(self, theta: np.ndarray | None) -> "DistributedLoss":
        other = object.__new__(DistributedLoss)
        other.__dict__.update(self.__dict__)
        other.objective = type(self.objective)(self.objective.spec, theta)
        other.sent = self.examples.sparkSession.sparkContext.broadcast(other.objective)
        return other


#: Rows up to which a loss is worked out on the driver, with and without lattices.
LOCAL_ROWS, LOCAL_LATTICES = 50_000, 512


def make_loss(objective: Objective, examples: DataFrame):
    """A loss over vectorize()d examples: on the driver if they are few, which saves a job for each evaluation, else on the cluster.

    Without lattices equal labels and vectors have equal losses, so they count as one if that makes them few. The examples are read
    several times; the caller keeps them."""
    examples, most = counted(examples), LOCAL_LATTICES if objective.needs_lattice else LOCAL_ROWS
    same = ["y", "obs_ids", "obs_values"]
    rows, different = examples.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*same))).first()
    few = None
    if rows <= most:
        few = sorted(examples.select("id", "source", "target", *same, "copies").collect(), key=lambda r: r.id)
    elif not objective.needs_lattice and different <= most:
        merged = examples.groupBy(*same).agg(F.min("id").alias("id"), F.sum("copies").alias("copies"))
        none = F.lit(None).cast("array<string>")
        found = merged.select("id", none.alias("source"), none.alias("target"), *same, "copies").limit(most + 1).collect()
        few = sorted(found, key=lambda r: r.id) if len(found) <= most else None
    return DistributedLoss(objective, examples) if few is None else LocalLoss(objective, [tuple(r)[1:] for r in few])


@contextmanager
def loss_of_different(objective: Objective, examples: DataFrame) -> Iterator[LocalLoss | DistributedLoss]:
    """make_loss() of together(): one job if few examples are different; many are kept meanwhile."""
    most = LOCAL_LATTICES if objective.needs_lattice else LOCAL_ROWS
    few = together(examples).select("id", "source", "target", "y", "obs_ids", "obs_values", "copies").limit(most + 1).collect()
    if len(few) <= most:
        yield LocalLoss(objective, [tuple(r)[1:] for r in sorted(few, key=lambda r: r.id)])
        return
    with different(examples) as (kept_examples, _):
        yield make_loss(objective, kept_examples)


def score_examples(objective: Objective, examples: DataFrame, thetas: list[np.ndarray], per_batch: int = 256) -> DataFrame:
    """model, id, y, label, score for every example, label and parameter vector; each lattice is built once for all vectors."""
    labels = (0, 1) if objective.binary else objective.spec.labels
    sent = examples.sparkSession.sparkContext.broadcast((objective, [np.asarray(t, float) for t in thetas]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objective, vectors = sent.value
        for b in batches:
            for a in range(0, b.num_rows, per_batch):
                part = b.slice(a, per_batch)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                batch = ExampleBatch(objective.spec, list(zip(*(c.to_pylist() for c in part.columns[1:]))), True) if objective.needs_lattice else ExampleBatch.of_columns(objective.spec, part)
                for m, theta in enumerate(vectors):
                    s = objective.scores(batch, theta)
                    n, k = s.shape
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n * k, m, np.int32)), pa.array(np.repeat(ids, k), pa.int64()), pa.array(np.repeat(batch.y, k), pa.int32()), pa.array(np.tile(labels, n), pa.int32()), pa.array(s.ravel())], ["model", "id", "y", "label", "score"])

    columns = ["source", "target", "y", "obs_ids", "obs_values"] if objective.needs_lattice else ["y", "obs_ids", "obs_values", "copies"]
    return counted(examples).select("id", *columns).mapInArrow(kernel, "model int, id long, y int, label int, score double")


def best_alignments(objective: Objective, examples: DataFrame, theta: np.ndarray, k: int = 1, per_batch: int = 64) -> DataFrame:
    """id, y, label, block: printed best alignments of every example and label."""
    labels = (1,) if objective.binary else objective.spec.labels
    rows = (objective.u(theta) if objective.needs_u else objective.w(theta)).copy()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, per_batch):
                ids, source, target, ys = (c.to_pylist() for c in b.slice(a, per_batch).columns)
                lattice = Batch(list(zip(source, target)), objective.spec.machine, objective.spec.latent, objective.spec.index, objective.spec.options, objective.spec.allowed)
                out = [(i, y, label, "".join(blocks)) for label, w in zip(labels, rows) for i, y, blocks in zip(ids, ys, lattice.blocks(lattice.weigh(w), k))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["id", "y", "label", "block"])

    return examples.select("id", "source", "target", "y").mapInArrow(kernel, "id long, y int, label int, block string")
