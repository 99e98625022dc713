"""Entry points: training, evaluation, grids, resuming, staged training, active learning and the two-layer pipeline."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments, metrics
from ..operators.dictionary import Dictionary, init_weights, transfer_weights
from ..operators.latent import LATENT
from ..operators.lattice import LatticeOptions
from ..operators.machine import Allowed, build
from ..operators.observed import OBSERVED, observed_features
from ..sources import pairs as files
from .objectives import LOCAL_ROWS, OBJECTIVES, ModelSpec, different, gather_latent, make_loss, score_examples, vectorize
from .optimizers import Result, Status, Validation, bmrm, default_optimizer, em, estimate_rate, lbfgs, lbfgs_minibatch, sgd
from .regularizers import L2, NoRegularizer, Regularized, SoftTying


@dataclass(frozen=True)
class Config:
    """All options by name; an unknown one is an error (see from_options)."""

    model: str = "LogLinearMulti"
    reader: str = "WordPair"
    latent: str = "WordAlignment"
    observed: str = "Empty"
    optimizer: str = "Auto"
    regularizer: str = "L2"
    tolerance: float = 1e-4
    beta: float = 1.0
    w_beta: float | None = None
    u_beta: float | None = None
    shared_w_beta: float | None = None
    shared_u_beta: float | None = None
    order: int = 0
    phrase_source: int = 1
    phrase_target: int = 1
    exact_match_state: bool = False
    allow_redundant: bool = False
    identical_unigrams_only: bool = False
    no_final_arc_feats: bool = False
    start_arc: bool = False
    add_begin_end: bool = False
    no_align_ngrams: bool = False
    align_unigrams_only: bool = False
    no_collapsed_align_ngrams: bool = False
    no_state_ngrams: bool = False
    state_unigrams_only: bool = False
    bigram_features: bool = False
    window_size: int = 0
    vowels: str = ""
    no_normalize: bool = False
    substring_size: int = 2
    offset_size: int = 1
    encode_offset: bool = False
    ignore_epsilon: bool = False
    observed_no_normalize: bool = False
    bias: bool = True
    ned: bool = False
    no_mismatches: bool = False
    k_best: int = 5
    sample_cooc_n: int = 0
    init: str = "noise"
    init_noise: float = 0.01
    seed: int = 0
    max_iters: int = 250
    em_iters: int = 20
    minibatches: int = 10
    learning_rate: float | None = 0.01
    epochs: int = 250
    nglex_source: frozenset | None = None
    nglex_target: frozenset | None = None

    def __post_init__(self):
        known = {"model": OBJECTIVES, "latent": LATENT, "observed": OBSERVED, "reader": files.READERS, "optimizer": ("Auto", "Lbfgs", "LbfgsMinibatch", "Bmrm", "StochasticGradient"), "regularizer": ("L2", "None", "SoftTying")}
        for name, values in known.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name}: {getattr(self, name)} is not one of {sorted(values)}")
        if self.latent == self.observed == "Empty":
            raise ValueError("latent and observed features can't both be empty")
        if self.sample_cooc_n:
            raise ValueError("sampling of co-occurrences is not supported")
        if self.model.startswith("MaxMargin") and self.regularizer != "L2":
            raise ValueError("max-margin models need the L2 regularizer")
        if self.order not in (0, 1, 2):
            raise ValueError("order must be 0, 1 or 2")

    @classmethod
    def from_options(cls, **options) -> "Config":
        unknown = options.keys() - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return cls(**options)


@dataclass
class Trained:
    config: Config
    spec: ModelSpec
    dictionary: Dictionary
    theta: np.ndarray
    result: Result | None = None

    @property
    def objective(self):
        return OBJECTIVES[self.config.model](self.spec)

    def vectorized(self, examples: DataFrame) -> DataFrame:
        return vectorize(examples, observed(examples, self.config), self.dictionary)

    def scores(self, examples: DataFrame) -> DataFrame:
        return score_examples(self.objective, self.vectorized(examples), [self.theta])

    @contextmanager
    def scored(self, examples: DataFrame, thetas: list[np.ndarray] | None = None) -> Iterator[DataFrame]:
        """model, id, y, label, score by these weights (the model's own if left out), to be read meanwhile. Examples that are equal but
        for id and label are scored once, and each gets these scores; ids must be different."""
        columns = [c for c in examples.columns if c not in ("id", "y", "copies")]
        with different(examples.select("id", *columns)) as (pairs, parts):
            vectors = self.vectorized(pairs.withColumn("y", F.lit(0))).coalesce(parts)
            found = score_examples(self.objective, vectors, thetas or [self.theta])
            sets = found.groupBy(F.col("id").alias("__first")).agg(F.collect_list(F.struct("model", "label", "score")).alias("__scores"))
            named = pairs.select(F.col("id").alias("__first"), *(F.col(c).alias(f"__{c}") for c in columns)).join(sets, "__first")
            # Few go to the examples, which then stay where they lie.
            named = F.broadcast(named) if pairs.count() <= LOCAL_ROWS else named
            joined = examples.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
            yield joined.select("id", "y", F.inline("__scores")).select("model", "id", "y", "label", "score")

    def evaluate(self, examples: DataFrame) -> dict[str, float]:
        with self.scored(examples) as scores:
            return metrics.evaluate(scores)

    def classified(self, examples: DataFrame) -> dict[str, float]:
        """As evaluate(), without the average precision, which ranks every example: equal examples are predicted once and counted as often as they come."""
        with different(examples) as (pairs, parts):
            scores = score_examples(self.objective, self.vectorized(pairs).coalesce(parts), [self.theta])
            predictions = metrics.predict_labels(scores).join(pairs.select("id", "copies"), "id")
            return metrics.classification_metrics(predictions).first().asDict()

    def save(self, spark: SparkSession, folder: str) -> None:
        files.write_dictionary(self.dictionary.features, self.dictionary.labels, f"{folder}/features")
        files.write_weights(self.theta, spark, f"{folder}/weights")
        spark.createDataFrame([(str(self.config),)], "value string").write.mode("overwrite").text(f"{folder}/options")


def observed(examples: DataFrame, c: Config) -> DataFrame | None:
    """Rows of observed features by the configured generator."""
    common = {"normalize": not c.observed_no_normalize, "markers": c.add_begin_end}
    if c.observed == "Empty" or c.model.endswith("PipelineUW"):
        return None
    if c.observed == "Bias":
        return observed_features(examples, "Bias", **common)
    if c.observed.startswith("KR"):
        return observed_features(examples, c.observed, **common, bias=c.bias, size=c.substring_size, offset=c.offset_size, encode_offset=c.encode_offset, ignore_epsilon=c.ignore_epsilon, vowels=c.vowels)
    extra = {"size": c.substring_size} if c.observed == "BKWord" else {}
    return observed_features(examples, c.observed, **common, bias=c.bias, ned=c.ned, add_mismatches=not c.no_mismatches, **extra)


def model_spec(c: Config, labels: tuple[int, ...]) -> ModelSpec:
    """The model without its dictionary."""
    machine = build(c.order, c.phrase_source, c.phrase_target, c.exact_match_state, c.allow_redundant, c.identical_unigrams_only)
    common = {"order": c.order, "align_ngrams": not c.no_align_ngrams, "align_unigrams_only": c.align_unigrams_only, "state_ngrams": not c.no_state_ngrams, "normalize": not c.no_normalize}
    if c.latent == "WordAlignment":
        latent = LATENT[c.latent](**common, collapsed_ngrams=not c.no_collapsed_align_ngrams, state_unigrams_only=c.state_unigrams_only, bigrams=c.bigram_features, window=c.window_size, vowels=c.vowels)
    else:
        latent = LATENT[c.latent](**common) if c.latent == "SentenceAlignment" else LATENT[c.latent]()
    allowed = Allowed(source_lexicon=c.nglex_source, target_lexicon=c.nglex_target) if c.nglex_source or c.nglex_target else None
    return ModelSpec(machine, latent, LatticeOptions(c.start_arc, not c.no_final_arc_feats, c.add_begin_end), allowed, {}, labels, c.k_best, c.substring_size)


def gather(examples: DataFrame, c: Config, spec: ModelSpec) -> tuple[Dictionary, ModelSpec]:
    """The dictionary of all features of the examples (binary models: of those with label 1), and the model with it.

    Models of observed features alone leave the names in the dictionary's table. Others send them to every task, so their number
    is bounded by MAX_INDEX; the weights, of which each label has as many, are on the driver in any case."""
    objective = OBJECTIVES[c.model]
    seen = examples
    names = []
    if (found := observed(seen, c)) is not None:
        names.append(found.select("feature"))
    if spec.has_latent and objective.needs_lattice:
        names.append(gather_latent(seen, spec))
    if c.model.endswith("PipelineUW"):
        from ..operators.alignment import align

        names.append(observed_features(align(seen, 3), "BKWord", size=c.substring_size).select("feature"))
    together = names[0]
    for n in names[1:]:
        together = together.unionByName(n)
    dictionary = Dictionary.fit(together, [1] if objective.binary else list(spec.labels))
    return dictionary, with_index(spec, dictionary, objective)


#: Feature names that go to every task, at most.
MAX_INDEX = 2_000_000


def with_index(spec: ModelSpec, dictionary: Dictionary, objective: type) -> ModelSpec:
    """The model with the dictionary's size, and with its names if its kernels need them."""
    if not objective.needs_lattice:
        return replace(spec, n_features=dictionary.size)
    if dictionary.size > MAX_INDEX:
        raise ValueError(f"{dictionary.size} feature names are more than {MAX_INDEX}; leave out n-grams or windows, or lower the order")
    return replace(spec, index={r.feature: r.base_id for r in dictionary.features.toLocalIterator()}, n_features=dictionary.size)


def _regularizer(c: Config, objective, beta: float):
    if c.regularizer == "None":
        return NoRegularizer()
    if c.regularizer == "SoftTying":
        return SoftTying(1 if objective.binary else len(objective.spec.labels), objective.spec.size, objective.needs_u, beta, c.w_beta, c.u_beta, c.shared_w_beta, c.shared_u_beta)
    return L2(beta, c.w_beta, c.u_beta, objective.width)


def optimize(loss, c: Config, theta: np.ndarray, beta: float, tolerance: float, validation: Validation | None = None) -> Result:
    """One training run from theta over a loss (distributed or local)."""
    objective = loss.objective
    name = default_optimizer(c.model) if c.optimizer == "Auto" else c.optimizer
    reg = _regularizer(c, objective, beta)

    def convex(inner, start: np.ndarray) -> Result:
        if name == "Bmrm":
            return bmrm(inner, start, beta, tolerance, c.max_iters, validation=validation)
        if name == "StochasticGradient":
            rate = c.learning_rate or estimate_rate(inner, start, beta)
            return sgd(lambda k, e: inner.minibatch(c.minibatches, k, e), start, beta, c.minibatches, rate, c.epochs, c.seed, validation)
        if name == "LbfgsMinibatch":
            return lbfgs_minibatch(lambda k, e: Regularized(inner.minibatch(c.minibatches, k, e), reg), start, c.minibatches, validation=validation)
        whole = reg.setup(start, c.seed)
        r = lbfgs(Regularized(inner, reg), whole, tolerance, c.max_iters, validation=validation)
        r.theta = r.theta[: objective.dim]
        return r

    if not objective.uses_em:
        return convex(loss, theta)
    return em(loss, theta, convex, lambda fixed, x: fixed(x)[0] + reg(x)[0], tolerance, c.em_iters)


def prepare(examples: DataFrame, c: Config, dictionary: Dictionary | None = None, parts: int | None = None) -> tuple[Dictionary, ModelSpec, DataFrame]:
    """Dictionary, model and vectors, these in so many partitions at most."""
    labels = tuple(sorted(r.y for r in examples.select("y").distinct().collect()))
    if not OBJECTIVES[c.model].binary and (len(labels) < 2 or labels != tuple(range(len(labels)))):
        raise ValueError(f"labels must be 0 to k - 1 with k of at least 2, not {labels}")
    spec = model_spec(c, labels)
    if dictionary is None:
        dictionary, spec = gather(examples, c, spec)
    else:
        spec = with_index(spec, dictionary, OBJECTIVES[c.model])
    vectors = vectorize(examples, observed(examples, c), dictionary)
    return dictionary, spec, (vectors if parts is None else vectors.coalesce(parts)).persist()


def train(examples: DataFrame, c: Config, dictionary: Dictionary | None = None, theta0: np.ndarray | None = None, validation: Validation | None = None) -> Trained:
    """Gathers features, sets initial weights, and optimizes. Equal examples are one, with their number."""
    with different(examples) as (pairs, parts):
        dictionary, spec, vectors = prepare(pairs, c, dictionary, parts)
        objective = OBJECTIVES[c.model](spec)
        start = initial(dictionary, c, objective) if theta0 is None else theta0
        result = optimize(make_loss(objective, vectors), c, start, c.beta, c.tolerance, validation)
        vectors.unpersist()
    theta = validation.best_theta if validation is not None and validation.best_theta is not None else result.theta
    return Trained(c, spec, dictionary, theta, result)


def initial(dictionary: Dictionary, c: Config, objective) -> np.ndarray:
    parts = [init_weights(c.init, dictionary, c.init_noise, c.seed + k) for k in range(2 if objective.needs_u else 1)]
    return np.concatenate(parts)


def grid_search(examples: DataFrame, c: Config, tolerances: list[float], betas: list[float], evaluation: DataFrame | None = None, early_stop: bool = True) -> list[tuple[float, float, Trained, dict | None]]:
    """Every tolerance with every beta, both from the largest down, each from the same initial weights; the features are gathered
    once. When the convex solver runs out of iterations, the other betas of that tolerance are left out."""
    with different(examples) as (pairs, parts):
        dictionary, spec, vectors = prepare(pairs, c, parts=parts)
        objective = OBJECTIVES[c.model](spec)
        start, loss, out = initial(dictionary, c, objective), make_loss(objective, vectors), []
        for tolerance in sorted(tolerances, reverse=True):
            for beta in sorted(betas, reverse=True):
                result = optimize(loss, c, start, beta, tolerance)
                trained = Trained(replace(c, beta=beta, tolerance=tolerance), spec, dictionary, result.theta, result)
                out.append((tolerance, beta, trained, trained.evaluate(evaluation) if evaluation is not None else None))
                if early_stop and result.status is Status.MAX_ITERS_CONVEX:
                    break
        vectors.unpersist()
    return out


def evaluate_models(models: list[Trained], examples: DataFrame) -> list[dict[str, float]]:
    """Measures of several weight vectors of one model in one scoring pass."""
    with models[0].scored(examples, [m.theta for m in models]) as found, metrics.kept(found) as scores:
        return [metrics.evaluate(scores.filter(F.col("model") == k)) for k in range(len(models))]


def staged(first: Trained, examples: DataFrame, c: Config) -> Trained:
    """Trains a model that starts from an earlier one's weights, by feature name and label."""
    dictionary, spec, vectors = prepare(examples, c)
    vectors.unpersist()
    objective, before = OBJECTIVES[c.model](spec), first.objective
    parts = [transfer_weights(first.dictionary, first.theta[k * before.width : (k + 1) * before.width], dictionary) if k == 0 or before.needs_u else np.zeros(dictionary.dim) for k in range(2 if objective.needs_u else 1)]
    return train(examples, c, dictionary, np.concatenate(parts))


def resume(spark: SparkSession, examples: DataFrame, c: Config, folder: str) -> Trained:
    """The model saved in a folder if there is one, else a new one, saved there."""
    try:
        features, labels = files.read_dictionary(spark, f"{folder}/features")
        weights = files.read_weights(spark, f"{folder}/weights")
        rows = weights.collect()
    except Exception as e:  # Spark says so when a path doesn't exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        trained = train(examples, c)
        trained.save(spark, folder)
        return trained
    dictionary = Dictionary(features, labels, features.count())
    spec = with_index(model_spec(c, tuple(labels)), dictionary, OBJECTIVES[c.model])
    theta = np.zeros(OBJECTIVES[c.model](spec).dim)
    for r in rows:
        theta[r.idx] += r.weight
    return Trained(c, spec, dictionary, theta)


def active_learning(examples: DataFrame, pool: DataFrame, c: Config, rounds: int, sample: float | None = None) -> tuple[Trained, list[int]]:
    """Each round trains from the start and moves the pool's example of the highest score for label 1 to the training set."""
    chosen: list[int] = []
    columns = examples.columns
    for k in range(rounds + 1):
        moved = pool.filter(F.col("id").isin(chosen)).select(*columns) if chosen else None
        trained = train(examples if moved is None else examples.unionByName(moved), c)
        if k == rounds:
            return trained, chosen
        left = pool.filter(~F.col("id").isin(chosen)) if chosen else pool
        if sample is not None:
            left = left.filter(F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1000)) < int(1000 * sample))
        best = trained.scores(left).filter("label = 1").orderBy(F.desc("score"), "id").limit(1).collect()
        if not best:
            return trained, chosen
        chosen.append(best[0].id)
    raise AssertionError


def two_layer(examples: DataFrame, c: Config, rounds: int = 1) -> Trained:
    """First a latent model gives u; then the pipeline objective trains w and u over the lists of best alignments, `rounds` times anew."""
    base = train(examples, replace(c, model="MaxMarginMulti" if "Multi" in c.model else "MaxMarginBinary"))
    dictionary, spec, vectors = prepare(examples, c)
    vectors.unpersist()
    u = transfer_weights(base.dictionary, base.theta, dictionary)
    theta = np.concatenate([np.zeros(len(u)), u])
    if OBJECTIVES[c.model].binary:
        return Trained(c, spec, dictionary, theta)
    for _ in range(rounds):
        trained = train(examples, c, dictionary, theta)
        theta = trained.theta
    return trained


def split_selected(examples: DataFrame, size: float, **options) -> tuple[DataFrame, DataFrame]:
    """Training rows and the others, by experiments.sample_train."""
    marked = experiments.sample_train(examples, size, **options)
    return marked.filter("selected").drop("selected"), marked.filter("not selected").drop("selected")


def option_grid(**options: list) -> list[dict]:
    return [dict(zip(options, c)) for c in itertools.product(*options.values())]
