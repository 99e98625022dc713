import numpy as np
import pytest
from pyspark.sql import functions as F

from duolattice.functions.linalg import numerical_gradient
from duolattice.operators import observed
from duolattice.operators.dictionary import Dictionary
from duolattice.operators.latent import NoLatent, WordAlignment
from duolattice.operators.lattice import LatticeOptions
from duolattice.operators.machine import build
from duolattice.plans import objectives as J
from duolattice.plans import optimizers as O
from duolattice.plans import regularizers as R
from duolattice.plans import training as T

NAMES = {"Bias": 0, "S:Del1": 1, "S:Ins1": 2, "S:Rep11": 3}


@pytest.fixture(scope="module")
def spec():
    g = WordAlignment(align_ngrams=False, collapsed_ngrams=False, normalize=False)
    return J.ModelSpec(build(0), g, LatticeOptions(final_features=False), index=NAMES)


@pytest.fixture(scope="module")
def rows(he_tiny):
    return [(s, t, y, [0], [1.0]) for s, t, y in he_tiny]


@pytest.fixture(scope="module")
def observed_rows(spark, he_tiny):
    df = spark.createDataFrame([(i, s, t, y) for i, (s, t, y) in enumerate(he_tiny)], "id long, source array<string>, target array<string>, y int")
    values = observed.kr_word(df)
    d = Dictionary.fit(values, [1])
    index = {r.feature: r.base_id for r in d.features.collect()}
    vectors = J.vectorize(df, values, d)
    return index, [(r.source, r.target, r.y, r.obs_ids, r.obs_values) for r in vectors.orderBy("id").collect()], vectors


def test_known_losses_and_gradients(spec, rows):
    f, g = J.LocalLoss(J.LogLinearBinary(spec), rows)(np.array([1.0, 0, 0, 0]))
    assert f == pytest.approx(0.81326168751) and g == pytest.approx([0.23105857863, 1.12714370334, 0.91161441403, 0.39367847911])
    theta = np.zeros(8)
    theta[0] = 1
    f, g = J.LocalLoss(J.LogLinearMulti(spec), rows)(theta)
    half = [0.23105857863, 0.71278741450, 0.69725812519, 0.30803476795]
    assert f == pytest.approx(0.81326168751) and g == pytest.approx([*half, *(-x for x in half)])


def test_known_optima(spec, rows):
    r = O.lbfgs(R.Regularized(J.LocalLoss(J.LogLinearBinary(spec), rows), R.L2(0.1)), np.zeros(4), 1e-8)
    assert r.value == pytest.approx(0.67917812871, abs=1e-8) and r.status is O.Status.CONVERGED
    r = O.lbfgs(R.Regularized(J.LocalLoss(J.LogLinearMulti(spec), rows), R.L2(0.1)), np.random.default_rng(0).normal(0, 0.01, 8), 1e-8)
    assert r.value == pytest.approx(0.67414588974, abs=1e-7)


def test_known_observed_losses_and_optima(observed_rows):
    index, rows, _ = observed_rows
    spec = J.ModelSpec(build(0), NoLatent(), index=index)
    theta = np.zeros(686)
    theta[index["Bias"]] = 1
    logistic, hinge = (J.LocalLoss(J.OBJECTIVES[n](spec), rows) for n in ("LogLinearBinaryObs", "MaxMarginBinaryObs"))
    assert logistic(theta)[0] == pytest.approx(0.68330888445) and hinge(theta)[0] == pytest.approx(0.96922619047)
    assert O.lbfgs(R.Regularized(logistic, R.L2(0.1)), np.zeros(686), 1e-8).value == pytest.approx(0.576294765709, abs=1e-7)
    r = O.bmrm(hinge, np.zeros(686), 0.1, 1e-5)
    assert r.status is O.Status.CONVERGED and r.value == pytest.approx(0.503785233955, abs=1e-5)
    with pytest.raises(ValueError):
        J.LocalLoss(J.LogLinearBinary(spec), rows)


@pytest.mark.parametrize("name", [n for n in J.OBJECTIVES if n != "MaxMarginBinaryPipelineUW" and not n.endswith("Obs")])
def test_gradients_by_differences(spec, rows, name):
    objective = J.OBJECTIVES[name](spec)
    loss = J.LocalLoss(objective, rows)
    for seed in range(3):
        theta = np.random.default_rng(seed).normal(0, 0.3, objective.dim)
        fixed = loss.fix(theta * 0.9) if objective.uses_em else loss
        _, g = fixed(theta)
        assert [numerical_gradient(lambda x: fixed(x)[0], theta, i, 1e-5) for i in range(objective.dim)] == pytest.approx(g, abs=1e-6)


def test_two_models_with_equal_weights(spec, rows):
    w = np.random.default_rng(1).normal(0, 0.2, 8)
    uw, multi = J.LocalLoss(J.LogLinearMultiUW(spec), rows), J.LocalLoss(J.LogLinearMulti(spec), rows)
    assert uw(np.concatenate([w, w]))[0] == pytest.approx(multi(w)[0])
    assert np.allclose(uw.objective.decision(uw.batch, np.concatenate([w, w])), multi.objective.decision(multi.batch, w))


def test_binary_pipeline_predicts_only(spec, rows):
    o = J.MaxMarginBinaryPipelineUW(spec)
    batch = J.ExampleBatch(spec, rows)
    s = o.scores(batch, np.random.default_rng(1).normal(0, 1, o.dim))
    assert s.shape == (20, 2) and np.allclose(s[:, 0], -s[:, 1])
    with pytest.raises(NotImplementedError):
        o.partial(batch, np.zeros(o.dim))


def test_distributed_equals_local(spark, spec, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, source array<string>, target array<string>, y int, obs_ids array<int>, obs_values array<double>").repartition(3)
    for name in ("LogLinearMulti", "MaxMarginMulti"):
        o = J.OBJECTIVES[name](spec)
        theta = np.random.default_rng(2).normal(0, 0.3, o.dim)
        a, b = J.DistributedLoss(o, df, per_batch=4), J.LocalLoss(o, rows)
        fa, ga = a(theta)
        fb, gb = b(theta)
        assert fa == pytest.approx(fb) and np.allclose(ga, gb)
    assert sum(J.DistributedLoss(o, df).minibatch(3, k).n for k in range(3)) == 20
    scored = J.score_examples(o, df, [theta, np.zeros(o.dim)])
    assert scored.count() == 20 * 2 * 2
    blocks = J.best_alignments(o, df, theta, 1).collect()
    assert len(blocks) == 40 and all(b.block.startswith("Alignment 0") for b in blocks)


@pytest.mark.parametrize("name", [n for n in J.OBJECTIVES if n != "MaxMarginBinaryPipelineUW"])
def test_copies_count_as_often(spec, rows, name):
    objective = J.OBJECTIVES[name](spec)
    theta = np.random.default_rng(5).normal(0, 0.3, objective.dim)
    once = J.LocalLoss(objective, [(*r, 1 + i % 3) for i, r in enumerate(rows)])
    all_ = J.LocalLoss(objective, [r for i, r in enumerate(rows) for _ in range(1 + i % 3)])
    assert once.n == all_.n == 39
    (fa, ga), (fb, gb) = once(theta), all_(theta)
    assert fa == pytest.approx(fb) and np.allclose(ga, gb)
    assert sum(once.minibatch(3, k).n for k in range(3)) == 39


VECTORS = "id long, source array<string>, target array<string>, y int, obs_ids array<int>, obs_values array<double>, copies long"


def test_distributed_copies(spark, spec, rows):
    df = spark.createDataFrame([(i, *r, 1 + i % 3) for i, r in enumerate(rows)], VECTORS).repartition(3)
    for name in ("LogLinearBinaryObs", "MaxMarginBinaryObs", "LogLinearMulti"):
        o = J.OBJECTIVES[name](spec)
        theta = np.random.default_rng(2).normal(0, 0.3, o.dim)
        a, b = J.DistributedLoss(o, df), J.LocalLoss(o, [r for i, r in enumerate(rows) for _ in range(1 + i % 3)])
        (fa, ga), (fb, gb) = a(theta), b(theta)
        assert a.n == 39 and fa == pytest.approx(fb) and np.allclose(ga, gb)
    assert sum(a.minibatch(2, k).n for k in range(2)) == 39


def test_equal_vectors_are_one_example(spark, spec, rows, monkeypatch):
    monkeypatch.setattr(J, "LOCAL_ROWS", 10)
    o = J.OBJECTIVES["LogLinearBinaryObs"](spec)
    df = spark.createDataFrame([(i, *r, 1 + i % 3) for i, r in enumerate(rows)], VECTORS)
    loss, theta = J.make_loss(o, df), np.ones(4)
    assert isinstance(loss, J.LocalLoss) and len(loss.rows) == 2 and loss.n == 39
    assert loss(theta)[0] == pytest.approx(J.DistributedLoss(o, df)(theta)[0])
    apart = df.withColumn("obs_values", F.array(F.col("id").cast("double")))
    assert isinstance(J.make_loss(o, apart), J.DistributedLoss)


def test_regularizers():
    theta = np.random.default_rng(0).normal(0, 1, 6 + 3)
    tied = R.SoftTying(2, 3, False, 1.0, 0.5, 0.0, 0.3, 0.0)
    f, g = tied(theta)
    assert [numerical_gradient(lambda x: tied(x)[0], theta, i) for i in range(9)] == pytest.approx(g, abs=1e-6)
    free = R.SoftTying(2, 3, False, 1.0, 0.5, 0.0, 0.0, 0.0)
    theta[6:] = 0
    assert free(theta)[0] == pytest.approx(R.L2(0.5)(theta[:6])[0])
    assert R.SoftTying(2, 3, True, 2.0).betas == (2.0, 2.0, 0.0, 0.2) and len(R.SoftTying(2, 3, True).setup(np.zeros(12))) == 18
    with pytest.raises(ValueError):
        R.SoftTying(2, 3, w_beta=1.0)
    assert R.L2(1.0, w_beta=2.0, width=1)(np.array([1.0, 1.0]))[0] == 1.0 and R.NoRegularizer()(theta)[0] == 0


def test_simplex_problem():
    r = np.random.default_rng(4)
    a = r.normal(0, 1, (6, 6))
    gram, b = a @ a.T + 1e-3 * np.eye(6), r.normal(0, 1, 6)
    x = O.simplex_qp(gram, b)
    slope = gram @ x - b
    assert x.sum() == pytest.approx(1) and (x >= 0).all() and np.allclose(slope[x > 1e-9], slope.min(), atol=1e-5)


def test_bundle_method_closes_its_gap():
    """It ends by the gap, long before its iterations do, and where L-BFGS ends."""
    x, t = np.array([[1 / 12, 5 / 12], [1 / 30, 1.0], [1 / 7, 3 / 7]]), np.array([1.0, -1.0, -1.0])

    def loss(theta):
        m = t * (x @ theta)
        return float(np.log1p(np.exp(-m)).mean()), -(t / (1 + np.exp(m))) @ x / 3

    best = O.lbfgs(R.Regularized(loss, R.L2(0.01)), np.zeros(2), 1e-9)
    for scale in (1, 30):
        r = O.bmrm(lambda theta: (lambda f, g: (f, scale * g))(*loss(scale * theta)), np.zeros(2), 0.01 * scale**2, 1e-13, 200)
        assert r.status is O.Status.CONVERGED and r.iterations < 80
        assert r.value == pytest.approx(best.value, abs=1e-12) and np.allclose(scale * r.theta, best.theta, atol=1e-5)


def test_other_optimizers(spec, rows):
    loss = J.LocalLoss(J.LogLinearBinary(spec), rows)
    parts = [loss.subset(np.arange(k, 20, 4)) for k in range(4)]
    r = O.sgd(lambda k, e: parts[k], np.zeros(4), 0.1, 4, 0.05, 120, validation=O.Validation(lambda t: -loss(t)[0], every=10))
    assert loss(r.theta)[0] + 0.05 * r.theta @ r.theta < 0.69
    assert O.estimate_rate(loss, np.zeros(4), 0.1) > 0
    m = O.lbfgs_minibatch(lambda k, e: R.Regularized(parts[k], R.L2(0.1)), np.zeros(4), 4, 2)
    assert np.isfinite(m.value)
    v = O.Validation(lambda t: 0.5, patience=2)
    assert not v.evaluate(np.zeros(1), 1) and not v.evaluate(np.zeros(1), 2) and v.evaluate(np.zeros(1), 3)


def test_alternation_goes_down(spec, rows):
    loss, reg = J.LocalLoss(J.MaxMarginMulti(spec), rows), R.L2(0.1)
    r = O.em(loss, np.random.default_rng(0).normal(0, 0.01, 8), lambda fixed, x: O.bmrm(fixed, x, 0.1, 1e-4), lambda fixed, x: fixed(x)[0] + reg(x)[0], max_iters=5)
    assert all(b <= a + 1e-3 for a, b in zip(r.history, r.history[1:])) and r.status is not O.Status.FAILURE


@pytest.fixture(scope="module")
def examples(spark, he_tiny):
    return spark.createDataFrame([(i, s, t, y) for i, (s, t, y) in enumerate(he_tiny)], "id long, source array<string>, target array<string>, y int").persist()


C = T.Config(no_collapsed_align_ngrams=True, beta=0.01, max_iters=8, init="zero", tolerance=1e-3)


def test_feature_count_with_alignment_unigrams(examples):
    dictionary, spec = T.gather(examples, C, T.model_spec(T.Config(no_collapsed_align_ngrams=True, no_final_arc_feats=True), (0, 1)))
    assert dictionary.size == 280  # and a bias makes it 281


def test_training_and_evaluation(spark, examples, tmp_path):
    trained = T.train(examples, C)
    m = trained.evaluate(examples)
    assert m["n"] == 20 and m["accuracy"] >= 0.7
    again = T.resume(spark, examples, C, str(tmp_path / "model"))
    loaded = T.resume(spark, examples, C, str(tmp_path / "model"))
    assert np.allclose(again.theta, loaded.theta) and loaded.result is None
    assert T.evaluate_models([trained, loaded], examples)[1]["n"] == 20
    next_ = T.staged(trained, examples, C)
    assert next_.result.history[0] <= trained.result.history[0]


OPTIONS = {
    "train_svm_obs": dict(model="MaxMarginBinaryObs", latent="Empty", observed="KRWord", beta=0.1, max_iters=6, init="zero", tolerance=1e-3),
    "train_logreg_obs": dict(model="LogLinearBinaryObs", latent="Empty", observed="KRWord", beta=0.1, max_iters=6, init="zero", tolerance=1e-3),
    "train_latent_multi": dict(model="LogLinearMulti", no_collapsed_align_ngrams=True, exact_match_state=True, beta=0.1, max_iters=4, init="zero", tolerance=1e-2),
}


@pytest.mark.parametrize("name", OPTIONS)
def test_repeated_examples_train_as_one(examples, name, monkeypatch):
    """Features, losses and scores of equal examples are worked out once; sums and measures take all of them."""
    losses, made = [], T.make_loss
    monkeypatch.setattr(T, "make_loss", lambda *a: losses.append(made(*a)) or losses[-1])
    again = examples.select((F.col("id") + 20).alias("id"), "source", "target", "y")
    c = T.Config(**OPTIONS[name])
    one, two = T.train(examples, c), T.train(examples.unionByName(again), c)
    assert [(len(x.rows), x.n) for x in losses] == [(20, 20), (20, 40)]
    assert one.result.value == pytest.approx(two.result.value, rel=1e-6) and np.allclose(one.theta, two.theta, atol=1e-5)
    both = examples.unionByName(again.withColumn("y", 1 - F.col("y")))
    with two.scored(both) as scores:
        found = {(r.id, r.label): (r.y, r.score) for r in scores.collect()}
    plain = {(r.id, r.label): (r.y, r.score) for r in two.scores(both).collect()}
    assert len(found) == 80 and found.keys() == plain.keys() and all(found[k] == (plain[k][0], pytest.approx(plain[k][1])) for k in plain)
    assert two.evaluate(both)["n"] == 40 and two.evaluate(both)["accuracy"] == 0.5


def test_grid_and_splits(examples):
    out = T.grid_search(examples, C, [1e-1], [0.1, 1.0], examples)
    assert [b for _, b, _, _ in out][0] == 1.0 and all(m["n"] == 20 for *_, m in out)
    a, b = T.split_selected(examples, 0.5)
    assert a.count() == b.count() == 10


def test_active_learning(examples):
    seed, pool = examples.filter("id < 5 or id >= 15"), examples.filter("id >= 5 and id < 15")
    trained, moved = T.active_learning(seed, pool, T.Config(model="LogLinearBinaryObs", latent="Empty", observed="KRWord", beta=0.1, max_iters=3, init="zero"), 2)
    assert len(set(moved)) == 2 and set(moved) <= set(range(5, 15))


def test_two_layers(examples):
    trained = T.two_layer(examples, T.Config(model="MaxMarginMultiPipelineUW", no_collapsed_align_ngrams=True, exact_match_state=True, beta=0.1, max_iters=3, em_iters=1, init="zero", k_best=2, tolerance=0.1))
    assert trained.evaluate(examples)["n"] == 20


def test_options():
    assert T.Config.from_options(order=1).order == 1
    for bad in ({"nothing": 1}, {"model": "x"}, {"latent": "Empty"}, {"sample_cooc_n": 3}, {"model": "MaxMarginMulti", "regularizer": "None"}, {"order": 3}):
        with pytest.raises(ValueError):
            T.Config.from_options(**bad)


def test_streams(spark, examples, tmp_path):
    from duolattice.streaming.scoring import score_stream

    trained = T.train(examples, C)
    examples.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(examples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = score_stream(stream, trained, lambda df, n: seen.extend((n, r.id) for r in df.collect()), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(i for _, i in seen) == list(range(20))


@pytest.mark.parametrize("name", ["train_logreg_obs", "train_latent_multi"])
def test_training_queries_read_their_table_once(spark, tmp_path, monkeypatch, name):
    """Pairs are grouped once, for training and measures; the measures need no rank of every pair, and are those of all pairs."""
    from duolattice import queries as Q

    part = spark.createDataFrame([(1, "large ring", "LARGE"), (2, "hot bolt", "ECONOMY"), (3, "plate", "Plates"), (4, "a much longer name", "X"), (5, "plate", "X")], "p_partkey long, p_name string, p_type string")
    part = part.crossJoin(spark.range(4)).filter("p_partkey > id").select((F.col("p_partkey") + 10 * F.col("id")).alias("p_partkey"), "p_name", "p_type")
    part.write.parquet(str(tmp_path / "part.parquet"))
    pairs = Q.part_pairs(spark, str(tmp_path))
    models, grouped, made, together = [], [], Q.train, J.together
    monkeypatch.setattr(Q, "train", lambda *a: models.append(made(*a)) or models[-1])
    monkeypatch.setattr(J, "together", lambda df: grouped.append(df) or together(df))
    with monkeypatch.context() as held:
        held.delattr(T.metrics, "precision_recall")
        found = Q.QUERIES[name](spark, str(tmp_path)).first()
    assert len(grouped) == 1
    whole = models[0].evaluate(pairs)
    assert whole.pop("avg_precision") is not None and whole["n"] == 14
    assert whole == models[0].classified(pairs) and (found.accuracy, found.f1) == (whole["accuracy"], whole["f1"])


def test_some_hundred_lattices_need_no_job(spark, spec, he_tiny):
    df = spark.createDataFrame([(20 * k + i, s, t, y) for k in range(20) for i, (s, t, y) in enumerate(he_tiny)], "id long, source array<string>, target array<string>, y int")
    loss = J.make_loss(J.LogLinearMulti(spec), J.vectorize(df, None, None))
    assert isinstance(loss, J.LocalLoss) and loss.n == 400
