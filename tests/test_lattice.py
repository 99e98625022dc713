import itertools
import math
import random

import numpy as np
import pytest

from duolattice.operators import lattice as L
from duolattice.operators.latent import SentenceAlignment, WordAlignment
from duolattice.operators.machine import Allowed, build

PLAIN = WordAlignment(align_ngrams=False, collapsed_ngrams=False, normalize=False)
NO_FINAL = L.LatticeOptions(final_features=False)


def batch(pairs, machine, generator, names, options=NO_FINAL, allowed=None):
    index = {n: i for i, n in enumerate(names)}
    b = L.Batch(pairs, machine, generator, index, options, allowed)
    return b, b.weigh(np.array(list(names.values()), float))


def all_paths(b, p=0):
    """Every path of a pair, by brute force."""
    leaving = {}
    for e in np.flatnonzero(b.pair == p):
        leaving.setdefault(int(b.src[e]), []).append(int(e))

    def walk(node):
        if node == b.goal[p]:
            yield []
        for e in leaving.get(node, []):
            for rest in walk(int(b.dst[e])):
                yield [e, *rest]

    return list(walk(int(b.root[p])))


def stress():
    g = WordAlignment(order=1, align_ngrams=False, collapsed_ngrams=False, state_unigrams_only=True, normalize=False)
    names = {"S:Del1": -100, "S:Ins1": -100, "S:Sub11": -100, "S:Mat11": 0}
    return batch([(list("stress"), list("sutoressu"))], build(1, exact_match=True), g, names)


def test_known_pair():
    b, w = stress()
    z, e = b.expected(w)
    assert z[0] == pytest.approx(-300) and b.viterbi(w)[0][0] == pytest.approx(-300)
    assert dict(zip(b.place_id.tolist(), e.round(6).tolist())) == {0: 0, 1: 3, 2: 0, 3: 6}
    assert np.log(e[0]) - 300 == pytest.approx(-497.9206, abs=1e-3) and np.log(e[2]) - 300 == pytest.approx(-398.2082, abs=1e-3)
    assert b.blocks(w)[0][0] == "Alignment 0 ( weight = -300 ):\nMat11 Ins1 Mat11 Ins1 Mat11 Mat11 Mat11 Mat11 Ins1 \n|s| |t| |r|e|s|s| \n|s|u|t|o|r|e|s|s|u\n"
    active, second = b.cooccurrences(w)[0]
    logs = np.log(second) - 300
    assert active.tolist() == [0, 1, 2, 3] and logs[1, 1] == pytest.approx(-297.803, abs=1e-3) and logs[3, 3] == pytest.approx(-296.416, abs=1e-3)


def test_two_tokens():
    b, w = batch([(["t"], ["u"])], build(0, exact_match=True), PLAIN, {"S:Del1": -1, "S:Ins1": -2, "S:Sub11": -3})
    assert b.log_partition(w)[0] == pytest.approx(-1.90138771133189)
    z, e = b.expected(w)
    _, second = b.cooccurrences(w)[0]
    # Two of three equally likely paths delete and insert.
    assert np.allclose(e, [2 / 3, 2 / 3, 1 / 3]) and np.allclose(second, [[2 / 3, 2 / 3, 0], [2 / 3, 2 / 3, 0], [0, 0, 1 / 3]])
    bias = math.exp(z[0])
    assert bias - bias**2 == pytest.approx(0.1270522, abs=1e-6)  # covariance of a bias from sums that are not normalised


@pytest.mark.parametrize("n, paths", [(1, 3), (2, 13), (3, 63)])
def test_number_of_alignments(n, paths):
    b, _ = batch([([f"a{i}" for i in range(n)], [f"b{i}" for i in range(n)])], build(0), PLAIN, {})
    assert math.exp(b.log_partition(np.zeros(len(b.edges)))[0]) == pytest.approx(paths)


@pytest.mark.parametrize("order, match, redundant, source, target", [(0, False, False, 1, 1), (1, True, False, 1, 1), (1, False, True, 2, 2), (2, True, False, 1, 1), (2, False, True, 1, 1), (0, True, False, 2, 1)])
def test_against_all_paths(order, match, redundant, source, target):
    rng = random.Random(order * 7 + match)
    machine = build(order, source, target, match, redundant)
    g = WordAlignment(order=order, normalize=True)
    pairs = [(rng.choices("ab", k=rng.randint(1, 3)), rng.choices("ab", k=rng.randint(1, 3))) for _ in range(5)]
    index: dict = {}
    L.Batch(pairs, machine, g, index, L.LatticeOptions(start_arc=True), gather=True)
    b = L.Batch(pairs, machine, g, index, L.LatticeOptions(start_arc=True))
    w = b.weigh(np.random.default_rng(3).normal(0, 1, len(index)))
    z, e = b.expected(w)
    best, chosen = b.viterbi(w)
    top = b.k_best(w, 4)
    second = b.cooccurrences(w)
    for p in range(len(pairs)):
        paths = all_paths(b, p)
        scores = np.array([w[path].sum() for path in paths])
        assert z[p] == pytest.approx(np.log(np.exp(scores).sum()))
        assert best[p] == pytest.approx(scores.max()) and w[b.best_path(p, chosen)].sum() == pytest.approx(scores.max())
        assert [s for s, _ in top[p]] == pytest.approx(sorted(scores, reverse=True)[:4])
        vectors = np.zeros((len(paths), len(index)))
        for k, path in enumerate(paths):
            for i, v in b.path_vector(path).items():
                vectors[k, i] = v
        q = np.exp(scores - z[p])
        dense = np.zeros(len(index))
        dense[b.place_id[b.place_pair == p]] = e[b.place_pair == p]
        assert np.allclose(dense, q @ vectors)
        active, m = second[p]
        assert np.allclose(m, ((vectors.T * q) @ vectors)[np.ix_(active, active)])
        steps = [b.steps(path) for path in paths]
        for s in steps:
            ops = [x[0][:3] for x in s if x[0] != "None"]
            assert redundant or order == 0 or ("Ins", "Del") not in set(itertools.pairwise(ops))


def test_goal_may_be_out_of_reach():
    g = WordAlignment(order=1, align_ngrams=False, collapsed_ngrams=False)
    b, w = batch([(["a"], ["b", "c"])], build(1), g, {}, allowed=Allowed(pattern="z"))
    assert b.log_partition(w)[0] == -np.inf and b.expected(w)[1].sum() == 0 and b.k_best(w, 2) == [[]]


def test_conditions():
    plain = Allowed(source_lexicon=frozenset({"a+b"}), target_lexicon=frozenset())
    assert plain.fits(["a", "b"], ["x"]) and not plain.fits(["b", "a"], ["x"]) and not plain.fits(["a"], ["x", "y"])
    assert Allowed(pattern="[a-c]").fits(["a", "b"], []) and not Allowed(pattern="[a-c]", accept=False).fits(["a"], [])


def test_machines(spark):
    m = build(1, exact_match=True)
    assert m.states == ["sta", "ins1", "del1", "mat1", "sub11"]
    assert "Del1" not in [op.name for op, _ in m.moves[m.states.index("ins1")]]
    assert [op.name for op, _ in m.moves[0]] == ["Del1", "Ins1", "Sub11", "Mat11"]
    two = build(2, exact_match=True)
    assert "ins/del" not in two.states and "Mat1" in {op.name for op in two.operations}
    assert build(0, 2, 2).operations[-1].name == "Rep22"
    assert [op.name for op in build(0, exact_match=True, identical_unigrams=True).operations] == ["Del1", "Ins1", "Mat11"]
    assert m.table(spark).count() == sum(map(len, m.moves))
    with pytest.raises(ValueError):
        build(2, max_source=2)


def test_feature_names():
    g = WordAlignment(order=1, vowels="aeiou", window=1, bigrams=True)
    history = [("None", "-", "-"), ("Ins1", "-", "e"), ("Rep11", "i", "e")]
    names = g.names(history, ["i", "b"], ["e", "e"], 0, 1, 1, 2, False)
    assert {"S:Rep11", "S:Ins1>Rep11", "A:i>e", "A:->e_i>e", "A:[V]>[V]", "C:i_>e_e_", "W:^+i+b>e+e+$", "Bi:i+b>e", "Bi:i>e+$"} <= names
    assert g.names([("None", "-", "-")], [], [], 0, 0, 0, 0, True) >= {"S:None"}
    s = SentenceAlignment()
    assert s.names([("None", "-", "-"), ("Rep11", "WRD1~NN~x", "WRD2~VB~y")], [], [], 0, 0, 1, 1, False) == {"S:Rep11", "A:NN+>VB+", "A:x+>y+"}


def test_default_weights():
    w = WordAlignment.default_weight
    assert w("A:a>a", 1) == pytest.approx(2 / 3) and w("A:a>b_c>c", 1) == pytest.approx(-2 / 9 + 2 / 3)
    assert w("S:Mat11", 0) == pytest.approx(-2 / 3) and w("Bias", 1) == 1 and w("W:x", 1) == 0 and w("A:a>a", 5) == 0


def test_graph_text_and_order():
    b, w = stress()
    text = b.graphviz(0, w)
    assert text.startswith("digraph G {") and text.count("->") == len(b.edges)
    order = L.topological_order(b, 0)
    place = {v: i for i, v in enumerate(order)}
    assert all(place[int(s)] < place[int(d)] for s, d in zip(b.src, b.dst))
    assert L.topological_order(b, 0, True) == order[::-1]


def test_inference_in_batches(spark):
    rows = [(1, ["t"], ["u"]), (2, list("ab"), list("ab"))]
    df = spark.createDataFrame(rows, "id long, source array<string>, target array<string>")
    weights = {"S:Del1": -1.0, "S:Ins1": -2.0, "S:Sub11": -3.0, "S:Mat11": 1.0}
    m = build(0, exact_match=True)
    got = {r.id: r.value for r in L.infer(df, m, PLAIN, weights, "log_partition", NO_FINAL).collect()}
    assert got[1] == pytest.approx(-1.90138771133189)
    assert {r.id: r.value for r in L.infer(df, m, PLAIN, weights, "viterbi", NO_FINAL).collect()}[2] == 2
    k = L.infer(df, m, PLAIN, weights, "k_best", NO_FINAL, k=2).filter("id = 2").orderBy("rank").collect()
    assert k[0].ops == ["Mat11", "Mat11"] and k[0].value == 2
    assert {(r.id, r.op): round(r.value, 4) for r in L.infer(df, m, PLAIN, weights, "expected_ops", NO_FINAL).collect()}[1, "Sub11"] == 0.3333
    with pytest.raises(ValueError):
        L.infer(df, m, PLAIN, weights, "nothing")
