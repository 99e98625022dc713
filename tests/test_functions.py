import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolattice.functions import folds, linalg
from duolattice.functions import scalars as S


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_log_arithmetic(spark):
    lg = lambda x: F.lit(math.log(x)) if x else F.lit(float("-inf"))
    r = one(spark, mul=S.log_mul(lg(2), lg(3)), div=S.log_div(lg(2), lg(3)), add=S.log_add(lg(2), lg(3)), zero=S.log_add(lg(0), lg(3)), none=S.log_mul(lg(0), lg(3)), root=S.log_sqrt(lg(4)), both=S.log_add(lg(0), lg(0)))
    assert (r.mul, r.div, r.add) == pytest.approx((1.79175947, -0.40546511, 1.60943791))
    assert r.zero == pytest.approx(math.log(3)) and r.none == r.both == float("-inf")
    assert r.root == pytest.approx(math.log(2))


def test_losses_and_arrays(spark):
    a = F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))
    r = one(spark, s=S.sigmoid(0.0), l=S.log1_plus(1e-6), h=S.hinge(-1.0), d=S.delta(1.0, 0.0), lse=S.log_sum_exp(a), c=S.cumsum(a), i=S.first_index_gt(a, 0.4), j=S.first_index_gt(a, 5.0), sub=S.ind2sub(F.lit(7), 3), t=S.vec_sum(a), e=S.vec_exp(a), g=S.vec_log(a), ab=S.log_abs(F.lit(2.0)))
    assert (r.s, r.h, r.d, r.t, r.ab) == (0.5, 0.0, 1.0, 3.0, 2.0)
    assert r.l == pytest.approx(1e-6) and r.lse == pytest.approx(2.40760596444)
    assert r.c == [0.0, 1.0, 3.0] and (r.i, r.j) == (1, -1) and tuple(r.sub) == (2, 1)
    assert r.e[2] == pytest.approx(math.e**2) and r.g[0] == float("-inf")


def test_sparse_dot(spark):
    w = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = one(spark, a=S.sparse_dot(F.array(F.lit(0), F.lit(2), F.lit(9)), F.array(F.lit(2.0), F.lit(0.5), F.lit(1.0)), w))
    assert r.a == 3.5


def test_linear_algebra():
    lower = np.array([[1.0, 0, 0], [2, 3, 0], [4, 5, 6]])
    full = lower + np.tril(lower, -1).T
    assert np.allclose(linalg.symmetric_product(lower, np.array([1.0, 2, 3])), full @ [1, 2, 3])
    assert np.allclose(linalg.lower_to_symmetric(lower), full)
    v = linalg.log_vector(np.array([3.0, 0, 1]))
    assert np.allclose(linalg.log_add(v, v)[[0, 2]], [math.log(6), math.log(2)]) and linalg.log_add(v, v)[1] == -np.inf
    dest = linalg.add_outer_lower_log(np.full((3, 3), -np.inf), math.log(2), v, v)
    assert np.allclose(np.exp(dest), np.tril(2 * np.outer([3, 0, 1], [3, 0, 1])))
    second, first = np.log(np.array([[5.0, 1, 1], [1, 2, 1], [3, 1, 4]])), np.array([1.0, 0, 2])
    c = linalg.lower_covariance(second, first)
    assert c[0, 0] == pytest.approx(4) and c[2, 0] == pytest.approx(1) and c[1, 1] == pytest.approx(2) and c[0, 2] == 0
    assert np.allclose(linalg.sigmoid_vector(np.array([0.0])), 0.5)
    assert np.allclose(linalg.scale_rows_by_sigmoid_slope(np.ones((2, 2)), np.array([0.5, 1.0])), [[0.25, 0.25], [0, 0]])
    assert np.allclose(linalg.add_scaled(np.zeros(2), np.ones(2), 3), 3) and np.allclose(linalg.add_exponentiated(np.zeros(1), np.zeros(1), 2), 2)


def test_weights_and_parameters():
    w = linalg.WeightVector()
    assert w.inner({0: 1.0}) == 0
    w.add(2, 1.5)
    w.add(2, 0.5)
    w.set(0, 3.0)
    assert w.dim == 3 and w.inner({0: 1, 2: 2}) == 7 and w.inner([1, 1, 1]) == 5 and w.squared_l2() == 13
    w.scale(2)
    assert w.squared_l2() == 52
    p = linalg.Parameters(3, 3, 1, 1)
    p.set_all(np.arange(8.0))
    assert (p.index_w(), p.index_u(), p.index_shared_w(), p.index_shared_u()) == (0, 3, 6, 7)
    assert p.u.tolist() == [3, 4, 5] and p[6] == 6 and len(p) == 8 and p.inner(np.ones(8)) == 28
    assert sorted(linalg.random_permutation(5, 1)) == list(range(5)) and len(linalg.gaussian_samples(4)) == 4
    assert linalg.numerical_gradient(lambda x: float(x @ x), np.array([1.0, 2.0]), 1) == pytest.approx(4)


def test_folds_count_alignments(spark):
    a = lambda n, p: F.array(*(F.lit(f"{p}{i}") for i in range(n)))
    r = one(spark, d11=folds.fold_log_partition(a(1, "a"), a(1, "b")), d22=folds.fold_log_partition(a(2, "a"), a(2, "b")), d33=folds.fold_log_partition(a(3, "a"), a(3, "b")), tu=folds.fold_log_partition(F.array(F.lit("t")), F.array(F.lit("u")), -1.0, -2.0, -3.0, 0.0))
    assert [round(math.exp(x)) for x in (r.d11, r.d22, r.d33)] == [3, 13, 63]
    assert r.tu == pytest.approx(-1.90138771133189)


def test_folds_against_tables(spark):
    """All lengths from 0 to 4 on both sides, and nulls."""
    costs = (-1.0, -2.0, -0.5, 1.0)
    words = [list(w) for k in range(5) for w in ("abca"[:k], "bcab"[:k])]
    df = spark.createDataFrame([(i, j, s, t) for i, s in enumerate(words) for j, t in enumerate(words)] + [(-1, -1, None, ["a"])], "i int, j int, s array<string>, t array<string>")
    got = df.select("i", "j", "s", "t", folds.fold_log_partition(F.col("s"), F.col("t"), *costs).alias("z"), folds.fold_viterbi(F.col("s"), F.col("t"), *costs).alias("v")).collect()
    for r in got:
        if r.s is None:
            assert r.z is None and r.v is None
            continue
        total, best = {(0, 0): 0.0}, {(0, 0): 0.0}
        for a in range(len(r.s) + 1):
            for b in range(len(r.t) + 1):
                steps = [((a - 1, b), costs[0]), ((a, b - 1), costs[1])]
                if a and b:
                    steps.append(((a - 1, b - 1), costs[3] if r.s[a - 1] == r.t[b - 1] else costs[2]))
                steps = [(p, w) for p, w in steps if min(p) >= 0]
                if steps:
                    total[a, b] = math.log(sum(math.exp(total[p] + w) for p, w in steps))
                    best[a, b] = max(best[p] + w for p, w in steps)
        end = (len(r.s), len(r.t))
        assert r.z == pytest.approx(total[end]) and r.v == pytest.approx(best[end])
