"""Scalar functions over columns: log-domain arithmetic, losses, and the array functions of the generative model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def log_add(a, b) -> Column:
    """log(e^a + e^b); -infinity stands for zero and is the identity."""
    a, b = _c(a), _c(b)
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(lo == NEG_INF, hi).otherwise(hi + F.log1p(F.exp(lo - hi)))


def log_mul(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when((a == NEG_INF) | (b == NEG_INF), F.lit(NEG_INF)).otherwise(a + b)


def log_div(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a == NEG_INF, F.lit(NEG_INF)).otherwise(a - b)


def log_sqrt(a) -> Column:
    return _c(a) * 0.5


def log_abs(a) -> Column:
    """The reals behind logs are never negative."""
    return _c(a)


def sigmoid(a) -> Column:
    return 1 / (1 + F.exp(-_c(a)))


def log1_plus(a) -> Column:
    return F.log1p(_c(a))


def hinge(a) -> Column:
    return F.greatest(F.lit(0.0), _c(a))


def delta(y, yhat) -> Column:
    """0/1 loss."""
    return (_c(y) != _c(yhat)).cast("double")


def log_sum_exp(values: Column) -> Column:
    """log of the summed exponentials of an array, with the largest taken out first; an empty array gives -infinity."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when((F.size(values) == 0) | (top == NEG_INF), F.lit(NEG_INF)).otherwise(top + F.log(total))


def vec_exp(values: Column) -> Column:
    return F.transform(values, F.exp)


def vec_log(values: Column) -> Column:
    """Logs of non-negative numbers; zero gives -infinity."""
    return F.transform(values, lambda x: F.when(x == 0, F.lit(NEG_INF)).otherwise(F.log(x)))


def vec_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def cumsum(values: Column) -> Column:
    """Prefix sums."""
    step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["v"], F.array(acc["s"] + x)).alias("v"))
    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.expr("cast(array() as array<double>)").alias("v")), step, lambda acc: acc["v"])


def first_index_gt(values: Column, v) -> Column:
    """Index (from 0) of the first element above v, -1 if none is."""
    return F.coalesce(F.array_position(F.transform(values, lambda x: x > _c(v)), True), F.lit(0)).cast("int") - 1


def ind2sub(index, n_columns: int) -> Column:
    """Row and column of an index into a matrix stored row by row."""
    i = _c(index)
    return F.struct(F.floor(i / n_columns).cast("int").alias("row"), (i % n_columns).cast("int").alias("col"))


def sparse_dot(indices: Column, values: Column, weights: Column) -> Column:
    """Inner product of a sparse vector with a dense array of weights; no weights give 0."""
    products = F.zip_with(indices, values, lambda i, v: F.coalesce(F.get(weights, i.cast("int")), F.lit(0.0)) * v)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
