"""Synthetic examples of a log-linear model with a latent label: x is Gaussian, (y, z) follows the softmax of theta . phi(x, y, z)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import cumsum, log_sum_exp


def phi(x: np.ndarray, y: int, z: int, ny: int, nz: int) -> np.ndarray:
    """x in the block of (y, z), zeros elsewhere."""
    out = np.zeros(len(x) * ny * nz)
    at = (y * nz + z) * len(x)
    out[at : at + len(x)] = x
    return out


def joint(x: np.ndarray, theta: np.ndarray, ny: int, nz: int) -> np.ndarray:
    """p(y, z | x) as a matrix."""
    s = (theta.reshape(ny * nz, len(x)) @ x).reshape(ny, nz)
    p = np.exp(s - s.max())
    return p / p.sum()


def latent(x: np.ndarray, y: int, theta: np.ndarray, ny: int, nz: int) -> np.ndarray:
    """p(z | x, y)."""
    p = joint(x, theta, ny, nz)[y]
    return p / p.sum()


def phi_mean(x: np.ndarray, theta: np.ndarray, ny: int, nz: int, y: int | None = None) -> np.ndarray:
    """E[phi | x], or given y too."""
    p = joint(x, theta, ny, nz) if y is None else np.zeros((ny, nz))
    if y is not None:
        p[y] = latent(x, y, theta, ny, nz)
    return (p[:, :, None] * x).ravel()


def phi_covariance(x: np.ndarray, theta: np.ndarray, ny: int, nz: int, y: int | None = None) -> np.ndarray:
    """Cov[phi | x], or given y too."""
    p = joint(x, theta, ny, nz) if y is None else np.zeros((ny, nz))
    if y is not None:
        p[y] = latent(x, y, theta, ny, nz)
    p = p.ravel()
    return np.kron(np.diag(p) - np.outer(p, p), np.outer(x, x))


def posterior(x: Column, theta: list[float], ny: int, nz: int, nx: int) -> Column:
    """p(y, z | x) of an array column, row by row."""
    blocks = F.array(*(F.array(*(F.lit(float(v)) for v in theta[k * nx : (k + 1) * nx])) for k in range(ny * nz)))
    scores = F.transform(blocks, lambda b: F.aggregate(F.zip_with(b, x, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v))
    return F.transform(scores, lambda s: F.exp(s - log_sum_exp(scores)))


def generate(spark: SparkSession, t: int, nx: int, ny: int, nz: int, theta: list[float], seed: int = 0) -> DataFrame:
    """t examples: id, x, y, z. (y, z) is drawn by the inverse of the cumulative posterior."""
    base = spark.range(t).withColumn("x", F.array(*(F.randn(seed * 1000 + k) for k in range(nx)))).withColumn("r", F.rand(seed * 1000 + nx))
    drawn = base.withColumn("c", cumsum(posterior(F.col("x"), theta, ny, nz, nx)))
    index = F.least(F.size(F.filter("c", lambda v: v <= F.col("r"))), F.lit(ny * nz - 1))
    return drawn.withColumn("k", index).select("id", "x", F.floor(F.col("k") / nz).cast("int").alias("y"), (F.col("k") % nz).cast("int").alias("z"))
