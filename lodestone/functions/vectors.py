"""Distances and vector expressions as Catalyst columns, and their NumPy kernels.

Squared L2 and cosine distance (1 - similarity), both in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def squared_norm(v: Column) -> Column:
    return dot(v, v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - similarity; a zero vector is similar to nothing, so its distance is 1."""
    size = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.when(size == 0, 1.0).otherwise(F.lit(1.0) - dot(a, b) / size)


def normalized(v: Column, epsilon: float = 0.0) -> Column:
    norm = F.sqrt(squared_norm(v) + F.lit(epsilon))
    return F.transform(doubles(v), lambda x: x / norm)


def rotated(v: Column, matrix: list[list[float]]) -> Column:
    """The vector times a fixed matrix, given by its rows."""
    return F.array(*[dot(F.array(*[F.lit(float(x)) for x in row]), v) for row in matrix])


def random_rotation(dimension: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix; lengths and distances stay under it."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def residual(v: Column, center: Column) -> Column:
    """What is left of a vector beside a center."""
    return F.zip_with(doubles(v), doubles(center), lambda x, y: x - y)


def quantized_int8(v: Column) -> Column:
    return F.transform(v, lambda x: F.round(x.cast("double") * 127).cast("tinyint"))


def _kernel_l2(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """All squared distances; the expansion may round, so callers recompute what they keep."""
    return (queries**2).sum(1)[:, None] + (base**2).sum(1)[None, :] - 2 * queries @ base.T


def _kernel_cosine(queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    scale = np.sqrt((queries**2).sum(1))[:, None] * np.sqrt((base**2).sum(1))[None, :]
    return 1 - queries @ base.T / np.where(scale > 0, scale, np.inf)


def exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row."""
    if metric == "l2":
        return ((a - b) ** 2).sum(1)
    scale = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return 1 - (a * b).sum(1) / np.where(scale > 0, scale, np.inf)


#: metric -> (column of two vectors, kernel of all pairs)
METRICS: dict[str, tuple[Callable[[Column, Column], Column], Callable[[np.ndarray, np.ndarray], np.ndarray]]] = {
    "l2": (squared_l2, _kernel_l2),
    "cosine": (cosine_distance, _kernel_cosine),
}
