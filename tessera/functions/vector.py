"""Vector functions: as columns, in double precision, and as numpy for many pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def is_finite(v: Column) -> Column:
    return F.forall(_double(v), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def _usable(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0) & is_finite(a) & is_finite(b)


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of different or no dimensions, or with values that are not finite."""
    return F.when(_usable(a, b), _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))).otherwise(F.lit(0.0))


def magnitude(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 where dot is 0 by definition, and for vectors without length."""
    lengths = magnitude(a) * magnitude(b)
    return F.when(_usable(a, b) & (lengths > 0), dot(a, b) / F.nullif(lengths, F.lit(0.0))).otherwise(F.lit(0.0))


def cosine_to(v: Column, query: list[float]) -> Column:
    """Cosine with one vector, whose length is taken once."""
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    if not len(q) or not np.isfinite(q).all() or norm == 0:
        return F.lit(0.0)
    fixed = F.array(*[F.lit(float(x)) for x in q])
    lengths = magnitude(v) * norm
    return F.when((F.size(v) == len(q)) & is_finite(v) & (lengths > 0), _sum(F.zip_with(_double(v), fixed, lambda x, y: x * y)) / F.nullif(lengths, F.lit(0.0))).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(_usable(a, b), F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))).otherwise(F.lit(0.0))


def normalize(v: Column) -> Column:
    """Of length 1; unchanged if it has no length or values that are not finite."""
    return F.when(is_finite(v) & (magnitude(v) > 0), F.transform(_double(v), lambda x: x / F.nullif(magnitude(v), F.lit(0.0)))).otherwise(_double(v))


def neighbour_cosines(rows: np.ndarray) -> np.ndarray:
    """Cosines of rows with the next one, as dot / (length * length): exact but for the last step where sums are, so that
    a cosine at a threshold falls on the same side as in SQL. 0 where there is no length, or a value is not finite."""
    rows = np.asarray(rows, np.float64)
    rows = np.where(np.isfinite(rows).all(1, keepdims=True), rows, 0)
    norm = np.sqrt((rows * rows).sum(1))
    lengths = norm[1:] * norm[:-1]
    return np.divide((rows[1:] * rows[:-1]).sum(1), lengths, out=np.zeros_like(lengths), where=(lengths > 0) & np.isfinite(lengths))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows that are not finite or have no length are all 0."""
    rows = np.asarray(rows, np.float64)
    rows = np.where(np.isfinite(rows).all(1, keepdims=True), rows, 0)
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)
