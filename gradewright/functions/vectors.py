"""Similarity and distance of two vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.functions.text import col

METRICS = ("cosine_similarity", "euclidean_distance", "manhattan_distance")


def _as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_as_double(col(a)), _as_double(col(b)), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine in double precision; NULL where a vector has norm 0."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(_as_double(col(a)), _as_double(col(b)), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def manhattan_distance(a: Column | str, b: Column | str) -> Column:
    steps = F.zip_with(_as_double(col(a)), _as_double(col(b)), lambda x, y: F.abs(x - y))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def _sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each list's stretch of values; 0 for an empty list."""
    out = np.zeros(len(lengths))
    filled = lengths > 0
    if filled.any():
        out[filled] = np.add.reduceat(values, starts[filled])
    return out


@F.arrow_udf(T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS]))
def _metrics(a: pa.Array, b: pa.Array) -> pa.Array:
    if a.type != b.type:
        b = b.cast(a.type)
    known = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    mask = pa.array(known)
    a, b = a.filter(mask), b.filter(mask)
    lengths = np.asarray(a.value_lengths(), dtype=np.int64)
    if not np.array_equal(lengths, np.asarray(b.value_lengths(), dtype=np.int64)):
        raise ValueError("vectors of different length in one row")
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    y = b.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    norms = np.sqrt(_sums(x * x, starts, lengths)) * np.sqrt(_sums(y * y, starts, lengths))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = _sums(x * y, starts, lengths) / norms
    gap = x - y
    found = (cosine, np.sqrt(_sums(gap * gap, starts, lengths)), _sums(np.abs(gap), starts, lengths))

    def spread(values: np.ndarray, missing: np.ndarray) -> pa.Array:
        whole = np.zeros(len(known))
        whole[known] = values
        empty = ~known
        empty[known] |= missing
        return pa.array(whole, pa.float64(), mask=empty)

    none = np.zeros(len(lengths), dtype=bool)
    return pa.StructArray.from_arrays(
        [spread(found[0], norms == 0), spread(found[1], none), spread(found[2], none)], names=list(METRICS)
    )


def all_metrics(a: Column | str, b: Column | str) -> Column:
    """Struct of cosine, euclidean and manhattan from one Arrow pass."""
    return _metrics(col(a), col(b))
