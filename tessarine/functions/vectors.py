"""Vector functions over array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; NULL if the lengths differ."""
    both = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(squares(a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, which rounding can't take out of -1 .. 1; NULL for a zero vector or another length."""
    cosine = F.try_divide(dot(a, b), F.sqrt(squares(a) * squares(b)))
    # a lambda, so that the sums are computed once
    cut = F.transform(F.array(cosine), lambda x: F.when(F.isnan(x), x).when(x > 1, 1.0).when(x < -1, -1.0).otherwise(x))
    return 1 - F.get(cut, 0)


def similarity(distance: Column) -> Column:
    return 1 - distance


def negated(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def to_base64(a: Column) -> Column:
    """Little-endian float32 as base64 text."""
    def encoded(vectors: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.array(v, dtype="<f4").tobytes() for v in vectors.to_pylist()], pa.binary())

    return F.base64(F.arrow_udf(encoded, "binary")(a))


def from_base64(text: Column) -> Column:
    def decoded(data: pa.Array) -> pa.Array:
        return pa.array([None if d is None else np.frombuffer(d, dtype="<f4").tolist() for d in data.to_pylist()], pa.list_(pa.float32()))

    return F.arrow_udf(decoded, "array<float>")(F.unbase64(text))
