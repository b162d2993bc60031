"""Vectors as array columns; sums are made in double and in order, so that they repeat."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or without direction."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (lengths == 0), 0.0).otherwise(dot(a, b) / lengths)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for vectors without direction."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 1.0).otherwise(1 - dot(a, b) / lengths)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


#: How a metric scores, and whether more is nearer.
METRICS = {"cosine": (cosine, True), "dot": (dot, True), "euclid": (euclid, False)}


def float32_bytes(column: Column) -> Column:
    """A vector as little-endian float32."""
    @F.pandas_udf("binary")
    def encode(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(column)


def float32_vector(column: Column) -> Column:
    """The vector again; null if the bytes are no whole number of values."""
    @F.pandas_udf("array<float>")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").tolist())

    return decode(column)
