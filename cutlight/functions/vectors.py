"""Vectors as array columns: products, norms, and the int8 form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision; null if the lengths differ."""
    a, b = _doubles(a), _doubles(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def dot_literal(v: Column, query: list[float]) -> Column:
    """X19 against one vector that the driver holds."""
    return dot(v, F.array(*(F.lit(float(x)) for x in query)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """At length 1; a vector of hardly any length stays as it is."""
    n = norm(v)
    return F.when(n > 1e-12, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; null if a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def int8_scale(v: Column) -> Column:
    """The largest magnitude over 127, or 1 for a vector of zeros."""
    top = F.aggregate(_doubles(v), F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    return F.when(top > 1e-12, top / 127).otherwise(1.0)


def int8_values(v: Column) -> Column:
    """The values as whole numbers from -127 to 127, halves rounded away from zero."""
    s = int8_scale(v)
    return F.transform(_doubles(v), lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / s).cast("int"))))


def int8_decode(values: Column, scale: Column) -> Column:
    """X18."""
    return F.transform(values, lambda x: x.cast("double") * scale)


def pack_int8(values: Column) -> Column:
    """Whole numbers as bytes, one each, for storage."""

    @F.pandas_udf("binary")
    def to_bytes(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: None if x is None else np.asarray(x, np.int8).tobytes())

    return to_bytes(values)


def unpack_int8(data: Column) -> Column:
    """Bytes as whole numbers."""

    @F.pandas_udf("array<int>")
    def from_bytes(v: pd.Series) -> pd.Series:
        import numpy as np

        return v.map(lambda x: None if x is None else np.frombuffer(x, np.int8).astype(np.int32))

    return from_bytes(data)


def z_score(similarity: Column, mean: Column, deviation: Column) -> Column:
    """X21."""
    return (similarity - mean) / F.greatest(deviation, F.lit(1e-6))


def visual_confidence(score: Column, floor: float, ceiling: float) -> Column:
    """X11: 0 at the floor, 1 at the ceiling."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - floor) / max(ceiling - floor, 1e-6)))


def hamming(a: Column, b: Column) -> Column:
    """The number of bits in which two hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def valid_embedding(dimensions: Column, quantization: Column, size: Column, scale: Column) -> Column:
    """F16: 1 to 16384 dimensions, a known form, the right number of bytes, a positive scale."""
    bytes_each = F.when(quantization == "float32", 4).when(quantization == "int8", 1)
    return F.coalesce(dimensions.between(1, 16384) & (size == dimensions * bytes_each) & (scale > 0), F.lit(False))
