"""Distances of float vectors, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def as_vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a norm is 0, so that such vectors drop out of comparisons."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1 - F.try_divide(dot(a, b), norm)


def l2_distance(a: Column, b: Column) -> Column:
    square = F.zip_with(wide(a), wide(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


METRICS = {"cosine": cosine_distance, "l2": l2_distance}


def to_bytes(v: Column) -> Column:
    """The components as little-endian 32-bit floats, one after the other; for export only."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def from_bytes(data: Column) -> Column:
    """The vector of such bytes."""

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    return run(data)


_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
SQL_FUNCTIONS = {
    "vec_distance_l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "vec_distance_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"1 - try_divide({_DOT.format('a', 'b')}, sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))"),
    "vec_length": ("a ARRAY<DOUBLE>", "INT", "size(a)"),
}


def register_functions(spark: SparkSession) -> None:
    """Makes the vector functions known to SQL of this session."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
