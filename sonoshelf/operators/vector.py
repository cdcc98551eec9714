"""Cosine similarity against one query vector, in Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_of(vectors: DataFrame, id_col: str, value: int, column: str = "embedding") -> list[float]:
    """The query vector, a single row looked up by id."""
    row = vectors.where(F.col(id_col) == value).select(column).first()
    if row is None:
        raise ValueError(f"no row has {id_col} = {value}")
    return [float(x) for x in row[0]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_to(column: str, query: list[float]) -> Column:
    """Cosine similarity of each row's vector to the query; null for a zero vector or another length. The squares are
    summed in the same order on both sides, under one root and held to -1..1, so a vector is like itself by exactly 1."""
    q, c = F.array(*[F.lit(x) for x in query]), F.col(column)
    squares = 0.0
    for x in query:  # not sum(), which compensates rounding
        squares += x * x
    size = F.sqrt(dot(c, c) * F.lit(squares))
    cosine = F.transform(F.array(dot(c, q) / size), lambda x: F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))[0]
    return F.when((F.size(c) == len(query)) & (size > 0), cosine)
