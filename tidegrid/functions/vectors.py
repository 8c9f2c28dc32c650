"""Arrays of doubles as vectors and matrices, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def assemble(features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def flat(nested: Column) -> Column:
    """A window of vectors as one vector."""
    return F.flatten(nested)


def reshape(vector: Column, width: int) -> Column:
    """A flat vector as rows of `width`."""
    return F.transform(F.sequence(F.lit(0), (F.size(vector) / width).cast("int") - 1), lambda i: F.slice(vector, i * width + 1, F.lit(width)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal(values) -> Column:
    """A list of numbers, or of such lists, as an array literal."""
    return F.array(*[literal(v) for v in values]) if hasattr(values, "__len__") else F.lit(float(values))


def times(vector: Column, matrix: Sequence[Sequence[float]]) -> Column:
    """vector (n) times matrix (n x m)."""
    return F.array(*[dot(vector, literal([row[j] for row in matrix])) for j in range(len(matrix[0]))])


def plus(*vectors: Column) -> Column:
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda x, y: x + y)
    return out


def softmax(scores: Column) -> Column:
    e = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(F.array(e(scores)), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))[0]
