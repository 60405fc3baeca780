"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: keeps the cosine of a zero vector defined (its distance is 1).
EPSILON = 1e-10
SPACES = ("cosine", "euclidean")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_distance(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    return 1 - dot(a, b) / (norm(a) * (norm(b) if norm_b is None else norm_b) + F.lit(EPSILON))


def euclidean_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def distance_to(embedding: Column, query, space: str) -> Column:
    """Distance of a column to a constant vector, whose norm is taken once (D39: other spaces are errors)."""
    if space == "cosine":
        return cosine_distance(embedding, literal(query), F.lit(math.sqrt(sum(float(x) ** 2 for x in query))))
    if space == "euclidean":
        return euclidean_distance(embedding, literal(query))
    raise ValueError(f"unknown space {space!r}; known are {', '.join(SPACES)}")


def normalised(embedding: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    size = norm(embedding)
    unit = F.transform(F.arrays_zip(embedding.alias("x"), F.array_repeat(size, F.size(embedding)).alias("n")), lambda p: p["x"].cast("double") / p["n"])
    return F.when(size > 0, unit).otherwise(F.transform(embedding, lambda x: x.cast("double")))


def parse_literal(text: str) -> list[float] | None:
    """Numbers of a vector literal such as ``[1, 2.5]``; None if it is none."""
    body = text.strip().strip("[]()")
    try:
        return [float(x) for x in body.split(",")] if body.strip() else None
    except ValueError:
        return None
