"""Distances between vectors in double precision, inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.text import clamp01


def literal(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a.cast("array<double>"), b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similarity(distance: Column) -> Column:
    """One less the distance, kept within 0 and 1; an L2 distance of 1 or more gives 0."""
    return clamp01(1.0 - distance)
