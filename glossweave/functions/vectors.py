"""Arithmetic on array<float> columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    # The length is a value of its own, else it would be taken again for every element.
    over = lambda n: F.transform(_doubles(v), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    return F.transform(F.array(norm(v)), over)[0]


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
