"""Vector arithmetic on ``ARRAY<FLOAT>`` columns with higher-order functions (no Python workers)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_double(a), _double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row; a lambda would work out what it names anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(a: Column) -> Column:
    return _once(_double(a), lambda v: _once(F.greatest(norm(v), F.lit(1e-9)), lambda n: F.transform(v, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)
