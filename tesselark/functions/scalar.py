"""Scalar and small-array helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def almost_equal(a: Column, b: Column, tol: float = 1e-10, floor: float = 0.0) -> Column:
    """|a - b| < tol, or both are within floor of zero."""
    return (F.abs(a - b) < tol) | ((F.abs(a) <= floor) & (F.abs(b) <= floor))


def almost_equal_arrays(a: Column, b: Column, tol: float = 1e-10, floor: float = 0.0) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: almost_equal(x, y, tol, floor)), lambda x: x)


def all_positive(values: Sequence[Column], tol: float = 1e-10) -> Column:
    """Every value is at least -tol; false where one is null."""
    return F.coalesce(reduce(lambda rest, v: rest & (v >= -tol), values[1:], values[0] >= -tol), F.lit(False))


def min3(a: Column, b: Column, c: Column) -> Column:
    """Index of the least of three; of equal values the later index."""
    pair, at = F.when(a < b, a).otherwise(b), F.when(a < b, 0).otherwise(1)
    return F.when(pair < c, at).otherwise(2)


def min_index(values: Sequence[Column]) -> Column:
    """Index of the least value; of equal values the first."""
    least = F.least(*values)
    out = F.lit(len(values) - 1)
    for i in range(len(values) - 2, -1, -1):
        out = F.when(values[i] == least, i).otherwise(out)
    return out


def max_index(values: Sequence[Column]) -> Column:
    """Index of the greatest value; of equal values the first."""
    return min_index([-v for v in values])


def min_index_where(values: Sequence[Column], allowed: Sequence[Column]) -> Column:
    """Rank, among the allowed ones, of the least allowed value (the first of equals); null if none is allowed."""
    kept = [F.when(ok, v) for v, ok in zip(values, allowed, strict=True)]
    least = F.least(*kept)
    out = F.lit(None).cast("int")
    for i in range(len(values) - 1, -1, -1):
        rank = sum((F.when(allowed[k], 1).otherwise(0) for k in range(i)), F.lit(0))
        out = F.when(F.coalesce(kept[i] == least, F.lit(False)), rank).otherwise(out)
    return out


def same_direction(a: Sequence[Column], b: Sequence[Column], tol: float = 1e-10) -> Column:
    """Two vectors are parallel and point the same way."""
    return almost_equal(dot(a, b), norm(a) * norm(b), tol)


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def cross2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def plus(a: Sequence[Column], b: Sequence[Column], times: Column | float = 1.0) -> list[Column]:
    return [x + y * times for x, y in zip(a, b, strict=True)]


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def angle_between(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle in radians; null where a vector vanishes or has a null component."""
    cosine = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(cosine.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def cartesian_to_spherical(x: Column, y: Column, z: Column) -> Column:
    """struct(r, theta = atan(y / x), phi = acos(z / r)); null angles where x or r vanishes."""
    r = norm([x, y, z])
    return F.struct(r.alias("r"), F.atan(y / F.nullif(x, F.lit(0.0))).alias("theta"), F.acos(z / F.nullif(r, F.lit(0.0))).alias("phi"))


def vector(values: Column, i: Column | int, width: int = 3) -> Column:
    """The i-th vector of a flat array of vectors."""
    return F.slice(values, F.lit(i) * width + 1, F.lit(width))


def exclusive_scan(values: Column) -> Column:
    """Running sums before each element, and the total at the end."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, zero, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def inclusive_scan(values: Column) -> Column:
    return F.slice(exclusive_scan(values), F.lit(2), F.size(values))


def first_value(values: Column) -> Column:
    """First element, 0 of an empty array."""
    return F.coalesce(F.get(values, 0), F.lit(0))


def last_value(values: Column) -> Column:
    """Last element, 0 of an empty array."""
    return F.coalesce(F.get(values, F.size(values) - 1), F.lit(0))
