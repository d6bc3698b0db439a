"""Distances, norms, bounds and elementwise functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths up to this are written out term by term, which stays in generated code.
UNROLL = 64


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)


def _pairwise(x: Column, y: Column, of, d: int | None) -> Column:
    if d is not None and 0 < d <= UNROLL:
        return reduce(lambda a, b: a + b, [of(x[k], y[k]) for k in range(d)])
    return _total(F.zip_with(x, y, of))


def sq_euclidean(x: Column, y: Column, d: int | None = None) -> Column:
    return _pairwise(x, y, lambda a, b: (a - b) * (a - b), d)


def euclidean(x: Column, y: Column, d: int | None = None) -> Column:
    return F.sqrt(sq_euclidean(x, y, d))


def manhattan(x: Column, y: Column, d: int | None = None) -> Column:
    return _pairwise(x, y, lambda a, b: F.abs(a - b), d)


def unsigned_manhattan(x: Column, y: Column, d: int | None = None) -> Column:
    """Manhattan without a negative intermediate: the larger less the smaller."""
    return _pairwise(x, y, lambda a, b: F.greatest(a, b) - F.least(a, b), d)


def unsigned_manhattan_norm(x: Column) -> Column:
    return _total(x)


def dot(x: Column, y: Column, d: int | None = None) -> Column:
    return _pairwise(x, y, lambda a, b: a * b, d)


def cosine_similarity(x: Column, y: Column, d: int | None = None) -> Column:
    """Similarity; plus infinity where a norm is zero."""
    norms = sq_norm(x) * sq_norm(y)
    return F.when(norms == 0, F.lit(float("inf"))).otherwise(dot(x, y, d) / F.sqrt(norms))


def sq_norm(x: Column) -> Column:
    return _total(F.transform(x, lambda a: a * a))


def norm(x: Column) -> Column:
    return F.sqrt(sq_norm(x))


def manhattan_norm(x: Column) -> Column:
    return _total(F.transform(x, F.abs))


def auto_distance(x: Column, y: Column, element_type: str, d: int | None = None) -> Column:
    """Euclidean for float and double elements, Manhattan for integer ones."""
    return euclidean(x, y, d) if element_type in ("float", "double") else manhattan(x, y, d).cast("long")


def auto_norm(x: Column, element_type: str) -> Column:
    return norm(x) if element_type in ("float", "double") else manhattan_norm(x).cast("long")


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance with unit costs; arrays of integers (code points) are compared as strings."""
    return F.levenshtein(a, b)


def code_points_as_string(x: Column) -> Column:
    """An integer sequence as a string, one character each, so ``levenshtein`` applies to it."""
    return F.array_join(F.transform(x, lambda v: F.char(v.cast("long"))), "")


def translate(left: Column, right: Column) -> Column:
    """``right - left``, element by element."""
    return F.zip_with(right, left, lambda a, b: a - b)


def polar(x: Column) -> Column:
    """The first two features as radius and angle, the others unchanged."""
    return F.concat(F.array(F.hypot(x[0], x[1]), F.atan2(x[1], x[0])), F.slice(x, F.lit(3), F.greatest(F.size(x) - 2, F.lit(0))))


def subset(x: Column, mask: list[int]) -> Column:
    """The features that ``mask`` lists, in its order."""
    return F.array(*[x[k] for k in mask])


def elementwise_min(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: F.least(a, b))


def in_ball(x: Column, centre: Column, radius: Column, d: int | None = None) -> Column:
    """Strictly inside."""
    return euclidean(x, centre, d) < radius


def ball_distance(x: Column, centre: Column, radius: Column, d: int | None = None) -> Column:
    """The distance to the centre if strictly inside, else null."""
    dist = euclidean(x, centre, d)
    return F.when(dist < radius, dist)


def in_box(x: Column, lo: Column, hi: Column) -> Column:
    """Every feature within its closed interval."""
    return F.forall(F.zip_with(F.zip_with(x, lo, lambda a, b: a >= b), F.zip_with(x, hi, lambda a, b: a <= b), lambda p, q: p & q), lambda v: v)


def box_centre(lo: Column, hi: Column) -> Column:
    return F.zip_with(lo, hi, lambda a, b: (a + b) / 2)


def box_half_widths(lo: Column, hi: Column) -> Column:
    return F.zip_with(lo, hi, lambda a, b: (b - a) / 2)


def box_diameter(lo: Column, hi: Column) -> Column:
    return norm(translate(lo, hi))


def box_distance(x: Column, lo: Column, hi: Column) -> Column:
    """The distance to the box's centre if inside, else null."""
    return F.when(in_box(x, lo, hi), euclidean(x, box_centre(lo, hi)))


def box_box_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Least distance of two boxes, 0 where they meet."""
    gaps = F.zip_with(translate(hi1, lo2), translate(hi2, lo1), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return norm(gaps)


def ball_ball_distance(c1: Column, r1: Column, c2: Column, r2: Column) -> Column:
    return F.greatest(F.lit(0.0), euclidean(c1, c2) - r1 - r2)


def unbounded_distance() -> Column:
    """Whatever is unbounded is at distance 0."""
    return F.lit(0.0)


def in_unbounded() -> Column:
    """Whatever is, is inside."""
    return F.lit(True)


def near(a: Column, b: Column, eps: float = 2.220446049250313e-16) -> Column:
    return F.abs(a - b) <= eps


def differs(a: Column, b: Column, eps: float = 2.220446049250313e-16) -> Column:
    return F.abs(a - b) > eps


def safe_divide(a: Column, b: Column, default: float = 0.0, eps: float = 2.220446049250313e-16) -> Column:
    return F.when(F.abs(b) <= eps, F.lit(default)).otherwise(a / b)
