"""Column functions on frames of a clip: a frame holds its points flat, as x, y, z of each in turn."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clip_window(clip: str = "clip", t: str = "t"):
    return Window.partitionBy(clip).orderBy(t)


def difference(x: Column | str, order: int, window, dt: float | None = None) -> Column:
    """The backward difference of this order of an array column, element by element, divided by ``dt`` to that power; null for the first rows.

    Frame t takes its own values and those of the ``order`` frames before it. Whole multiples are
    summed before the division, so equal steps give equal rates.
    """
    x = F.col(x) if isinstance(x, str) else x
    signs = {1: (1, -1), 2: (1, -2, 1), 3: (1, -3, 3, -1)}[order]
    rows = F.array(*[x, *[F.lag(x, i).over(window) for i in range(1, order + 1)]])
    whole = F.lag(x, order).over(window).isNotNull()
    per = 1.0 if dt is None else dt**order
    sums = F.transform(x, lambda _, j: sum((F.get(F.get(rows, i), j) * s for i, s in enumerate(signs)), F.lit(0.0)) / per)
    return F.when(whole, sums)


def once(value: Column, of) -> Column:
    """``of`` a value as the variable of a lambda: an expression used inside a function of an array would be worked out again for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def norms(flat: Column, dims: int = 3) -> Column:
    """The Euclidean length of each point of a flat array."""
    at = lambda p: F.sequence(F.lit(0), (F.size(p) / dims).cast("int") - 1)
    return once(flat, lambda p: F.transform(at(p), lambda k: F.sqrt(sum((F.get(p, k * dims + c) ** 2 for c in range(dims)), F.lit(0.0)))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def point_sum(flat: Column, dims: int = 3) -> Column:
    """The sum of all points of a flat array, as one point."""
    at = lambda p: F.sequence(F.lit(0), (F.size(p) / dims).cast("int") - 1)
    return once(flat, lambda p: F.array(*[F.aggregate(at(p), F.lit(0.0), lambda s, k: s + F.get(p, k * dims + c)) for c in range(dims)]))  # noqa: B023


def bone_lengths(flat: Column, bones: list[tuple[int, int]]) -> Column:
    part = lambda i, c: F.get(flat, F.lit(3 * i + c))
    return F.array(*[F.sqrt(sum(((part(i, c) - part(j, c)) ** 2 for c in range(3)), F.lit(0.0))) for i, j in bones])


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def excess(q: Column, lo: Column, hi: Column) -> Column:
    """How far outside its limits a value lies."""
    return F.greatest(q - hi, F.lit(0.0)) + F.greatest(lo - q, F.lit(0.0))


def clamp(q: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(q, lo), hi)


def average_rank(window, ties) -> Column:
    """Rank with ties averaged: ``window`` orders by the value, ``ties`` partitions by it as well."""
    return F.rank().over(window) + (F.count("*").over(ties) - 1) / 2
