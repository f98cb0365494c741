"""Vectors, rotations and poses of columns: a matrix is nine columns row by row, a vector three.

Numbers known when the plan is made stay numbers, so products with zeros and ones fall away
before Catalyst sees them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | Column
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def _known(x: Number) -> bool:
    return not isinstance(x, Column)


def mul(a: Number, b: Number) -> Number:
    if _known(a) and _known(b):
        return a * b
    for x, y in ((a, b), (b, a)):
        if _known(x) and x in (0.0, 1.0, -1.0):
            return 0.0 if x == 0.0 else y if x == 1.0 else -y
    return a * b


def add(*parts: Number) -> Number:
    known, rest = sum(p for p in parts if _known(p)), [p for p in parts if not _known(p)]
    out = rest[0] if rest else known
    for p in rest[1:]:
        out = out + p
    return out + known if rest and known else out


def dot(a: list[Number], b: list[Number]) -> Number:
    return add(*[mul(x, y) for x, y in zip(a, b, strict=True)])


def cross(a: list[Number], b: list[Number]) -> list[Number]:
    return [add(mul(a[i], b[j]), mul(-1.0, mul(a[j], b[i]))) for i, j in ((1, 2), (2, 0), (0, 1))]


def plus(a: list[Number], b: list[Number]) -> list[Number]:
    return [add(x, y) for x, y in zip(a, b, strict=True)]


def minus(a: list[Number], b: list[Number]) -> list[Number]:
    return [add(x, mul(-1.0, y)) for x, y in zip(a, b, strict=True)]


def times(a: Number, v: list[Number]) -> list[Number]:
    return [mul(a, x) for x in v]


def turn(m: list[Number], v: list[Number]) -> list[Number]:
    """A matrix times a vector."""
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def transpose(m: list[Number]) -> list[Number]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def product(a: list[Number], b: list[Number]) -> list[Number]:
    return [dot(a[3 * i : 3 * i + 3], b[j::3]) for i in range(3) for j in range(3)]


def congruent(r: list[Number], m: list[Number]) -> list[Number]:
    """R M R^T: a tensor turned by R."""
    return product(product(r, m), transpose(r))


def vee(m: list[Number]) -> list[Number]:
    """The vector of the skew part of a matrix."""
    half = lambda a, b: mul(0.5, add(a, mul(-1.0, b)))
    return [half(m[7], m[5]), half(m[2], m[6]), half(m[3], m[1])]


def from_rpy(roll: float, pitch: float, yaw: float) -> list[float]:
    """The matrix of turns about the fixed x, y and z axes, in this order."""
    sin, cos = (lambda f: [f(a) for a in (roll, pitch, yaw)])(math.sin), [math.cos(a) for a in (roll, pitch, yaw)]
    x = [1.0, 0.0, 0.0, 0.0, cos[0], -sin[0], 0.0, sin[0], cos[0]]
    y = [cos[1], 0.0, sin[1], 0.0, 1.0, 0.0, -sin[1], 0.0, cos[1]]
    z = [cos[2], -sin[2], 0.0, sin[2], cos[2], 0.0, 0.0, 0.0, 1.0]
    return product(product(z, y), x)


def about(axis: list[float], angle: Number) -> list[Number]:
    """The turn by an angle about a unit axis."""
    sin, cos = (math.sin(angle), math.cos(angle)) if _known(angle) else (F.sin(angle), F.cos(angle))
    hat = [0.0, -axis[2], axis[1], axis[2], 0.0, -axis[0], -axis[1], axis[0], 0.0]
    outer = [axis[i] * axis[j] for i in range(3) for j in range(3)]
    # cos I + sin [axis] + (1 - cos) axis axis^T, by what stands with cos, sin and alone
    return [add(mul(IDENTITY[k] - outer[k], cos), mul(hat[k], sin), outer[k]) for k in range(9)]


def rotation_vector(m: list[Column], eps: float = 1e-6) -> list[Column]:
    """Axis times angle of a rotation; the cosine is kept ``eps`` away from its ends, so half turns come out inexactly."""
    angle = F.acos(F.least(F.greatest((m[0] + m[4] + m[8] - 1) / 2, F.lit(eps - 1)), F.lit(1 - eps)))
    return [x * (angle / F.greatest(F.sin(angle), F.lit(eps))) for x in vee(m)]


def parts(flat: Column, k: int, size: int) -> list[Column]:
    """The ``k``-th group of ``size`` values of a flat array."""
    return [F.get(flat, F.lit(size * k + c)) for c in range(size)]


def column(x: Number) -> Column:
    return F.lit(float(x)) if _known(x) else x
