"""Rates of clips: rate policies, decimation by a whole factor and monotone interpolation."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.operators import blocks

#: Rates whose ratio is this near to a whole number, or to 1, count as such.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class RatePolicy:
    """kind: paired, rate_free or resample; the last has a target rate."""

    kind: str
    target_fps: float | None = None
    allow_upsample: bool = False


def parse_rate_policy(spec: str, allow_upsample: bool = False) -> RatePolicy:
    """``paired``, ``rate_free`` or ``resample:<hz>``."""
    kind, _, rate = spec.strip().partition(":")
    if kind in ("paired", "rate_free") and not rate:
        return RatePolicy(kind)
    try:
        fps = float(rate)
    except ValueError:
        fps = float("nan")
    if kind != "resample" or not 0 < fps < float("inf"):
        raise ValueError(f"no rate policy: {spec!r}")
    return RatePolicy(kind, fps, allow_upsample)


def plan(native_fps: Column, target_fps: float, allow_upsample: bool = False) -> Column:
    """(action, factor) per clip: noop, decimate by a whole factor, interpolate, or refuse what would add frames."""
    ratio = native_fps / target_fps
    whole = F.round(ratio)
    none = F.lit(None)
    step = lambda action, factor: F.struct(F.lit(action).alias("action"), factor.cast("int").alias("factor"))
    return (
        F.when(F.abs(ratio - 1) <= TOLERANCE, step("noop", none))
        .when((ratio < 1) & F.lit(not allow_upsample), step("refuse", none))
        .when((whole >= 2) & (F.abs(ratio - whole) <= TOLERANCE * whole), step("decimate", whole))
        .otherwise(step("interpolate", none))
    )


def frame_count(n: Column, dt: float, target_dt: float) -> Column:
    """Frames of the new rate that lie within the old ones."""
    return F.floor((n - 1) * dt / target_dt + 1e-9) + 1


def decimate(frames: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th frame of (clip, t, ..) with t from 1, counted anew."""
    return frames.where((F.col("t") - 1) % factor == 0).withColumn("t", F.floor((F.col("t") - 1) / factor).cast("int") + 1)


def _slope(y: list[Column], before: Column, after: Column) -> Column:
    """The slope of a monotone cubic (weighted harmonic means of the secants) at the middle of five even values, per step; before and after: whether there is a value on that side."""
    s = [b - a for a, b in zip(y, y[1:], strict=False)]
    inner = F.when(s[1] * s[2] > 0, 2 / (1 / s[1] + 1 / s[2])).otherwise(0.0)

    def end(near: Column, next_: Column) -> Column:
        d = (3 * near - next_) / 2
        odd = F.signum(near) != F.signum(next_)
        bent = F.when(F.signum(d) != F.signum(near), 0.0).when(odd & (F.abs(d) > 3 * F.abs(near)), 3 * near).otherwise(d)
        return F.when(next_.isNull(), near).otherwise(bent)

    return F.when(before & after, inner).when(after, end(s[2], s[3])).otherwise(end(s[1], s[0]))


def _times(k: Column, dt: float) -> Column:
    """``k`` frames of ``dt`` as the double next to their exact time; a product of doubles is off by a rounding that grows with ``k``."""
    return (k.cast("decimal(12,0)") * F.lit(Decimal(repr(dt)))).cast("double")


def interpolate(frames: DataFrame, dt: float, target_dt: float, columns: str | list[str] = "q") -> DataFrame:
    """(clip, t, ``columns``) at ``target_dt``, t from 1: no frame lies past the last of the clip.

    Each array is the monotone cubic through its elements over time. New frames come from the old one
    that is next before them, whose cubic takes two frames on either side: a clip is cut into blocks,
    and none is one task's. Frames are numbered one by one from 1. Clips of one frame keep it.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    w = blocks.window()
    near = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else F.col(c)
    rows = blocks.blocked(frames.select("clip", "t", *names), 3).select("*", near("t", -1).isNotNull().alias("__b"), near("t", 1).isNotNull().alias("__a"), *[near(c, k).alias(f"__{c}{k}") for c in names for k in (-2, -1, 1, 2)])
    at = lambda c, k: (lambda j: F.get(F.col(f"__{c}{k}") if k else F.col(c), j))
    slope_of = lambda c: (lambda _, j: _slope([at(c, k)(j) for k in (-2, -1, 0, 1, 2)], F.col("__b"), F.col("__a")))
    slopes = [F.transform(c, slope_of(c)).alias(f"__d_{c}") for c in names]
    sloped = rows.select("clip", "t", "block", "own", "__a", *names, *[f"__{c}1" for c in names], *slopes)
    whole = sloped.select("*", *[F.lead(f"__d_{c}").over(w).alias(f"__e_{c}") for c in names]).where("own")
    x = (F.col("t") - 1) * dt / target_dt
    first = F.ceil(x - 1e-9)
    last = F.when(F.col("__a"), F.ceil(x + dt / target_dt - 1e-9) - 1).otherwise(F.floor(x + 1e-9))
    new = whole.where(first <= last).withColumn("__k", F.explode(F.sequence(first, last)))
    # A column of its own: inside a function of an array ``t`` would mean the new number of the frame.
    new = new.withColumn("__u", F.least(F.greatest(_times(F.col("__k"), target_dt) / dt - (F.col("t") - 1), F.lit(0.0)), F.lit(1.0)))
    u = F.col("__u")

    def cubic(c: str) -> Column:
        def value(y: Column, j: Column) -> Column:
            z, d, e = (F.get(F.col(f"__{n}"), j) for n in (f"{c}1", f"d_{c}", f"e_{c}"))
            return y * (1 + 2 * u) * (1 - u) ** 2 + d * u * (1 - u) ** 2 + z * u**2 * (3 - 2 * u) + e * u**2 * (u - 1)

        return F.when(F.col("__a"), F.transform(c, value)).otherwise(F.col(c))

    return new.select("clip", (F.col("__k") + 1).cast("int").alias("t"), *[cubic(c).alias(c) for c in names])


def looks_per_frame(kind: str) -> bool:
    """Whether a column of this type holds something of each moment that can be interpolated: numbers or arrays of them."""
    bare = kind.removeprefix("array<").removesuffix(">")
    return bare in ("double", "float", "int", "bigint", "smallint", "tinyint") or bare.startswith("decimal")


def resample_frames(frames: DataFrame, dt: float, policy: RatePolicy) -> DataFrame:
    """All frames (clip, t, ...) by a policy, every numeric column alike; t counts anew from 1.

    Whole factors keep every so many frames; else arrays and numbers are interpolated and other
    columns, of which nothing lies between two frames, go. Raises where frames would have to be added and
    the policy does not allow it.
    """
    if policy.kind != "resample":
        return frames
    action, factor = _planned(1 / dt, policy)
    if action == "noop":
        return frames
    if action == "decimate":
        return decimate(frames, factor)
    if action == "refuse":
        raise ValueError(f"{1 / dt:g} frames a second would become {policy.target_fps:g}; the policy does not add frames")
    kinds = {c: k for c, k in frames.dtypes if c not in ("clip", "t") and looks_per_frame(k)}
    rows = frames.select("clip", "t", *[(F.col(c).cast("array<double>") if k.startswith("array") else F.array(F.col(c).cast("double"))).alias(c) for c, k in kinds.items()])
    new = interpolate(rows, dt, 1 / policy.target_fps, list(kinds))
    return new.select("clip", "t", *[F.col(c) if k.startswith("array") else F.get(c, F.lit(0)).alias(c) for c, k in kinds.items()])


def _planned(fps: float, policy: RatePolicy) -> tuple[str, int | None]:
    """:func:`plan` of one rate."""
    ratio = fps / policy.target_fps
    if abs(ratio - 1) <= TOLERANCE:
        return "noop", None
    if ratio < 1 and not policy.allow_upsample:
        return "refuse", None
    if round(ratio) >= 2 and abs(ratio - round(ratio)) <= TOLERANCE * round(ratio):
        return "decimate", round(ratio)
    return "interpolate", None
