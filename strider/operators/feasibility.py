"""Whether a body can do what a clip shows: penetration of its parts, balance, and the torque of its joints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.functions import series as S
from strider.operators import blocks

# Radius of an arm and depth that counts as a collision in metres, spheres of a segment, half size of a foot, percentile of a peak.
ARM_RADIUS, COLLISION_DEPTH, SPHERES, FOOT_HALF, PEAK = 0.05, 0.01, 4, 0.12, 98.0


def _point(p: Column, k: int) -> list[Column]:
    return [F.get(p, F.lit(3 * k + c)) for c in range(3)]


def capsule(p: Column, chain: list[int], spheres: int = SPHERES, first: int = 0) -> list[list[Column]]:
    """Centres of the spheres along a chain of points from its segment ``first`` on: ``spheres`` - 1 a segment, and the tip."""
    out = []
    for i, j in zip(chain[first:], chain[first + 1 :], strict=False):
        a, b = _point(p, i), _point(p, j)
        out += [[x + (y - x) * (s / (spheres - 1)) for x, y in zip(a, b, strict=True)] for s in range(spheres - 1)]
    return [*out, _point(p, chain[-1])]


def _deepest(one: list[list[Column]], two: list[tuple[list[Column], float]], radius: float) -> Column:
    gap = lambda a, b: F.sqrt(sum(((x - y) ** 2 for x, y in zip(a, b, strict=True)), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.lit(0.0), *[radius + r - gap(a, b) for a in one for b, r in two])


def penetration(frames: DataFrame, arms: list[list[int]], body: dict[int, float], radius: float = ARM_RADIUS, spheres: int = SPHERES) -> DataFrame:
    """(clip, t, depth): how deep, in metres, an arm's spheres lie in those of the body (point to radius) or of another arm at most.

    The first segment of an arm starts at the body and is left out against it, not against other arms.
    """
    p = F.col("p")
    core = [(_point(p, k), r) for k, r in body.items()]
    against = [_deepest(capsule(p, a, spheres, 1), core, radius) for a in arms]
    whole = [[(c, radius) for c in capsule(p, a, spheres)] for a in arms]
    against += [_deepest(capsule(p, a, spheres), whole[j], radius) for i, a in enumerate(arms) for j in range(i + 1, len(arms))]
    return frames.select("clip", "t", F.array_max(F.array(*against)).alias("depth"))


def collisions(depths: DataFrame, least: float = COLLISION_DEPTH) -> DataFrame:
    """(clip, penetration_mm, self_collision_frac) of (clip, t, depth): mean depth, share of frames deeper than ``least``."""
    return depths.groupBy("clip").agg((F.avg("depth") * 1000).alias("penetration_mm"), F.avg((F.col("depth") > least).cast("double")).alias("self_collision_frac"))


def balance(frames: DataFrame, masses: dict[int, float], feet: list[int], half: float = FOOT_HALF) -> DataFrame:
    """(clip, com_margin_m): mean of how far the centre of mass lies inside the rectangle round the feet, seen from above; below 0 outside."""
    p, total = F.col("p"), sum(masses.values())
    margins = []
    for c in range(2):
        com = sum((F.get(p, F.lit(3 * k + c)) * m for k, m in masses.items()), F.lit(0.0)) / total
        at = F.array(*[F.get(p, F.lit(3 * k + c)) for k in feet])
        margins += [com - (F.array_min(at) - half), (F.array_max(at) + half) - com]
    return frames.select("clip", F.least(*margins).alias("m")).groupBy("clip").agg(F.avg("m").alias("com_margin_m"))


def smoothing_reach(sigma: float) -> int:
    """Frames that smoothing looks at on either side."""
    return max(1, int(3 * sigma)) if sigma > 0 else 0


def smoothed(joints: DataFrame, sigma: float = 1.0, window=None) -> DataFrame:
    """``joints`` (clip, t, q) with q smoothed over time by a Gaussian of ``sigma`` frames, cut at three; the ends repeat."""
    if sigma <= 0:
        return joints
    if window is None:  # by blocks of a clip, which hold as many frames to either side as smoothing looks at
        rows = smoothed(blocks.blocked(joints, smoothing_reach(sigma)), sigma, blocks.window())
        return rows.where("own").drop("block", "own")
    reach, w = smoothing_reach(sigma), window
    taps = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    first, last = F.first("q").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last("q").over(w.rowsBetween(0, Window.unboundedFollowing))
    shifted = {k: F.coalesce(F.lead("q", k).over(w), last) if k > 0 else F.coalesce(F.lag("q", -k).over(w), first) if k < 0 else F.col("q") for k in taps}
    rows = F.array(*[shifted[k] for k in taps])
    total = sum(taps.values())
    mixed = F.transform("q", lambda _, j: sum((F.get(F.get(rows, i), j) * (v / total) for i, v in enumerate(taps.values())), F.lit(0.0)))
    return joints.withColumn("q", mixed)


def planar_torques(joints: DataFrame, dt: float, lengths: list[float], masses: list[float], gravity: float = 9.81) -> DataFrame:
    """(clip, t, tau) of the inner frames of a planar arm of slim links that hangs in the plane of y: Newton and Euler by virtual work.

    Of each link the force on its centre, by central differences, and its turning, both about each
    joint below it. The first and last frame have no neighbour and are left out.
    """
    n, w = len(lengths), blocks.window()
    angle = [sum((F.get("q", F.lit(j)) for j in range(i + 1)), F.lit(0.0)) for i in range(n)]
    at, centre, x, y = [], [], F.lit(0.0), F.lit(0.0)
    for i in range(n):
        at.append((x, y))
        centre.append((x + lengths[i] / 2 * F.cos(angle[i]), y + lengths[i] / 2 * F.sin(angle[i])))
        x, y = x + lengths[i] * F.cos(angle[i]), y + lengths[i] * F.sin(angle[i])
    flat = lambda pairs: F.array(*[c for pair in pairs for c in pair])
    posed = blocks.blocked(joints.select("clip", "t", "q"), 1).select("clip", "t", "block", "own", flat(at).alias("at"), flat(centre).alias("c"), F.array(*angle).alias("a"))
    near = lambda c, i: (F.get(F.lag(c).over(w), F.lit(i)), F.get(F.lead(c).over(w), F.lit(i)))
    second = lambda c, i: (lambda b, f: (f - 2 * F.get(c, F.lit(i)) + b) / dt**2)(*near(c, i))
    acc = posed.select("clip", "t", "own", "at", "c", F.array(*[second("c", i) for i in range(2 * n)]).alias("acc"), F.array(*[second("a", i) for i in range(n)]).alias("spin"), F.lag("t").over(w).isNotNull().alias("a1"), F.lead("t").over(w).isNotNull().alias("a2"))
    g = lambda c, i: F.get(c, F.lit(i))
    tau = []
    for j in range(n):
        parts = []
        for i in range(j, n):
            fx, fy = masses[i] * g("acc", 2 * i), masses[i] * (g("acc", 2 * i + 1) + gravity)
            parts.append((g("c", 2 * i) - g("at", 2 * j)) * fy - (g("c", 2 * i + 1) - g("at", 2 * j + 1)) * fx)
            parts.append(masses[i] * lengths[i] ** 2 / 12 * g("spin", i))
        tau.append(sum(parts, F.lit(0.0)))
    return acc.where("own and a1 and a2").select("clip", "t", F.array(*tau).alias("tau"))


def peak_share(torques: DataFrame, rated: list[float], pct: float = PEAK) -> DataFrame:
    """(clip, torque_frac_rated): of each frame the joint with the largest share of its rated torque, of these the percentile, in percent."""
    share = F.array_max(F.zip_with("tau", F.array(*map(F.lit, rated)), lambda t, r: F.abs(t) / r))
    return torques.select("clip", share.alias("s")).groupBy("clip").agg((100 * F.percentile("s", F.lit(pct / 100))).alias("torque_frac_rated"))
