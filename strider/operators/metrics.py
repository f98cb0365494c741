"""Clip metrics: each group of them is one window stage and one aggregate per clip."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.functions import series as S
from strider.functions import spatial as V
from strider.operators import blocks


#: Inputs that a metric may need: places, rotations and joints of frames, joints as they were read, and what a robot is capable of.
INPUTS = ("P", "R", "q", "q_raw", "colliders", "support_polygon")


@dataclass(frozen=True)
class MetricSpec:
    """key, unit, power of the frame rate (None: not simply scaled), direction, inputs and least frames.

    unobservable_when: conditions flag=value under which the metric cannot fire. perframe: whether it
    has a value for each frame as well.
    """

    key: str
    units: str
    dt_exponent: int | None
    requires: tuple[str, ...]
    min_frames: int
    direction: str = "lower_better"
    unobservable_when: tuple[str, ...] = ()
    perframe: bool = False

    def __post_init__(self) -> None:
        if not self.key.replace("_", "").isalnum():
            raise ValueError(f"metric key {self.key!r} has other signs than letters, digits and _")
        if bad := sorted(set(self.requires) - set(INPUTS)):
            raise ValueError(f"{self.key}: no such input: {', '.join(bad)}")
        if self.min_frames < 1:
            raise ValueError(f"{self.key}: min_frames is below 1")
        if bad := [c for c in self.unobservable_when if "=" not in c]:
            raise ValueError(f"{self.key}: {bad[0]!r} is not flag=value")


# The metric registry.
SPECS = {s.key: s for s in (
    MetricSpec("rigidity_residual_mm", "mm", 0, ("P",), 1),
    MetricSpec("rigidity_wobble_mm", "mm", 0, ("P",), 2),
    MetricSpec("rigidity_worst_bone_mm", "mm", 0, ("P",), 2, perframe=True),
    MetricSpec("rigidity_residual_all_mm", "mm", 0, ("P",), 1),
    MetricSpec("rigidity_wobble_all_mm", "mm", 0, ("P",), 2),
    MetricSpec("mean_speed_mps", "m/s", 1, ("P",), 2),
    MetricSpec("mean_accel_mps2", "m/s^2", 2, ("P",), 3),
    MetricSpec("max_accel_mps2", "m/s^2", 2, ("P",), 3),
    MetricSpec("mean_jerk_mps3", "m/s^3", 3, ("P",), 4),
    MetricSpec("accel_violation_frac", "1", None, ("P",), 3),
    MetricSpec("mean_angvel_radps", "rad/s", 1, ("R",), 2),
    MetricSpec("max_angvel_radps", "rad/s", 1, ("R",), 2),
    MetricSpec("mean_angacc_radps2", "rad/s^2", 2, ("R",), 3),
    MetricSpec("kinetic_energy_tstd", "J/kg", 2, ("P",), 3),
    MetricSpec("total_energy_tstd", "J/kg", None, ("P",), 3),
    MetricSpec("momentum_dp_mean", "m/s^2", 2, ("P",), 3),
    MetricSpec("limit_violation_frac", "1", 0, ("q_raw",), 1),
    MetricSpec("limit_excess_rad", "rad", 0, ("q_raw",), 1),
    MetricSpec("limit_headroom_rad", "rad", 0, ("q",), 1, "higher_better"),
    MetricSpec("mean_qdot_radps", "rad/s", 1, ("q",), 2),
    MetricSpec("mean_qddot_radps2", "rad/s^2", 2, ("q",), 3),
    MetricSpec("vel_violation_frac", "1", None, ("q",), 2),
    MetricSpec("effort_proxy", "1", 2, ("q",), 3),
    MetricSpec("sparc", "1", None, ("P",), 8, "higher_better"),
    MetricSpec("log_dimensionless_jerk", "1", 0, ("P",), 8, "higher_better"),
    MetricSpec("penetration_mm", "mm", 0, ("q", "colliders"), 1),
    MetricSpec("self_collision_frac", "1", 0, ("q", "colliders"), 1),
    MetricSpec("com_margin_m", "m", 0, ("q", "support_polygon"), 1, "higher_better"),
    MetricSpec("torque_frac_rated", "%", None, ("q",), 3, perframe=True),
    MetricSpec("no_teleport_frac", "1", None, ("P",), 2, perframe=True),
)}

ACCEL_BOUND, TELEPORT_SPEED, GRAVITY = 5.0, 2.0, 9.81


def suite_id(name: str, keys: list[str], invariant: list[str]) -> str:
    """Identity of a suite: its name, keys in order and sorted invariant keys."""
    said = "|".join([name, ",".join(keys), "inv:" + ",".join(sorted(invariant))])
    return "sha256:" + hashlib.sha256(said.encode()).hexdigest()[:16]


def with_reason(values: DataFrame, frames: str = "n_frames", available: tuple[str, ...] = ("P",)) -> DataFrame:
    """Long rows (clip, metric, value, reason): a metric has either a finite value or the reason for none.

    Missing inputs come before too few frames; a result that is not finite is degenerate.
    """
    keys = [k for k in values.columns if k in SPECS]
    rows = []
    for k in keys:
        s = SPECS[k]
        missing = sorted(set(s.requires) - set(available))
        reason = F.when(F.lit(bool(missing)), F.lit("missing_input:" + ",".join(missing))).when(
            F.col(frames) < s.min_frames, F.concat(F.lit("too_few_frames:"), F.col(frames).cast("string"), F.lit(f"<{s.min_frames}"))
        )
        value = S.finite(F.col(k))
        reason = F.coalesce(reason, F.when(value.isNull(), "degenerate_input:non_finite_result"))
        rows.append(F.struct(F.lit(k).alias("metric"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason")))
    return values.select("clip", F.inline(F.array(*rows)))


def temporal(kp: DataFrame, dt: float) -> DataFrame:
    """Speed, acceleration, jerk and what exceeds bounds, from (clip, t, p)."""
    w = blocks.window()
    d = [S.norms(S.difference("p", i, w, dt)) for i in (1, 2, 3)]
    rows = blocks.blocked(kp.select("clip", "t", "p"), 3).select("clip", "own", *[x.alias(n) for x, n in zip(d, ("v", "a", "j"), strict=True)]).where("own")
    return rows.groupBy("clip").agg(
        F.count("*").alias("n_frames"),
        F.avg(S.mean(F.col("v"))).alias("mean_speed_mps"), F.avg(S.mean(F.col("a"))).alias("mean_accel_mps2"),
        F.max(F.array_max("a")).alias("max_accel_mps2"), F.avg(S.mean(F.col("j"))).alias("mean_jerk_mps3"),
        F.avg(S.mean(F.transform("a", lambda x: (x > ACCEL_BOUND).cast("double")))).alias("accel_violation_frac"),
        F.avg((F.array_max("v") > TELEPORT_SPEED).cast("double")).alias("no_teleport_frac"),
    )


def energy(kp: DataFrame, dt: float) -> DataFrame:
    """Spread over time of kinetic and total energy, and mean change of momentum; frame t moves to frame t + 1."""
    w = blocks.window()
    moved = blocks.blocked(kp.select("clip", "t", "p"), 2).select("clip", "t", "block", "own", F.lag("p").over(w).alias("from"), S.difference("p", 1, w, dt).alias("v"))
    ke = 0.5 * S.total(F.transform(S.norms(F.col("v")), lambda x: x * x))
    height = F.get(S.point_sum(F.col("from")), F.lit(2))
    rows = moved.where("v is not null").select("clip", "t", "block", "own", ke.alias("ke"), (ke + GRAVITY * height).alias("te"), S.point_sum(F.col("v")).alias("m"))
    force = F.get(S.norms(S.difference("m", 1, w, dt)), F.lit(0))
    return rows.select("clip", "own", "ke", "te", force.alias("f")).where("own").groupBy("clip").agg(
        F.stddev_samp("ke").alias("kinetic_energy_tstd"), F.stddev_samp("te").alias("total_energy_tstd"), F.avg("f").alias("momentum_dp_mean")
    )


def rigidity(kp: DataFrame, bones: list[tuple[int, int]], rest: float | list[float]) -> DataFrame:
    """How bone lengths differ from rest (one length, or one a bone), from their mean, and the worst bone from its lower median, in mm."""
    long = kp.select("clip", "t", F.posexplode(S.bone_lengths(F.col("p"), bones)).alias("b", "l"))
    nominal = F.lit(rest) if isinstance(rest, float) else F.get(F.array(*map(F.lit, rest)), F.col("b"))
    per_bone = long.groupBy("clip", "b").agg(F.avg(F.abs(F.col("l") - nominal)).alias("r"), F.stddev_pop("l").alias("s"), F.expr("percentile_disc(0.5) within group (order by l)").alias("m"))
    flat = per_bone.groupBy("clip").agg((F.avg("r") * 1000).alias("rigidity_residual_mm"), (F.avg("s") * 1000).alias("rigidity_wobble_mm"))
    worst = _farthest(long, per_bone)
    return flat.join(worst.groupBy("clip").agg((F.avg("d") * 1000).alias("rigidity_worst_bone_mm")), "clip")


def _farthest(long: DataFrame, per_bone: DataFrame) -> DataFrame:
    """(clip, t, d): of each frame the largest distance of a bone (clip, t, b, l) from its median (clip, b, m)."""
    return long.join(per_bone.select("clip", "b", "m"), ["clip", "b"]).groupBy("clip", "t").agg(F.max(F.abs(F.col("l") - F.col("m"))).alias("d"))


def worst_bones(kp: DataFrame, bones: list[tuple[int, int]]) -> DataFrame:
    """(clip, t, d): how far the worst bone of each frame is from its own lower median over the clip."""
    long = kp.select("clip", "t", F.posexplode(S.bone_lengths(F.col("p"), bones)).alias("b", "l"))
    return _farthest(long, long.groupBy("clip", "b").agg(F.expr("percentile_disc(0.5) within group (order by l)").alias("m")))


def joint_limits(joints: DataFrame, limits: list[tuple[float, float]]) -> DataFrame:
    """Share of frames outside the limits, mean excess and mean headroom, from (clip, t, q)."""
    lo, hi = (F.array(*[F.lit(x[i]) for x in limits]) for i in (0, 1))
    out = F.zip_with(F.zip_with("q", hi, lambda q, h: F.greatest(q - h, F.lit(0.0))), F.zip_with("q", lo, lambda q, b: F.greatest(b - q, F.lit(0.0))), lambda a, b: a + b)
    room = F.array_min(F.zip_with(F.zip_with(hi, "q", lambda h, q: h - q), F.zip_with("q", lo, lambda q, b: q - b), lambda a, b: F.least(a, b)))
    return joints.select("clip", S.total(out).alias("x"), room.alias("r")).groupBy("clip").agg(
        F.count("*").alias("n_frames"), F.avg((F.col("x") > 0).cast("double")).alias("limit_violation_frac"),
        F.avg("x").alias("limit_excess_rad"), F.avg("r").alias("limit_headroom_rad"),
    )


def joint_dynamics(joints: DataFrame, dt: float, speed_limits: list[float], efforts: list[float]) -> DataFrame:
    w = blocks.window()
    absolute = lambda x: F.transform(x, F.abs)
    rows = blocks.blocked(joints.select("clip", "t", "q"), 2).select("clip", "own", absolute(S.difference("q", 1, w, dt)).alias("v"), absolute(S.difference("q", 2, w, dt)).alias("a")).where("own")
    over = F.zip_with("v", F.array(*map(F.lit, speed_limits)), lambda v, m: (v > m).cast("double"))
    effort = F.zip_with("a", F.array(*map(F.lit, efforts)), lambda a, e: a / e)
    return rows.groupBy("clip").agg(
        F.avg(S.mean(F.col("v"))).alias("mean_qdot_radps"), F.avg(S.mean(F.col("a"))).alias("mean_qddot_radps2"),
        F.avg(S.mean(over)).alias("vel_violation_frac"), F.avg(S.total(effort)).alias("effort_proxy"),
    )


def arm_2r(joints: DataFrame, first: float = 0.4, second: float = 0.3) -> DataFrame:
    """Forward kinematics of a planar arm of two links: points of base, elbow and tip, and the angle of each frame."""
    a, b = F.get("q", F.lit(0)), F.get("q", F.lit(0)) + F.get("q", F.lit(1))
    ex, ey = first * F.cos(a), first * F.sin(a)
    zero = F.lit(0.0)
    return joints.select("clip", "t", F.array(zero, zero, zero, ex, ey, zero, ex + second * F.cos(b), ey + second * F.sin(b), zero).alias("p"), F.array(zero, a, b).alias("theta"))


def angular(frames: DataFrame, dt: float) -> DataFrame:
    """Angular speed and acceleration of frames that turn about z by ``theta``: half the skew part of R(t+1) R(t)^T, by dt."""
    w = blocks.window()
    omega = F.transform(S.difference("theta", 1, w), lambda x: F.sin(x) / dt)
    rows = blocks.blocked(frames.select("clip", "t", "theta"), 2).select("clip", "t", "block", "own", omega.alias("o"))
    acc = S.difference("o", 1, w, dt)
    return rows.select("clip", "own", "o", acc.alias("a")).where("own").groupBy("clip").agg(
        F.avg(S.mean(F.transform("o", F.abs))).alias("mean_angvel_radps"), F.max(F.array_max(F.transform("o", F.abs))).alias("max_angvel_radps"),
        F.avg(S.mean(F.transform("a", F.abs))).alias("mean_angacc_radps2"),
    )


def angular_velocity(r: Column, before: Column, links: int, dt: float) -> Column:
    """Three values a link: the vector of the skew part of R(t) R(t-1)^T, by dt; near the angular velocity while a frame turns little."""
    turns = [V.vee(V.product(V.parts(r, k, 9), V.transpose(V.parts(before, k, 9)))) for k in range(links)]
    return F.array(*[x / dt for turn in turns for x in turn])


def angular_3d(frames: DataFrame, links: int, dt: float) -> DataFrame:
    """Angular speed and acceleration of ``links`` links that turn about any axis, from (clip, t, r) with nine values a rotation.

    Frames are numbered one by one within a clip; a clip is cut into blocks, so none is one task's.
    """
    w = blocks.window()
    rows = blocks.blocked(frames.select("clip", "t", "r"), 2).withColumn("r0", F.lag("r").over(w))
    turned = rows.select("clip", "t", "block", "own", F.when(F.col("r0").isNotNull(), angular_velocity(F.col("r"), F.col("r0"), links, dt)).alias("o"))
    moved = turned.select("clip", "own", S.norms(F.col("o")).alias("s"), S.norms(S.difference("o", 1, w, dt)).alias("a")).where("own")
    return moved.groupBy("clip").agg(
        F.count("*").alias("n_frames"), F.avg(S.mean(F.col("s"))).alias("mean_angvel_radps"), F.max(F.array_max("s")).alias("max_angvel_radps"), F.avg(S.mean(F.col("a"))).alias("mean_angacc_radps2")
    )


def log_dimensionless_jerk(kp: DataFrame, point: int, dt: float) -> DataFrame:
    """-ln of jerk made dimensionless by duration and path of one point; null below 8 frames or for no motion."""
    w = blocks.window()
    one = blocks.blocked(kp.select("clip", "t", F.slice("p", 3 * point + 1, 3).alias("p")), 3)
    rows = one.select("clip", "own", F.get(S.norms(S.difference("p", 1, w)), F.lit(0)).alias("s"), F.get(S.norms(S.difference("p", 3, w, dt)), F.lit(0)).alias("j")).where("own")
    sums = rows.groupBy("clip").agg(F.count("*").alias("n"), F.sum("s").alias("path"), F.sum(F.col("j") ** 2 * dt).alias("jj"))
    dlj = ((F.col("n") - 1) * dt) ** 5 / F.col("path") ** 2 * F.col("jj")
    return sums.select("clip", F.when((F.col("n") >= 8) & (F.col("path") > 1e-9) & (dlj > 1e-9), -F.log(dlj)).alias("log_dimensionless_jerk"))


def spectral_arc_length(speed: np.ndarray, dt: float, cutoff: float = 10.0, amplitude: float = 0.05, pad: int = 4) -> float:
    """Length of the normalised speed spectrum up to ``cutoff`` Hz, negated; NaN for fewer than 8 speeds or no motion."""
    speed = speed[np.isfinite(speed)]
    if len(speed) < 8 or not (np.abs(speed) > 1e-9).any():
        return float("nan")
    n = 1 << (int(np.ceil(np.log2(len(speed)))) + pad)
    f, m = np.arange(n) / (n * dt), np.abs(np.fft.fft(speed, n))
    f, m = f[f <= cutoff], (m / m.max())[f <= cutoff]
    band = np.flatnonzero(m >= amplitude)
    f, m = f[band[0] : band[-1] + 1], m[band[0] : band[-1] + 1]
    if len(f) < 2 or f[-1] - f[0] <= 1e-9:
        return float("nan")
    return float(-np.sqrt((np.diff(f) / (f[-1] - f[0])) ** 2 + np.diff(m) ** 2).sum())


def sparc(kp: DataFrame, point: int, dt: float) -> DataFrame:
    """Spectral arc length of the speed of one point; a transform of a whole series, so one task per clip."""

    def of(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = spectral_arc_length(g.sort_values("t")["s"].to_numpy(float), dt)
        return pd.DataFrame({"clip": [key[0]], "sparc": [None if np.isnan(v) else v]})

    s = F.get(S.norms(S.difference("p", 1, blocks.window(), dt)), F.lit(0))
    kind = dict(kp.dtypes)["clip"]
    one = blocks.blocked(kp.select("clip", "t", F.slice("p", 3 * point + 1, 3).alias("p")), 1)
    return one.select("clip", "t", "own", s.alias("s")).where("own and s is not null").select("clip", "t", "s").groupBy("clip").applyInPandas(of, f"clip {kind}, sparc double")
