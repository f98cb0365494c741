"""Suites of metrics: one pass over the frames gives all of them, and each has a value or the reason for none.

Frames are (clip, t, and of p, r, q, q_raw what there is), numbered one by one within a clip. A
metric names the shared columns of a frame that it needs, how they are summed up over a clip, and
what of the robot it needs; the plan holds each shared column once, whatever the suites ask for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.functions import series as S
from strider.operators import blocks, feasibility, metrics
from strider.operators.metrics import MetricSpec
from strider.operators.registry import Registry
from strider.robots import dynamics, kinematics
from strider.robots.body import Robot

#: Frames before a frame that the shared columns look at.
REACH = 3


@dataclass(frozen=True)
class Context:
    """What is known of all clips: frame time, robot and flags; bones are (i, j, length at rest), sites places of keypoints."""

    dt: float
    robot: Robot | None = None
    flags: dict[str, str] = field(default_factory=dict)
    bones: tuple[tuple[int, int, float], ...] = ()
    all_bones: tuple[tuple[int, int, float], ...] = ()
    sites: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        if not 0 < self.dt < float("inf"):
            raise ValueError(f"frame time {self.dt} is not positive")

    @staticmethod
    def of(spark: SparkSession, robot: Robot, dt: float, flags: dict[str, str] | None = None) -> Context:
        every = kinematics.bones(spark, robot)
        sites = tuple(robot.spec.keypoints.index(s) for s in robot.spec.sites)
        return Context(dt, robot, flags or {}, tuple(b[:3] for b in every if b[3]), tuple(b[:3] for b in every), sites)

    def available(self, columns: list[str]) -> set[str]:
        """Inputs that are there: columns of the frames, and what the robot is capable of."""
        got = {name for name, c in (("P", "p"), ("R", "r"), ("q", "q"), ("q_raw", "q_raw")) if c in columns}
        capable = self.robot.capabilities if self.robot else ()
        return got | {name for name, c in (("colliders", "COLLIDERS"), ("support_polygon", "SUPPORT_POLYGON")) if c in capable}


@dataclass(frozen=True)
class Metric:
    """A spec with how it is computed: either from shared columns (``needs``, ``total``) or by a table of its own (``table``).

    lacks: what of a context it cannot do without, as a reason.
    """

    spec: MetricSpec
    needs: tuple[str, ...] = ()
    total: Callable[[Context], Column] | None = None
    table: Callable[[DataFrame, Context], DataFrame] | None = None
    lacks: Callable[[Context], str | None] = lambda c: None


_mean = lambda c: F.avg(S.mean(F.col(c)))
_share = lambda c, over: F.avg(S.mean(F.transform(F.col(c), lambda x: (x > over).cast("double"))))


def _robot(c: Context) -> str | None:
    return None if c.robot else "missing_input:robot"


def _efforts(c: Context) -> str | None:
    return _robot(c) or (None if c.robot.effort_limits else "missing_input:effort_limits")


def _wobble(column: str, bones: tuple) -> Column:
    """The mean over bones of the deviation of a bone's length over time, in mm."""
    return sum((F.stddev_pop(F.get(column, F.lit(k))) for k in range(len(bones))), F.lit(0.0)) / F.lit(len(bones)) * 1000


def _residual(column: str, bones: tuple) -> Column:
    rest = F.array(*[F.lit(b[2]) for b in bones])
    return F.avg(S.mean(F.zip_with(F.col(column), rest, lambda x, y: F.abs(x - y)))) * 1000


def _smoothness(c: Context) -> Column:
    """The mean over sites of -ln of the dimensionless jerk, of those that have any."""
    n = F.count("*")
    each = []
    for s in c.sites:
        path = F.sum(F.get("v", F.lit(s))) * c.dt
        dlj = ((n - 1) * c.dt) ** 5 / path**2 * (F.sum(F.get("j", F.lit(s)) ** 2) * c.dt)
        each.append(F.when((path > 1e-9) & (dlj > 1e-9), -F.log(dlj)))
    some = sum((x.isNotNull().cast("int") for x in each), F.lit(0))
    return sum((F.coalesce(x, F.lit(0.0)) for x in each), F.lit(0.0)) / F.nullif(some, F.lit(0))


def _worst_bone(frames: DataFrame, c: Context) -> DataFrame:
    rows = metrics.rigidity(frames, [b[:2] for b in c.bones], [b[2] for b in c.bones])
    return rows.select("clip", "rigidity_worst_bone_mm")


def _sparc(frames: DataFrame, c: Context) -> DataFrame:
    parts = [metrics.sparc(frames, s, c.dt) for s in c.sites]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("clip").agg(F.avg("sparc").alias("sparc"))


def arms(robot: Robot) -> list[list[int]]:
    """The keypoints of each arm: as many runs as the robot has ends of arms."""
    n = len(robot.spec.keypoints) // len(robot.spec.sites)
    return [list(range(n * k, n * (k + 1))) for k in range(len(robot.spec.sites))]


def depths(frames: DataFrame, robot: Robot) -> DataFrame:
    """(clip, t, depth): how deep the arms of frames (clip, t, q) lie in the body's spheres or in one another."""
    keep = frames if "aux" in frames.columns else frames.withColumn("aux", F.lit(None).cast("array<double>"))
    balls = [s[3] for k in robot.spec.body for s in robot.links[k].spheres]
    body = kinematics.body_spheres(keep, robot)
    own = kinematics.keypoints(keep, robot).select(F.col("clip").alias("c"), F.col("t").alias("u"), "p")
    centres = F.flatten(F.transform("spheres", lambda s: F.array(s["x"], s["y"], s["z"])))
    both = body.join(own, F.col("clip").eqNullSafe(F.col("c")) & (F.col("t") == F.col("u"))).select("clip", "t", F.concat("p", centres).alias("p"))
    n = len(robot.spec.keypoints)
    return feasibility.penetration(both, arms(robot), {n + i: r for i, r in enumerate(balls)})


def _collisions(frames: DataFrame, c: Context) -> DataFrame:
    return feasibility.collisions(depths(frames, c.robot))


METRICS: Registry[Metric] = Registry("metric")


def _add(key: str, needs: str = "", total=None, **more) -> None:
    METRICS.register(key, Metric(metrics.SPECS[key], tuple(needs.split()), total, **more))


_add("rigidity_residual_mm", "b", lambda c: _residual("b", c.bones), lacks=_robot)
_add("rigidity_wobble_mm", "b", lambda c: _wobble("b", c.bones), lacks=_robot)
_add("rigidity_residual_all_mm", "every", lambda c: _residual("every", c.all_bones), lacks=_robot)
_add("rigidity_wobble_all_mm", "every", lambda c: _wobble("every", c.all_bones), lacks=_robot)
_add("rigidity_worst_bone_mm", table=_worst_bone, lacks=_robot)
_add("mean_speed_mps", "v", lambda c: _mean("v"))
_add("mean_accel_mps2", "a", lambda c: _mean("a"))
_add("max_accel_mps2", "a", lambda c: F.max(F.array_max("a")))
_add("mean_jerk_mps3", "j", lambda c: _mean("j"))
_add("accel_violation_frac", "a", lambda c: _share("a", metrics.ACCEL_BOUND))
_add("no_teleport_frac", "v", lambda c: F.avg((F.array_max("v") > metrics.TELEPORT_SPEED).cast("double")))
_add("mean_angvel_radps", "o", lambda c: _mean("o"))
_add("max_angvel_radps", "o", lambda c: F.max(F.array_max("o")))
_add("mean_angacc_radps2", "al", lambda c: _mean("al"))
_add("kinetic_energy_tstd", "v", lambda c: F.stddev_samp(0.5 * S.total(F.transform("v", lambda x: x * x))))
_add("total_energy_tstd", "v h", lambda c: F.stddev_samp(0.5 * S.total(F.transform("v", lambda x: x * x)) + metrics.GRAVITY * F.col("h")))
_add("momentum_dp_mean", "f", lambda c: F.avg("f"))
_add("limit_violation_frac", "x", lambda c: F.avg((F.col("x") > 0).cast("double")), lacks=_robot)
_add("limit_excess_rad", "x", lambda c: F.avg("x"), lacks=_robot)
_add("limit_headroom_rad", "room", lambda c: F.avg("room"), lacks=_robot)
_add("mean_qdot_radps", "vq", lambda c: _mean("vq"))
_add("mean_qddot_radps2", "aq", lambda c: _mean("aq"))
_add("vel_violation_frac", "vq", lambda c: F.avg(S.mean(F.zip_with("vq", F.array(*map(F.lit, c.robot.speed_limits)), lambda v, m: (v > m).cast("double")))), lacks=_robot)
_add("effort_proxy", "aq", lambda c: F.avg(S.total(F.zip_with("aq", F.array(*[F.lit(float(e)) for e in c.robot.effort_limits]), lambda a, e: a / e))), lacks=_efforts)
_add("sparc", table=_sparc, lacks=_robot)
_add("log_dimensionless_jerk", "v j", _smoothness, lacks=_robot)
_add("penetration_mm", table=_collisions, lacks=_robot)
_add("self_collision_frac", table=_collisions, lacks=_robot)
_add("com_margin_m", table=lambda f, c: kinematics.balance_margin(f, c.robot), lacks=_robot)
_add("torque_frac_rated", table=lambda f, c: dynamics.torque_share(f, c.robot, c.dt).select("clip", "torque_frac_rated"), lacks=lambda c: _robot(c) or dynamics.missing(c.robot))


def shared(c: Context, window) -> dict[str, Column]:
    """The columns of a frame that metrics sum up; only those that are asked for come into a plan."""
    lag = lambda col, n: F.lag(col, n).over(window)
    speed = lambda n: S.norms(S.difference("p", n, window, c.dt))
    links = lambda: len(c.robot.spec.keypoints) if c.robot else 0
    turn = lambda a, b: metrics.angular_velocity(a, b, links(), c.dt)
    limits = c.robot.limits if c.robot else []
    q = lambda col: [F.get(col, F.lit(k)) for k in range(len(limits))]
    zero = F.lit(0.0)
    return {
        "v": speed(1), "a": speed(2), "j": speed(3), "h": F.get(S.point_sum(lag("p", 1)), F.lit(2)),
        "f": F.get(S.norms(S.point_sum(S.difference("p", 2, window, c.dt))), F.lit(0)),
        "o": F.when(lag("r", 1).isNotNull(), S.norms(turn(F.col("r"), lag("r", 1)))),
        "al": F.when(lag("r", 2).isNotNull(), S.norms(F.zip_with(turn(F.col("r"), lag("r", 1)), turn(lag("r", 1), lag("r", 2)), lambda x, y: (x - y) / c.dt))),
        "vq": F.transform(S.difference("q", 1, window, c.dt), F.abs), "aq": F.transform(S.difference("q", 2, window, c.dt), F.abs),
        "b": S.bone_lengths(F.col("p"), [x[:2] for x in c.bones]), "every": S.bone_lengths(F.col("p"), [x[:2] for x in c.all_bones]),
        "x": sum((S.excess(v, F.lit(lo), F.lit(hi)) for v, (lo, hi) in zip(q("q_raw"), limits, strict=True)), zero),
        "room": F.array_min(F.array(*[F.least(F.lit(hi) - v, v - F.lit(lo)) for v, (lo, hi) in zip(q("q"), limits, strict=True)])),
    }


@dataclass(frozen=True)
class Suite:
    """Metrics in order; those of ``invariant`` form the normalised mean (all, unless named)."""

    name: str
    keys: tuple[str, ...]
    invariant: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if twice := sorted({k for k in self.keys if self.keys.count(k) > 1}):
            raise ValueError(f"{self.name}: {', '.join(twice)} more than once")
        for k in self.keys:
            METRICS.get(k)
        if self.invariant is None:
            object.__setattr__(self, "invariant", self.keys)
        if unknown := sorted(set(self.invariant) - set(self.keys)):
            raise ValueError(f"{self.name}: {', '.join(unknown)} not among its metrics")

    @property
    def suite_id(self) -> str:
        return metrics.suite_id(self.name, list(self.keys), list(self.invariant))

    @property
    def quantity_keys(self) -> tuple[str, ...]:
        """Metrics that have a value for each frame."""
        return tuple(k for k in self.keys if self.spec_of(k).perframe)

    def spec_of(self, key: str) -> MetricSpec:
        if key not in self.keys:
            raise KeyError(f"{key!r} is not in {self.name}")
        return METRICS.get(key).spec

    def describe(self) -> list[dict]:
        rows = []
        for s in map(self.spec_of, self.keys):
            rows.append({"key": s.key, "units": s.units, "dt_exponent": s.dt_exponent, "direction": s.direction, "requires": sorted(s.requires), "min_frames": s.min_frames, "unobservable_when": list(s.unobservable_when), "in_invariant": s.key in self.invariant})
        return rows


# The suites, whose identities depend on these names and their order.
_KEYS = (
    "rigidity_residual_mm", "rigidity_wobble_mm", "mean_speed_mps", "mean_accel_mps2", "max_accel_mps2", "mean_jerk_mps3", "accel_violation_frac", "mean_angvel_radps", "max_angvel_radps", "mean_angacc_radps2",
    "kinetic_energy_tstd", "total_energy_tstd", "momentum_dp_mean", "limit_violation_frac", "limit_excess_rad", "limit_headroom_rad", "mean_qdot_radps", "mean_qddot_radps2", "vel_violation_frac", "effort_proxy",
    "sparc", "log_dimensionless_jerk", "penetration_mm", "self_collision_frac", "com_margin_m", "no_teleport_frac",
)
_INVARIANT = (
    "rigidity_residual_mm", "rigidity_wobble_mm", "mean_jerk_mps3", "accel_violation_frac", "mean_angacc_radps2", "total_energy_tstd", "momentum_dp_mean", "limit_violation_frac", "vel_violation_frac", "effort_proxy",
)
SUITES: Registry[Suite] = Registry("suite")
SUITES.register("invariant_v1", Suite("invariant_v1", _KEYS, _INVARIANT))
SUITES.register("all_metrics", Suite("all_metrics", (*_KEYS, "torque_frac_rated", "rigidity_worst_bone_mm"), ()))
SUITES.register("rate_free", Suite("rate_free", tuple(k for k in _KEYS if metrics.SPECS[k].dt_exponent == 0), ()))


def reasons_before(spec: MetricSpec, c: Context, columns: list[str]) -> str | None:
    """Why a metric has no value whatever the clip: it cannot fire, or an input is missing."""
    for condition in spec.unobservable_when:
        flag, _, value = condition.partition("=")
        if c.flags.get(flag) == value:
            return f"unobservable:{condition}"
    missing = sorted(set(spec.requires) - c.available(columns))
    return f"missing_input:{','.join(missing)}" if missing else None


def totals(frames: DataFrame, keys: list[str], c: Context) -> DataFrame:
    """(clip, n_frames, metrics ...): one pass for all metrics of shared columns, and the tables of the others joined to it."""
    chosen = [METRICS.get(k) for k in keys]
    columns = shared(c, blocks.window())
    needed = list(dict.fromkeys(n for m in chosen for n in m.needs))
    rows = blocks.blocked(frames, REACH).select("clip", "own", *[columns[n].alias(n) for n in needed]).where("own")
    wide = rows.groupBy("clip").agg(F.count("*").alias("n_frames"), *[m.total(c).alias(m.spec.key) for m in chosen if m.total])
    tables: dict[object, list[str]] = {}
    for m in chosen:
        if m.table:
            tables.setdefault(m.table, []).append(m.spec.key)
    for of, own in tables.items():
        more = of(frames, c).select(F.col("clip").alias("__of"), *own)
        wide = wide.join(more, F.col("clip").eqNullSafe(F.col("__of")), "left").drop("__of")
    return wide


def evaluate(frames: DataFrame, suites: list[Suite], c: Context) -> DataFrame:
    """(clip, suite, suite_id, metric, value, reason) of each clip and metric of each suite: either a finite value or a reason.

    The set of metrics is the suite's for every clip. Reasons, in this order: the metric cannot fire,
    an input is missing, the clip is too short, the robot lacks something, the result is not finite.
    """
    keys = list(dict.fromkeys(k for s in suites for k in s.keys))
    first = {k: reasons_before(METRICS.get(k).spec, c, frames.columns) for k in keys}
    lacks = {k: METRICS.get(k).lacks(c) for k in keys}
    rows = totals(frames, [k for k in keys if not first[k] and not lacks[k]], c)
    each = {}
    for k in keys:
        spec = METRICS.get(k).spec
        few = F.when(F.col("n_frames") < spec.min_frames, F.concat(F.lit("too_few_frames:"), F.col("n_frames").cast("string"), F.lit(f"<{spec.min_frames}")))
        value = S.finite(F.col(k)) if k in rows.columns else F.lit(None).cast("double")
        reason = F.coalesce(F.lit(first[k]), few, F.lit(lacks[k]), F.when(value.isNull(), "degenerate_input:non_finite_result"))
        each[k] = F.struct(F.lit(k).alias("metric"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))
    of = [F.struct(F.lit(s.name).alias("suite"), F.lit(s.suite_id).alias("suite_id"), each[k].alias("m")) for s in suites for k in s.keys]
    return rows.select("clip", F.inline(F.array(*of))).select("clip", "suite", "suite_id", "m.*")


def scalars(rows: DataFrame, suite: Suite) -> DataFrame:
    """(clip, a column for each metric of the suite) of :func:`evaluate` rows; null where there is no value."""
    own = rows.where(F.col("suite_id") == suite.suite_id)
    return own.groupBy("clip").agg(*[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k) for k in suite.keys])


def reasons(rows: DataFrame) -> DataFrame:
    return rows.where("reason is not null").select("clip", "suite", "metric", "reason")


def perframe(frames: DataFrame, suite: Suite, c: Context) -> DataFrame:
    """(clip, metric, t, value) of the suite's metrics that have a value for each frame, as far as they have what they need."""
    w, parts = blocks.window(), []
    able = [k for k in suite.quantity_keys if not reasons_before(METRICS.get(k).spec, c, frames.columns) and not METRICS.get(k).lacks(c)]
    said = lambda df, k, v: df.select("clip", F.lit(k).alias("metric"), "t", v.alias("value"))
    if "no_teleport_frac" in able:
        rows = blocks.blocked(frames, 1).select("clip", "t", "own", F.array_max(shared(c, w)["v"]).alias("v")).where("own and v is not null")
        parts.append(said(rows, "no_teleport_frac", (F.col("v") > metrics.TELEPORT_SPEED).cast("double")))
    if "rigidity_worst_bone_mm" in able:
        parts.append(said(metrics.worst_bones(frames, [b[:2] for b in c.bones]), "rigidity_worst_bone_mm", F.col("d") * 1000))
    if "torque_frac_rated" in able:
        rows = dynamics.torques(dynamics.prepared(frames, c.robot, 1.0), c.robot, c.dt).where("inner")
        share = rows.groupBy("clip", "t").agg((100 * F.max(F.abs("tau") / F.col("effort"))).alias("s"))
        parts.append(said(share, "torque_frac_rated", F.col("s")))
    if not parts:
        return frames.sparkSession.createDataFrame([], f"clip {dict(frames.dtypes)['clip']}, metric string, t long, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
