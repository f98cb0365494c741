"""Torque of chains of links by Newton and Euler: forces and turning of each link, summed from the tip by virtual work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.functions import series as S
from strider.functions import spatial as V
from strider.operators import blocks, feasibility, order
from strider.robots import kinematics
from strider.robots.body import Robot

# Gravity in m/s^2, and the percentile of a clip's frames that counts as its peak.
GRAVITY, PEAK = 9.81, 98.0


@dataclass(frozen=True)
class Chain:
    """An open chain: its joints, the links they move (and one at the end if it has a mass of its own), and what each needs."""

    name: str
    joints: tuple[str, ...]
    links: tuple[str, ...]
    axes: tuple[tuple[float, ...], ...]
    efforts: tuple[float | None, ...]

    def reasons(self, robot: Robot) -> tuple[list[str], list[str]]:
        """(joints without a rated effort, links without a mass), each as chain:name."""
        weak = [f"{self.name}:{j}" for j, e in zip(self.joints, self.efforts, strict=True) if e is None]
        light = [f"{self.name}:{k}" for k in self.links if robot.links[k].mass is None]
        return weak, light


def chain(robot: Robot, name: str, joints: tuple[str, ...], end: str | None = None) -> Chain:
    """The chain of ``joints`` from base to tip; an effort that is missing or not positive is None, not unlimited."""
    if missing := [j for j in joints if j not in robot.joints]:
        raise ValueError(f"joints absent from the description: {', '.join(missing)}")
    own = [robot.joints[j] for j in joints]
    links, axes = [j.child for j in own], [j.axis for j in own]
    if end in robot.links and robot.links[end].mass is not None and end not in links:
        links, axes = [*links, end], [*axes, (0.0, 0.0, 0.0)]
    efforts = tuple(j.effort if j.effort is not None and j.effort > 0 else None for j in own)
    return Chain(name, tuple(joints), tuple(links), tuple(axes), efforts)


def chains(robot: Robot) -> list[Chain]:
    return [chain(robot, *c) for c in robot.spec.chains]


def missing(robot: Robot) -> str | None:
    """Why there is no torque of this robot: no chain, joints without a rated effort, links without a mass; else None."""
    found = [c.reasons(robot) for c in chains(robot)]
    if not found:
        return f"unsupported_robot:{robot.spec.name}"
    for what, k in (("effort_limits", 0), ("inertial", 1)):
        if bad := [x for c in found for x in c[k]]:
            return f"missing_input:{what}:{','.join(bad)}"
    return None


def torques(frames: DataFrame, robot: Robot, dt: float, gravity: float = GRAVITY) -> DataFrame:
    """(clip, t, chain, joint, effort, tau, inner) of each joint of the robot's chains in each frame.

    A row is a link in a frame. Its acceleration and turning are central differences of its
    neighbours in time, in blocks of a clip; forces and moments are summed from the tip to each joint.
    inner is false at the first and last frame of a clip, which have no neighbour and hold still here.
    Frames are numbered one by one within a clip.
    """
    given = [(c.name, i, c.joints[i] if i < len(c.joints) else None, k, c.efforts[i] if i < len(c.joints) else None, list(c.axes[i]), robot.links[k].mass, list(robot.links[k].com), list(robot.links[k].inertia)) for c in chains(robot) for i, k in enumerate(c.links)]
    kinds = "chain string, i int, joint string, of string, effort double, axis array<double>, mass double, com array<double>, inertia array<double>"
    parts = F.broadcast(frames.sparkSession.createDataFrame(given, kinds))
    posed = kinematics.link_poses(frames, robot, list(dict.fromkeys(g[3] for g in given)))
    return _summed(_moments(blocks.blocked(posed, 2).join(parts, F.col("link") == F.col("of")), dt, gravity))


def _moments(rows: DataFrame, dt: float, gravity: float) -> DataFrame:
    """(clip, t, chain, i, joint, effort, inner, p, z, f, n, m): of each link its place, the joint's axis, force, and moments about its centre and about the root."""
    w = blocks.window("chain", "i")
    near = lambda c, k: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w)
    name = lambda stem, values: [V.column(x).alias(f"{stem}{k}") for k, x in enumerate(values)]
    col = lambda stem, n=3: [F.col(f"{stem}{k}") for k in range(n)]
    flat = lambda c, n: [F.get(c, F.lit(k)) for k in range(n)]
    keys = ["clip", "t", "block", "own", "chain", "i", "joint", "effort", "mass"]
    r, place = flat("r", 9), [F.col("x"), F.col("y"), F.col("z")]
    at = rows.select(*keys, *name("r", r), *name("p", place), *name("c", V.plus(place, V.turn(r, flat("com", 3)))), *name("a", V.turn(r, flat("axis", 3))), "inertia")
    inner = near("t", 1).isNotNull() & near("t", -1).isNotNull()
    still = lambda x: F.when(F.col("inner"), x).otherwise(0.0)
    neighbours = at.select("*", inner.alias("inner"), *[near(f"r{k}", s).alias(f"{n}{k}") for k in range(9) for n, s in (("b", 1), ("e", -1))], *[near(f"c{k}", s).alias(f"{n}{k}") for k in range(3) for n, s in (("u", 1), ("v", -1))])
    rate = V.vee(V.product(V.times(0.5 / dt, V.minus(col("e", 9), col("b", 9))), V.transpose(col("r", 9))))
    pull = [(v - 2 * c + u) / dt**2 for u, c, v in zip(col("u"), col("c"), col("v"), strict=True)]
    tensor = V.congruent(col("r", 9), flat("inertia", 9))
    sped = neighbours.select(*keys, "inner", *col("p"), *col("c"), *col("a"), *name("w", map(still, rate)), *name("q", map(still, pull)), *name("j", tensor))
    gain = sped.select("*", *[still((near(f"w{k}", -1) - near(f"w{k}", 1)) / (2 * dt)).alias(f"g{k}") for k in range(3)]).where("own")
    force = V.times(F.col("mass"), V.plus(col("q"), [0.0, 0.0, gravity]))
    moment = V.plus(V.turn(col("j", 9), col("g")), V.cross(col("w"), V.turn(col("j", 9), col("w"))))
    forces = gain.select("clip", "t", "chain", "i", "joint", "effort", "inner", *col("p"), *col("a"), *col("c"), *name("f", force), *name("n", moment))
    return forces.select("clip", "t", "chain", "i", "joint", "effort", "inner", *col("p"), *col("a"), *col("f"), *name("m", V.plus(col("n"), V.cross(col("c"), col("f")))))


def _summed(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("clip", "t", "chain").orderBy(F.desc("i"))
    beyond = lambda stem: [F.sum(f"{stem}{k}").over(w).alias(f"s{stem}{k}") for k in range(3)]
    col = lambda stem: [F.col(f"{stem}{k}") for k in range(3)]
    total = rows.select("*", *beyond("f"), *beyond("m")).where("joint is not null")
    tau = V.dot(col("a"), V.minus(col("sm"), V.cross(col("p"), col("sf"))))
    return total.select("clip", "t", "chain", "joint", "effort", tau.alias("tau"), "inner")


def prepared(frames: DataFrame, robot: Robot, sigma: float) -> DataFrame:
    """``frames`` with q smoothed over time and kept within the robot's limits."""
    rows = blocks.blocked(frames, max(1, feasibility.smoothing_reach(sigma)))
    rows = feasibility.smoothed(rows, sigma, blocks.window()).where("own").drop("block", "own")
    lo, hi = zip(*robot.limits, strict=True)
    kept = [S.clamp(F.get("q", F.lit(k)), F.lit(a), F.lit(b)) for k, (a, b) in enumerate(zip(lo, hi, strict=True))]
    return rows.withColumn("q", F.array(*kept))


def clamped(frames: DataFrame, limits: list[tuple[float, float]]) -> DataFrame:
    """(clip, t, q, overshoot): q within the limits, and how far it was outside at most; null values stay null."""
    q = [F.get("q", F.lit(k)) for k in range(len(limits))]
    out = [S.excess(x, F.lit(a), F.lit(b)) for x, (a, b) in zip(q, limits, strict=True)]
    return frames.select("clip", "t", F.array(*[S.clamp(x, F.lit(a), F.lit(b)) for x, (a, b) in zip(q, limits, strict=True)]).alias("q"), F.array_max(F.array(*out)).alias("overshoot"))


def torque_share(frames: DataFrame, robot: Robot, dt: float, sigma: float = 1.0, pct: float = PEAK) -> DataFrame:
    """(clip, torque_frac_rated, reason): of each inner frame the joint with the largest share of its rated effort, of these the percentile, in percent.

    q is smoothed and clamped alike for all clips. No value and a reason where the robot lacks what it
    takes (:func:`missing`) or a clip has fewer than three frames.
    """
    counts = frames.groupBy("clip").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("double").alias("torque_frac_rated")
    if reason := missing(robot):
        return counts.select("clip", none, F.lit(reason).alias("reason"))
    rows = torques(prepared(frames, robot, sigma), robot, dt).where("inner")
    most = rows.groupBy("clip", "t").agg(F.max(F.abs("tau") / F.col("effort")).alias("s"))
    peaks = order.percentile(most, ["clip"], "s", pct / 100, "peak").select(F.col("clip").alias("of"), "peak")
    few = F.when(F.col("n") < 3, F.concat(F.lit("too_few_frames:"), F.col("n").cast("string"), F.lit("<3")))
    return counts.join(peaks, F.col("clip").eqNullSafe(F.col("of")), "left").select("clip", (100 * F.col("peak")).alias("torque_frac_rated"), few.alias("reason"))
