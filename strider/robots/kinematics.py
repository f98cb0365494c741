"""Forward kinematics of a tree of joints as columns: a stage of the plan for each level of the tree.

A frame is (clip, t, q[, aux]): the values of the spec's joints, and those of driven ones. The pose
of a link is twelve columns, its rotation row by row and its place, in the axes of its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.functions import spatial as V
from strider.robots.body import DEGENERATE_BONE, Joint, Robot

Pose = tuple[list[V.Number], list[V.Number]]
_ROOT: Pose = (V.IDENTITY, [0.0, 0.0, 0.0])


def joint_value(robot: Robot, joint: Joint) -> V.Number:
    """Where a frame holds the joint's value; joints that it does not hold rest at zero."""
    if joint.name in robot.spec.joints:
        return F.get("q", F.lit(robot.spec.joints.index(joint.name)))
    if joint.name in robot.spec.driven:
        place, factor, offset = robot.spec.driven[joint.name]
        return F.coalesce(F.get("aux", F.lit(place)), F.lit(0.0)) * factor + offset
    return 0.0


def step(joint: Joint, value: V.Number, base: Pose) -> Pose:
    """The pose of a joint's child from that of its parent."""
    rotation, place = base
    at = V.plus(place, V.turn(rotation, list(joint.xyz)))
    frame = V.product(rotation, list(joint.rotation))
    if joint.kind in ("revolute", "continuous"):
        return V.product(frame, V.about(list(joint.axis), value)), at
    if joint.kind == "prismatic":
        return frame, V.plus(at, V.turn(frame, V.times(value, list(joint.axis))))
    return frame, at


def posed(frames: DataFrame, robot: Robot, links: list[str], points: dict[str, list[V.Number]] | None = None) -> tuple[DataFrame, dict[str, Pose]]:
    """``frames`` with the poses of ``links`` as columns, and by link where they are.

    Only joints above the links are posed. Each level of the tree is a projection of its own, so an
    expression refers to its parent's columns and never holds its parent's expression.
    """
    if "aux" not in frames.columns:
        frames = frames.withColumn("aux", F.lit(None).cast("array<double>"))
    known: dict[str, Pose] = {}
    held: dict[str, list[str]] = {}
    paths = {k: robot.above(k) for k in links}
    keep, numbers = list(frames.columns), {name: n for n, name in enumerate(robot.joints)}
    for level in range(max(map(len, paths.values()), default=0)):
        here = {p[level].name: p[level] for p in paths.values() if len(p) > level}
        new = {j.child: (numbers[j.name], step(j, joint_value(robot, j), known.get(j.parent, _ROOT))) for j in here.values()}
        needed = {k for k, p in paths.items() if len(p) <= level}
        older = [c for k in held if k in needed for c in held[k]]
        columns: dict[str, Column] = {}
        for link, (n, (rotation, place)) in new.items():
            values = {f"__{n}_{k}": x for k, x in enumerate([*rotation, *place])}
            held[link] = [c for c, x in values.items() if isinstance(x, Column)]
            columns |= {c: values[c] for c in held[link]}
            named = [F.col(c) if isinstance(x, Column) else x for c, x in values.items()]
            known[link] = (named[:9], named[9:])
        frames = frames.select(*[F.col(f"`{c}`") for c in (*keep, *older)], *[x.alias(c) for c, x in columns.items()])
    return frames, {k: known.get(k, _ROOT) for k in links}


def _flat(values: list[V.Number]) -> Column:
    return F.array(*map(V.column, values))


def keypoints(frames: DataFrame, robot: Robot, links: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(clip, t, keep, p, r): places and rotations of the spec's keypoints (or of ``links``), flat, nine values a rotation."""
    links = list(robot.spec.keypoints) if links is None else links
    rows, poses = posed(frames, robot, links)
    return rows.select("clip", "t", *keep, _flat([x for k in links for x in poses[k][1]]).alias("p"), _flat([x for k in links for x in poses[k][0]]).alias("r"))


def link_poses(frames: DataFrame, robot: Robot, links: list[str] | None = None) -> DataFrame:
    """(clip, t, link, x, y, z, r) of each frame and link (all, unless named); r holds nine values."""
    links = list(robot.links) if links is None else links
    rows, poses = posed(frames, robot, links)
    each = [F.struct(F.lit(k).alias("link"), *[V.column(x).alias(c) for c, x in zip("xyz", poses[k][1], strict=True)], _flat(poses[k][0]).alias("r")) for k in links]
    return rows.select("clip", "t", F.inline(F.array(*each)))


def site_poses(frames: DataFrame, robot: Robot) -> DataFrame:
    """(clip, t, site, x, y, z, rx, ry, rz): place and rotation vector of each end of an arm."""
    rows = link_poses(frames, robot, list(robot.spec.sites))
    turned = V.rotation_vector(V.parts(F.col("r"), 0, 9))
    return rows.select("clip", "t", F.col("link").alias("site"), "x", "y", "z", *[x.alias(c) for c, x in zip(("rx", "ry", "rz"), turned, strict=True)])


def rest(spark: SparkSession, robot: Robot) -> DataFrame:
    """The one frame in which all joints are at zero."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    extra = 1 + max((place for place, _, _ in robot.spec.driven.values()), default=0)
    return spark.range(1).select(F.lit(0).alias("clip"), F.lit(0).alias("t"), zeros(len(robot.spec.joints)).alias("q"), zeros(extra).alias("aux"))


def bones(spark: SparkSession, robot: Robot, at: list[str] | None = None) -> list[tuple[int, int, float, bool, str]]:
    """(i, j, length at rest, rigid, name) of neighbouring keypoints: rigid if no end is actuated and it is not degenerate."""
    links = list(robot.spec.keypoints) if at is None else at
    p = keypoints(rest(spark, robot), robot, links).first()["p"]
    out = []
    for i, j in zip(range(len(links)), range(1, len(links)), strict=False):
        length = sum((p[3 * j + c] - p[3 * i + c]) ** 2 for c in range(3)) ** 0.5
        rigid = length > DEGENERATE_BONE and not {links[i], links[j]} & set(robot.spec.actuated)
        out.append((i, j, length, rigid, f"{links[i]}->{links[j]}"))
    return out


def body_spheres(frames: DataFrame, robot: Robot) -> DataFrame:
    """(clip, t, spheres): centre and radius of each sphere of the body's links."""
    rows, poses = posed(frames, robot, list(robot.spec.body))
    balls = [(V.plus(poses[k][1], V.turn(poses[k][0], list(s[:3]))), s[3]) for k in robot.spec.body for s in robot.links[k].spheres]
    each = [F.struct(*[V.column(x).alias(c) for c, x in zip("xyz", at, strict=True)], F.lit(float(radius)).alias("radius")) for at, radius in balls]
    return rows.select("clip", "t", F.array(*each).alias("spheres"))


def centre_of_mass(frames: DataFrame, robot: Robot) -> DataFrame:
    """(clip, t, com, feet): the centre of mass of all links that have one, and the places of the feet."""
    heavy = [k for k in robot.links.values() if k.mass is not None]
    if not heavy:
        raise ValueError("no link has a mass")
    feet = list(robot.spec.feet)
    rows, poses = posed(frames, robot, [*[k.name for k in heavy], *feet])
    total = sum(k.mass for k in heavy)
    at = [V.plus(poses[k.name][1], V.turn(poses[k.name][0], list(k.com))) for k in heavy]
    com = [V.add(*[V.mul(k.mass / total, p[c]) for k, p in zip(heavy, at, strict=True)]) for c in range(3)]
    return rows.select("clip", "t", _flat(com).alias("com"), _flat([x for k in feet for x in poses[k][1]]).alias("feet"))


def balance_margin(frames: DataFrame, robot: Robot, half: float = 0.12) -> DataFrame:
    """(clip, com_margin_m): mean of how far the centre of mass lies inside the rectangle round the feet, seen from above."""
    rows, n = centre_of_mass(frames, robot), len(robot.spec.feet)
    margins = []
    for c in range(2):
        com, at = F.get("com", F.lit(c)), F.array(*[F.get("feet", F.lit(3 * k + c)) for k in range(n)])
        margins += [com - (F.array_min(at) - half), (F.array_max(at) + half) - com]
    return rows.select("clip", F.least(*margins).alias("m")).groupBy("clip").agg(F.avg("m").alias("com_margin_m"))
