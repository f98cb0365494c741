"""One robot as the planner of its columns sees it: a tree of joints, its links, and what of it is scored."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.functions import spatial as V
from strider.robots import description

#: Joints and links of one robot at most; a description beyond is refused, as all of it becomes one plan.
MOST_PARTS = 1000
#: Fixed value: a bone of at most so many metres at rest is degenerate.
DEGENERATE_BONE = 1e-3


@dataclass(frozen=True)
class Joint:
    name: str
    kind: str
    parent: str
    child: str
    xyz: tuple[float, ...]
    rotation: tuple[float, ...]
    axis: tuple[float, ...]
    lower: float | None
    upper: float | None
    velocity: float
    effort: float | None


@dataclass(frozen=True)
class Link:
    """mass, centre of mass and inertia about it in the link's axes, all None without; spheres of its shapes (x, y, z, radius)."""

    name: str
    mass: float | None
    com: tuple[float, ...] | None
    inertia: tuple[float, ...] | None
    spheres: tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Spec:
    """What of a robot is read and scored.

    joints: those whose values a frame holds, in order. driven: of further joints (place in the
    frame's extra values, factor, offset). keypoints, sites (ends of arms), actuated (links that
    driven joints move), chains for torque (name, joints, link at the end), body (links to keep
    clear of), feet. margin widens the limits. observed: whether joints are read from pictures at all.
    """

    name: str
    joints: tuple[str, ...]
    keypoints: tuple[str, ...]
    sites: tuple[str, ...] = ()
    driven: dict[str, tuple[int, float, float]] = field(default_factory=dict)
    actuated: tuple[str, ...] = ()
    chains: tuple[tuple[str, tuple[str, ...], str | None], ...] = ()
    body: tuple[str, ...] = ()
    feet: tuple[str, ...] = ()
    margin: float = 0.0


_SIDES = ("left", "right")


def _both(names: str, numbers=None) -> tuple[str, ...]:
    """``names`` (with {s} for the side and {i} for each of ``numbers``) of the left, then the right."""
    return tuple(n.format(s=s, S=s[0].upper(), i=i) for s in _SIDES for n in names.split() for i in (numbers if "{i}" in n else [0]))


def _side(names: tuple[str, ...], side: str) -> tuple[str, ...]:
    half = len(names) // 2
    return names[:half] if side == "left" else names[half:]


# Joints, keypoints and factors of the supported robots.
_PANDA = tuple(f"panda_joint{i}" for i in range(1, 8))
_GR1_ARMS = _both("{s}_shoulder_pitch_joint {s}_shoulder_roll_joint {s}_shoulder_yaw_joint {s}_elbow_pitch_joint {s}_wrist_yaw_joint {s}_wrist_roll_joint {s}_wrist_pitch_joint")
_GR1_FINGERS = (
    ("thumb_proximal_yaw", 4, -1.0), ("thumb_proximal_pitch", 5, 1.0), ("thumb_distal", 5, 1.0), ("index_proximal", 0, -1.0), ("index_intermediate", 0, -1.0), ("middle_proximal", 1, -1.0),
    ("middle_intermediate", 1, -1.0), ("ring_proximal", 2, -1.0), ("ring_intermediate", 2, -1.0), ("pinky_proximal", 3, -1.0), ("pinky_intermediate", 3, -1.0),
)
SPECS = {s.name: s for s in (
    Spec(
        "franka_panda", _PANDA, ("panda_link1", "panda_link3", "panda_link5", "panda_link7", "panda_hand", "panda_leftfinger", "panda_rightfinger", "panda_hand_tcp"), ("panda_hand_tcp",),
        {f"panda_finger_joint{i}": (0, 0.04, 0.0) for i in (1, 2)}, ("panda_leftfinger", "panda_rightfinger"),
    ),
    Spec(
        "fourier_gr1", _GR1_ARMS + ("waist_yaw_joint", "waist_pitch_joint", "waist_roll_joint"),
        _both("{s}_upper_arm_pitch_link {s}_upper_arm_yaw_link {s}_lower_arm_pitch_link {s}_hand_yaw_link {s}_hand_pitch_link {s}_end_effector_link"), _both("{s}_end_effector_link"),
        {f"{s[0].upper()}_{n}_joint": (6 * k + place, factor, 0.0) for k, s in enumerate(_SIDES) for n, place, factor in _GR1_FINGERS},
        chains=tuple((s, _side(_GR1_ARMS, s), f"{s}_end_effector_link") for s in _SIDES),
        body=("torso_link", "base_link", "head_pitch_link"), feet=("left_foot_roll_link", "right_foot_roll_link"), margin=0.20,
    ),
    Spec("airbot_mmk2", _both("{s}_arm_joint_{i}", range(1, 7)), _both("{s}_link{i}", range(1, 7)), _both("{s}_link6")),
    Spec(
        "aloha_bimanual", _both("{s}/waist {s}/shoulder {s}/elbow {s}/forearm_roll {s}/wrist_angle {s}/wrist_rotate"),
        _both("{s}/shoulder_link {s}/upper_arm_link {s}/upper_forearm_link {s}/lower_forearm_link {s}/wrist_link {s}/gripper_link {s}/left_finger_link {s}/right_finger_link {s}/ee_gripper_link"),
        _both("{s}/ee_gripper_link"),
        {f"{s}/{f}_finger": (k, sign * (0.057 - 0.021), sign * 0.021) for k, s in enumerate(_SIDES) for f, sign in (("left", 1.0), ("right", -1.0))},
        _both("{s}/left_finger_link {s}/right_finger_link"),
    ),
)}


def available() -> list[str]:
    return sorted(SPECS)


def get(name: str) -> Spec:
    if name not in SPECS:
        raise KeyError(f"no robot {name!r}; there are {', '.join(available())}")
    return SPECS[name]


@dataclass(frozen=True)
class Robot:
    """A spec with its description: joints by name in the order of the file, links by name."""

    spec: Spec
    joints: dict[str, Joint]
    links: dict[str, Link]
    sha256: str | None = None

    @staticmethod
    def read(files: DataFrame, spec: Spec, robot: str | None = None, spheres: int = 3) -> Robot:
        """The robot named ``robot`` (else the spec's name) of description files; one of them, so it passes through the driver.

        A cylinder becomes ``spheres`` spheres along its axis. Raises where the spec names a joint, keypoint or other link that is not there.
        """
        own = description.parsed(files).where(F.col("robot") == (robot or spec.name))
        first = own.select("sha256").limit(2).collect()
        if len(first) != 1:
            raise ValueError(f"{len(first) or 'no'} description{'s' if first else ''} of {robot or spec.name!r}")
        rows = [description.joints(own).orderBy("at").limit(MOST_PARTS + 1).collect(), description.links(own).orderBy("at").limit(MOST_PARTS + 1).collect()]
        if max(map(len, rows)) > MOST_PARTS:
            raise ValueError(f"more than {MOST_PARTS} joints or links")
        joints = {
            r.joint: Joint(r.joint, r.kind, r.parent, r.child, tuple(r.xyz), tuple(V.from_rpy(*r.rpy)), tuple(r.axis), r.lower, r.upper, description.DEFAULT_SPEED if r.velocity is None else r.velocity, r.effort)
            for r in rows[0]
        }
        links = {}
        for r in rows[1]:
            inertia = tuple(V.congruent(V.from_rpy(*r.com_rpy), list(r.inertia))) if r.mass is not None else None
            balls = []
            for s in r.shapes:
                frame = V.from_rpy(*s.rpy)
                heights = [0.0] if s.kind == "sphere" else [(k / (spheres - 1) - 0.5) * s.length for k in range(spheres)]
                balls += [(*V.plus(list(s.xyz), V.turn(frame, [0.0, 0.0, h])), s.radius) for h in heights]
            links[r.link] = Link(r.link, r.mass, tuple(r.com) if r.mass is not None else None, inertia, tuple(balls))
        out = Robot(spec, joints, links, first[0].sha256)
        wanted = {*spec.keypoints, *spec.sites, *spec.body, *spec.feet}
        if missing := sorted(wanted - set(links)):
            raise ValueError(f"links absent from the description: {', '.join(missing)}")
        if missing := sorted({*spec.joints, *(j for _, js, _ in spec.chains for j in js)} - set(joints)):
            raise ValueError(f"joints absent from the description: {', '.join(missing)}")
        if missing := [j for j in spec.joints if joints[j].kind in description.LIMITED and joints[j].lower is None and joints[j].upper is None]:
            raise ValueError(f"joints without a limit: {', '.join(missing)}")
        return out

    def above(self, link: str) -> list[Joint]:
        """The joints from the root to a link; raises if they go in a circle."""
        by_child, out = {j.child: j for j in self.joints.values()}, []
        while link in by_child:
            out.append(by_child[link])
            link = out[-1].parent
            if len(out) > len(self.joints):
                raise ValueError(f"the joints above {out[0].child} go in a circle")
        return out[::-1]

    def depth(self, link: str) -> int:
        return sum(j.kind in description.MOVING for j in self.above(link))

    @property
    def limits(self) -> list[tuple[float, float]]:
        """(lower, upper) of the spec's joints, widened by its margin; without bounds for joints that need none."""
        m = self.spec.margin
        own = [self.joints[j] for j in self.spec.joints]
        return [((j.lower or 0.0) - m, (j.upper or 0.0) + m) if j.kind in description.LIMITED else (-math.inf, math.inf) for j in own]

    @property
    def speed_limits(self) -> list[float]:
        return [self.joints[j].velocity for j in self.spec.joints]

    @property
    def effort_limits(self) -> list[float] | None:
        """Rated efforts, or None if a joint names none."""
        own = [self.joints[j].effort for j in self.spec.joints]
        return None if any(e is None for e in own) else own

    @property
    def capabilities(self) -> frozenset[str]:
        has = {"ROTATIONS": True, "EFFORT_LIMITS": self.effort_limits is not None, "COLLIDERS": any(self.links[k].spheres for k in self.spec.body), "SUPPORT_POLYGON": bool(self.spec.feet)}
        return frozenset(k for k, v in has.items() if v)
