"""Queries of robot descriptions, spatial kinematics and dynamics over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.functions import spatial as V
from strider.operators import metrics
from strider.robots import body, description, dynamics, kinematics
from strider.sources import tables

DT = 0.1

# A robot of a turning column, an arm of turning and sliding joints with two fingers, a head and feet.
ARM = """<?xml version="1.0"?>
<robot name="column_arm">
  <link name="base"><inertial><origin xyz="0 0 0.2"/><mass value="12"/><inertia ixx="0.4" ixy="0" ixz="0" iyy="0.4" iyz="0" izz="0.3"/></inertial>
    <collision><origin xyz="0 0 0.25"/><geometry><cylinder radius="0.18" length="0.5"/></geometry></collision></link>
  <link name="column"><inertial><origin xyz="0 0.02 0.15" rpy="0 0 0.3"/><mass value="6"/><inertia ixx="0.2" ixy="0.01" ixz="0" iyy="0.2" iyz="0.02" izz="0.1"/></inertial></link>
  <link name="upper"><inertial><origin xyz="0 0 0.2" rpy="0.2 0 0"/><mass value="3"/><inertia ixx="0.05" ixy="0" ixz="0.002" iyy="0.05" iyz="0" izz="0.01"/></inertial></link>
  <link name="fore"><inertial><origin xyz="0.01 0 0.12"/><mass value="2"/><inertia ixx="0.03" ixy="0" ixz="0" iyy="0.03" iyz="0.001" izz="0.006"/></inertial></link>
  <link name="slider"><inertial><mass value="0.8"/><inertia ixx="0.004" ixy="0" ixz="0" iyy="0.004" iyz="0" izz="0.002"/></inertial></link>
  <link name="hand"><inertial><origin xyz="0 0 0.05"/><mass value="0.6"/><inertia ixx="0.002" ixy="0" ixz="0" iyy="0.001" iyz="0" izz="0.001"/></inertial></link>
  <link name="left_finger"/><link name="right_finger"/>
  <link name="head"><inertial><mass value="1.5"/><inertia ixx="0.01" ixy="0" ixz="0" iyy="0.01" iyz="0" izz="0.01"/></inertial>
    <collision><origin xyz="0 0 0.1"/><geometry><sphere radius="0.12"/></geometry></collision></link>
  <link name="left_foot"/><link name="right_foot"/>
  <joint name="waist" type="revolute"><origin xyz="0 0 0.5"/><parent link="base"/><child link="column"/><axis xyz="0 0 1"/><limit lower="-0.4" upper="0.4" velocity="2" effort="80"/></joint>
  <joint name="shoulder" type="revolute"><origin xyz="0.1 0 0.3" rpy="0.3 -0.2 0.1"/><parent link="column"/><child link="upper"/><axis xyz="0 1 0"/><limit lower="-0.5" upper="0.6" velocity="2" effort="60"/></joint>
  <joint name="elbow" type="revolute"><origin xyz="0 0.05 0.4" rpy="0 0.5 0"/><parent link="upper"/><child link="fore"/><axis xyz="1 1 0"/><limit lower="-0.6" upper="0.6" effort="30"/></joint>
  <joint name="slide" type="prismatic"><origin xyz="0 0 0.2"/><parent link="fore"/><child link="slider"/><axis xyz="0 0 2"/><limit lower="-0.3" upper="0.3" velocity="1" effort="100"/></joint>
  <joint name="wrist" type="continuous"><origin xyz="0.02 0 0.1" rpy="0 0 1"/><parent link="slider"/><child link="hand"/><axis xyz="1 0 0"/><limit velocity="5" effort="10"/></joint>
  <joint name="left_grip" type="prismatic"><origin xyz="0 0 0.1"/><parent link="hand"/><child link="left_finger"/><axis xyz="0 1 0"/><limit lower="0" upper="0.04"/></joint>
  <joint name="right_grip" type="prismatic"><origin xyz="0 0 0.1"/><parent link="hand"/><child link="right_finger"/><axis xyz="0 -1 0"/><limit lower="0" upper="0.04"/></joint>
  <joint name="neck" type="fixed"><origin xyz="0 0 0.6" rpy="0.1 0 0"/><parent link="column"/><child link="head"/></joint>
  <joint name="left_leg" type="fixed"><origin xyz="0 0.2 0"/><parent link="base"/><child link="left_foot"/></joint>
  <joint name="right_leg" type="fixed"><origin xyz="0 -0.2 0"/><parent link="base"/><child link="right_foot"/></joint>
</robot>"""
MOVED = ("waist", "shoulder", "elbow", "slide", "wrist")
SPEC = body.Spec(
    "column_arm", MOVED, ("column", "upper", "fore", "hand", "left_finger", "right_finger"), ("hand",), {"left_grip": (0, 0.04, 0.0), "right_grip": (0, 0.04, 0.0)}, ("left_finger", "right_finger"),
    (("arm", MOVED[1:], "left_finger"),), ("base", "head"), ("left_foot", "right_foot"),
)


def arm(spark: SparkSession) -> body.Robot:
    return body.Robot.read(spark.createDataFrame([("arm.urdf", ARM)], "path string, text string"), SPEC)


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    """Doubles rounded; a zero has no sign."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(clip, t, q, aux): of each label's vectors five components, doubled, as joints, and the size of a sixth as the grip."""
    own = tables.numbered_vectors(spark, d)
    return own.select("clip", "t", F.transform(F.slice("e", 1, 5), lambda x: x * 2).alias("q"), F.array(F.abs(F.get("e", F.lit(5)))).alias("aux"))


def _arm(of):
    return lambda spark, d: _rounded(of(frames(spark, d), arm(spark)))


def _link_poses(f: DataFrame, robot: body.Robot) -> DataFrame:
    rows = kinematics.link_poses(f, robot)
    return rows.select("clip", "t", "link", "x", "y", "z", *[F.get("r", F.lit(k)).alias(f"r{k}") for k in (0, 5, 7)])


def _angular(f: DataFrame, robot: body.Robot) -> DataFrame:
    return metrics.angular_3d(kinematics.keypoints(f, robot), len(SPEC.keypoints), DT)


def _mass(f: DataFrame, robot: body.Robot) -> DataFrame:
    rows = kinematics.centre_of_mass(f, robot)
    return rows.select("clip", "t", *[F.get("com", F.lit(k)).alias(c) for k, c in enumerate("xyz")])


def _rigid(f: DataFrame, robot: body.Robot) -> DataFrame:
    rigid = [(i, j, length) for i, j, length, kept, _ in kinematics.bones(f.sparkSession, robot) if kept]
    return metrics.rigidity(kinematics.keypoints(f, robot), [(i, j) for i, j, _ in rigid], [length for *_, length in rigid])


def _torques(f: DataFrame, robot: body.Robot) -> DataFrame:
    return dynamics.torques(f, robot, DT).where("inner").select("clip", "t", "joint", "tau")


def _spheres(f: DataFrame, robot: body.Robot) -> DataFrame:
    return kinematics.body_spheres(f, robot).select("clip", "t", F.posexplode("spheres").alias("sphere", "s")).select("clip", "t", "sphere", "s.*")


def _overshoot(f: DataFrame, robot: body.Robot) -> DataFrame:
    rows = dynamics.clamped(f, robot.limits)
    return rows.select("clip", "t", "overshoot", *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(4)])


def written_robots(spark: SparkSession, d: str) -> DataFrame:
    """(path, text): a description of each 40 customers with neighbouring keys, some of them flawed.

    A customer is a link, n its place, the link at n / 2 its parent. The kind of a joint follows n, its
    lower limit the balance, so that some are empty; the joint of a customer whose key is a multiple of
    50 names a link that is not there, that of a multiple of 35 has no number as its limit, and every
    fourth file has no end.
    """
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    rows = tables.table(spark, d, "customer").select(F.floor(key / 40).alias("file"), (key % 40).alias("n"), key.alias("key"), balance.alias("balance"))
    n, key = F.col("n"), F.col("key")
    link = F.format_string('<link name="s%s"><inertial><mass value="%s"/><inertia ixx="1" ixy="0" ixz="0" iyy="1" iyz="0" izz="1"/></inertial></link>', n, (key % 7).cast("string"))
    kind = F.when(n % 3 == 0, "fixed").when(n % 3 == 1, "revolute").otherwise("prismatic")
    parent = F.when(key % 50 == 0, F.concat(F.lit("t"), n.cast("string"))).otherwise(F.concat(F.lit("s"), F.floor(n / 2).cast("string")))
    lower = F.when(key % 35 == 0, F.lit("low")).otherwise(F.round(F.col("balance") / 10000, 4).cast("string"))
    joint = F.format_string('<joint name="j%s" type="%s"><origin xyz="0 0 0.%s"/><parent link="%s"/><child link="s%s"/><axis xyz="0 3 4"/><limit lower="%s" upper="0.5"/></joint>', n, kind, n % 10, parent, n, lower)
    said = F.concat(link, F.when(n > 0, joint).otherwise(""))
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", said.alias("said")))).alias("parts"))
    end = F.when(F.col("file") % 4 == 3, "").otherwise("</robot>")
    text = F.concat(F.format_string('<robot name="n%s">', "file"), F.array_join(F.col("parts.said"), ""), end)
    return whole.select(F.format_string("n%s.urdf", "file").alias("path"), text.alias("text"))


def _described(of):
    return lambda spark, d: of(description.parsed(written_robots(spark, d)))


def _joints(r: DataFrame) -> DataFrame:
    rows = description.joints(r)
    return _rounded(rows.select("robot", "joint", "kind", "parent", "child", F.get("xyz", F.lit(2)).alias("z"), F.get("axis", F.lit(1)).alias("ay"), F.get("axis", F.lit(2)).alias("az"), "lower", "upper"))


QUERIES = {
    "fk_links": _arm(_link_poses),
    "fk_sites": _arm(kinematics.site_poses),
    "fk_body_spheres": _arm(_spheres),
    "fk_centre_of_mass": _arm(_mass),
    "fk_balance": _arm(kinematics.balance_margin),
    "joints_clamped": _arm(_overshoot),
    "metrics_angular_3d": _arm(_angular),
    "metrics_rigidity_robot": _arm(_rigid),
    "torque_joints": _arm(_torques),
    "metrics_torque_chain": _arm(lambda f, robot: dynamics.torque_share(f, robot, DT)),
    "robot_links": _described(lambda r: description.links(r).select("robot", "link", "mass", F.get("inertia", F.lit(8)).alias("izz"))),
    "robot_joints": _described(_joints),
    "robot_joint_limits": _described(lambda r: _rounded(description.joint_limits(description.joints(r), 0.2))),
    "robot_problems": _described(description.problems),
    "robot_depths": _described(lambda r: description.depths(description.joints(r))),
}

# The robot's joints as SQL's rows: link, parent, origin, its rotation, axis, kind and which value moves it.
_TREE = (
    ("column", "base", (0, 0, 0.5), (0, 0, 0), (0, 0, 1), "r", 1), ("upper", "column", (0.1, 0, 0.3), (0.3, -0.2, 0.1), (0, 1, 0), "r", 2),
    ("fore", "upper", (0, 0.05, 0.4), (0, 0.5, 0), (0.5**0.5, 0.5**0.5, 0), "r", 3), ("slider", "fore", (0, 0, 0.2), (0, 0, 0), (0, 0, 1), "p", 4),
    ("hand", "slider", (0.02, 0, 0.1), (0, 0, 1), (1, 0, 0), "r", 5), ("left_finger", "hand", (0, 0, 0.1), (0, 0, 0), (0, 1, 0), "p", 6), ("right_finger", "hand", (0, 0, 0.1), (0, 0, 0), (0, -1, 0), "p", 6),
    ("head", "column", (0, 0, 0.6), (0.1, 0, 0), (0, 0, 1), "f", 7), ("left_foot", "base", (0, 0.2, 0), (0, 0, 0), (0, 0, 1), "f", 7), ("right_foot", "base", (0, -0.2, 0), (0, 0, 0), (0, 0, 1), "f", 7),
)
_R = ", ".join(f"r{k}" for k in range(9))
#: A link's mass, centre and inertia in its own axes, as the description gives them.
_MASSES = (
    ("base", 12, (0, 0, 0.2), (0, 0, 0), (0.4, 0, 0, 0.4, 0, 0.3)), ("column", 6, (0, 0.02, 0.15), (0, 0, 0.3), (0.2, 0.01, 0, 0.2, 0.02, 0.1)), ("upper", 3, (0, 0, 0.2), (0.2, 0, 0), (0.05, 0, 0.002, 0.05, 0, 0.01)),
    ("fore", 2, (0.01, 0, 0.12), (0, 0, 0), (0.03, 0, 0, 0.03, 0.001, 0.006)), ("slider", 0.8, (0, 0, 0), (0, 0, 0), (0.004, 0, 0, 0.004, 0, 0.002)), ("hand", 0.6, (0, 0, 0.05), (0, 0, 0), (0.002, 0, 0, 0.001, 0, 0.001)),
    ("head", 1.5, (0, 0, 0), (0, 0, 0), (0.01, 0, 0, 0.01, 0, 0.01)),
)


def _rpy_sql(rpy: tuple) -> str:
    return ", ".join(repr(float(x)) for x in V.from_rpy(*rpy))


def _poses_sql(values: str) -> str:
    """Recursive SQL of (clip, t, link, x, y, z, r0 .. r8) of frames whose values are the list ``values`` of the row's vector e."""
    tree = ", ".join(f"('{k}', '{p}', {', '.join(repr(float(x)) for x in (*o, *a))}, '{kind}', {at}, {_rpy_sql(rpy)})" for k, p, o, rpy, a, kind, at in _TREE)
    about = []
    for i in range(3):
        for j in range(3):
            hat = {(0, 1): "-a2", (0, 2): "a1", (1, 0): "a2", (1, 2): "-a0", (2, 0): "-a1", (2, 1): "a0"}.get((i, j), "0")
            about.append(f"CASE WHEN kind = 'r' THEN {'cos(v) + ' if i == j else ''}a{i}*a{j}*(1-cos(v)) + ({hat})*sin(v) ELSE {1 if i == j else 0} END AS m{3 * i + j}")
    local = ", ".join(f"{' + '.join(f'o{3 * i + k}*m{3 * k + j}' for k in range(3))} AS l{3 * i + j}" for i in range(3) for j in range(3))
    shift = ", ".join(f"h{i} + CASE WHEN kind = 'p' THEN ({' + '.join(f'o{3 * i + k}*a{k}' for k in range(3))})*v ELSE 0 END AS s{i}" for i in range(3))
    turned = ", ".join(f"{' + '.join(f'p.r{3 * i + k}*l.l{3 * k + j}' for k in range(3))}" for i in range(3) for j in range(3))
    moved = ", ".join(f"p.{c} + {' + '.join(f'p.r{3 * i + k}*l.s{k}' for k in range(3))}" for i, c in enumerate("xyz"))
    return f"""kp AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
fr AS ({values}),
tree(link, parent, h0, h1, h2, a0, a1, a2, kind, vi, {", ".join(f"o{k}" for k in range(9))}) AS (VALUES {tree}),
ab AS (SELECT clip, t, tree.*, v[vi] AS v FROM fr, tree), mm AS (SELECT *, {", ".join(about)} FROM ab),
lo AS (SELECT clip, t, link, parent, {local}, {shift} FROM mm),
pose AS (SELECT clip, t, 'base' AS link, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z, {", ".join(f"{float(x)}::DOUBLE AS r{k}" for k, x in enumerate(V.IDENTITY))} FROM fr
  UNION ALL SELECT l.clip, l.t, l.link, {moved}, {turned} FROM pose p JOIN lo l ON p.clip = l.clip AND p.t = l.t AND l.parent = p.link)"""


_VALUES = "SELECT clip, t, list_transform(e[1:5], lambda x: x * 2) || [abs(e[6]) * 0.04, 0] AS v FROM kp"
_POSES = _poses_sql(_VALUES)
_COM = f"""mass(link, mass, c0, c1, c2) AS (VALUES {", ".join(f"('{k}', {float(m)}, {', '.join(repr(float(x)) for x in c)})" for k, m, c, *_ in _MASSES)}),
com AS (SELECT clip, t, {", ".join(f"sum(mass*({c} + r{3 * i}*c0 + r{3 * i + 1}*c1 + r{3 * i + 2}*c2))/sum(mass) AS {c}" for i, c in enumerate("xyz"))} FROM pose JOIN mass USING (link) GROUP BY clip, t)"""
_KEYPOINTS = "('column', 'upper', 'fore', 'hand', 'left_finger', 'right_finger')"


def _vee_sql(a: str, b: str, scale: str) -> str:
    """Columns o0 .. o2: half the skew part of A B^T, times ``scale``; a and b have {k} for the place in a matrix."""
    entry = lambda i, j: "(" + " + ".join(f"({a.format(k=3 * i + k)})*({b.format(k=3 * j + k)})" for k in range(3)) + ")"
    return ", ".join(f"0.5*({entry(i, j)} - {entry(j, i)})*{scale} AS o{n}" for n, (i, j) in enumerate(((2, 1), (0, 2), (1, 0))))


def _torque_sql(values: str) -> str:
    """Recursive SQL of tau (clip, t, joint, effort, tau) of the arm's inner frames."""
    rows = []
    for i, (link, joint, axis, effort) in enumerate((("upper", "shoulder", (0, 1, 0), 60), ("fore", "elbow", (0.5**0.5, 0.5**0.5, 0), 30), ("slider", "slide", (0, 0, 1), 100), ("hand", "wrist", (1, 0, 0), 10))):
        _, m, c, rpy, (xx, xy, xz, yy, yz, zz) = next(r for r in _MASSES if r[0] == link)
        tensor = V.congruent(V.from_rpy(*rpy), [xx, xy, xz, xy, yy, yz, xz, yz, zz])
        rows.append(f"('{link}', '{joint}', {i}, {effort}, {float(m)}, {', '.join(repr(float(x)) for x in (*c, *axis, *tensor))})")
    w = "WINDOW w AS (PARTITION BY clip, link ORDER BY t)"
    near = lambda c: f"lag({c}) OVER w AS b_{c}, lead({c}) OVER w AS e_{c}"
    turn = lambda i, m, v: " + ".join(f"{m}{3 * i + k}*{v}{k}" for k in range(3))
    tensor = lambda i, j: " + ".join(f"r{3 * i + k}*i{3 * k + m}*r{3 * j + m}" for k in range(3) for m in range(3))
    cross = lambda a, b: [f"({a}{i}*{b}{j} - {a}{j}*{b}{i})" for i, j in ((1, 2), (2, 0), (0, 1))]
    sx = ("sf0", "sf1", "sf2")
    arm_of = [f"(p{i}*{sx[j]} - p{j}*{sx[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    return f"""{_poses_sql(values)},
ch(link, joint, i, effort, mass, c0, c1, c2, x0, x1, x2, {", ".join(f"i{k}" for k in range(9))}) AS (VALUES {", ".join(rows)}),
w1 AS (SELECT clip, t, link, joint, i, effort, mass, {_R}, x AS p0, y AS p1, z AS p2, {", ".join(f"{c} + r{3 * k}*c0 + r{3 * k + 1}*c1 + r{3 * k + 2}*c2 AS g{k}" for k, c in enumerate("xyz"))},
  {", ".join(f"r{3 * k}*x0 + r{3 * k + 1}*x1 + r{3 * k + 2}*x2 AS z{k}" for k in range(3))}, {", ".join(f"{tensor(i, j)} AS j{3 * i + j}" for i in range(3) for j in range(3))} FROM pose JOIN ch USING (link)),
w2 AS (SELECT *, {", ".join(near(f"g{k}") for k in range(3))}, {", ".join(near(f"r{k}") for k in range(9))} FROM w1 {w}),
w3 AS (SELECT *, b_g0 IS NOT NULL AND e_g0 IS NOT NULL AS inner_, {_vee_sql("e_r{k} - b_r{k}", "r{k}", "5.0")} FROM w2),
w4 AS (SELECT * REPLACE (CASE WHEN inner_ THEN o0 ELSE 0 END AS o0, CASE WHEN inner_ THEN o1 ELSE 0 END AS o1, CASE WHEN inner_ THEN o2 ELSE 0 END AS o2) FROM w3),
w5 AS (SELECT *, {", ".join(f"(lead(o{k}) OVER w - lag(o{k}) OVER w)*5.0 AS d{k}" for k in range(3))} FROM w4 {w}),
w6 AS (SELECT *, {", ".join(f"mass*((e_g{k} - 2*g{k} + b_g{k})/0.01 {'+ 9.81' if k == 2 else ''}) AS f{k}, {turn(k, 'j', 'o')} AS h{k}" for k in range(3))} FROM w5 WHERE inner_),
w7 AS (SELECT *, {", ".join(f"{turn(k, 'j', 'd')} + {c} + {g} AS m{k}" for k, (c, g) in enumerate(zip(cross("o", "h"), cross("g", "f"), strict=True)))} FROM w6),
w8 AS (SELECT *, {", ".join(f"sum(f{k}) OVER v AS sf{k}, sum(m{k}) OVER v AS sm{k}" for k in range(3))} FROM w7 WINDOW v AS (PARTITION BY clip, t ORDER BY i DESC)),
tau AS (SELECT clip, t, joint, effort, {" + ".join(f"z{k}*(sm{k} - {arm_of[k]})" for k in range(3))} AS tau FROM w8)"""


_SMOOTH = """SELECT clip, t, list_transform([s[1], s[2], s[3], s[4], s[5]], lambda x: x) || [0.0, 0.0] AS v FROM (
  SELECT clip, t, [greatest(least(q[1], 0.4), -0.4), greatest(least(q[2], 0.6), -0.5), greatest(least(q[3], 0.6), -0.6), greatest(least(q[4], 0.3), -0.3), q[5]] AS s FROM (
    SELECT a.clip, a.t, list_value({}) AS q FROM kp a JOIN (SELECT clip, max(t) AS top FROM kp GROUP BY clip) n USING (clip), range(-3, 4) g(k)
      JOIN kp b ON b.clip = a.clip AND b.t = greatest(1, least(n.top, a.t + g.k)) GROUP BY a.clip, a.t))""".format(
    ", ".join(f"sum(b.e[{j}]*2*exp(-0.5*g.k*g.k))/(SELECT sum(exp(-0.5*k*k)) FROM range(-3, 4) g(k))" for j in range(1, 6))
)
_CUSTOMERS = """s AS (SELECT c_custkey // 40 AS file, c_custkey AS key, c_acctbal AS bal, c_custkey % 40 AS n FROM customer),
g AS (SELECT *, 'n' || file AS robot, 's' || n AS link, 'j' || n AS joint, CASE n % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'revolute' ELSE 'prismatic' END AS kind,
  CASE WHEN key % 50 = 0 THEN 't' || n ELSE 's' || (n // 2) END AS parent, CASE WHEN key % 35 <> 0 THEN round(bal / 10000, 4) END AS lower FROM s WHERE file % 4 <> 3)"""

SQL = {
    "fk_links": f"WITH RECURSIVE {_POSES} SELECT clip, t, link, round(x,5) AS x, round(y,5) AS y, round(z,5) AS z, round(r0,5) AS r0, round(r5,5) AS r5, round(r7,5) AS r7 FROM pose",
    "fk_sites": f"""WITH RECURSIVE {_POSES}, a AS (SELECT *, acos(least(greatest((r0+r4+r8-1)/2, -1+1e-6), 1-1e-6)) AS a FROM pose WHERE link = 'hand'), b AS (SELECT *, a/greatest(sin(a), 1e-6)/2 AS s FROM a)
SELECT clip, t, link AS site, round(x,5) AS x, round(y,5) AS y, round(z,5) AS z, round((r7-r5)*s,5) AS rx, round((r2-r6)*s,5) AS ry, round((r3-r1)*s,5) AS rz FROM b""",
    "fk_body_spheres": f"""WITH RECURSIVE {_POSES}, b(sphere, link, c, radius) AS (VALUES (0, 'base', 0.0, 0.18), (1, 'base', 0.25, 0.18), (2, 'base', 0.5, 0.18), (3, 'head', 0.1, 0.12))
SELECT clip, t, sphere, round(x+r2*c,5) + 0.0 AS x, round(y+r5*c,5) + 0.0 AS y, round(z+r8*c,5) + 0.0 AS z, radius::DOUBLE AS radius FROM pose JOIN b USING (link)""",
    "fk_centre_of_mass": f"WITH RECURSIVE {_POSES}, {_COM} SELECT clip, t, round(x,5) AS x, round(y,5) AS y, round(z,5) AS z FROM com",
    "fk_balance": f"WITH RECURSIVE {_POSES}, {_COM} SELECT clip, round(avg(least(x+0.12, 0.12-x, y+0.32, 0.32-y)),5) AS com_margin_m FROM com GROUP BY clip",
    "joints_clamped": f"""WITH RECURSIVE {_POSES}, b AS (SELECT clip, t, [greatest(v[1]-0.4,0)+greatest(-0.4-v[1],0), greatest(v[2]-0.6,0)+greatest(-0.5-v[2],0), greatest(v[3]-0.6,0)+greatest(-0.6-v[3],0), greatest(v[4]-0.3,0)+greatest(-0.3-v[4],0)] AS o, v FROM fr)
SELECT clip, t, round(list_max(o),5) AS overshoot, round(greatest(least(v[1],0.4),-0.4),5) AS q0, round(greatest(least(v[2],0.6),-0.5),5) AS q1, round(greatest(least(v[3],0.6),-0.6),5) AS q2, round(greatest(least(v[4],0.3),-0.3),5) AS q3 FROM b""",
    "metrics_angular_3d": f"""WITH RECURSIVE {_POSES}, k AS (SELECT *, {", ".join(f"lag(r{k}) OVER w AS b{k}" for k in range(9))} FROM pose WHERE link IN {_KEYPOINTS} WINDOW w AS (PARTITION BY clip, link ORDER BY t)),
o AS (SELECT clip, t, link, {_vee_sql("r{k}", "b{k}", "10.0")} FROM k), a AS (SELECT *, sqrt(o0**2+o1**2+o2**2) AS s, sqrt((o0-lag(o0) OVER w)**2+(o1-lag(o1) OVER w)**2+(o2-lag(o2) OVER w)**2)*10 AS a FROM o WINDOW w AS (PARTITION BY clip, link ORDER BY t))
SELECT clip, count(*)//6 AS n_frames, round(avg(s),5) AS mean_angvel_radps, round(max(s),5) AS max_angvel_radps, round(avg(a),5) AS mean_angacc_radps2 FROM a GROUP BY clip""",
    "metrics_rigidity_robot": f"""WITH RECURSIVE {_POSES}, b(i, a, c, rest) AS (VALUES (0, 'column', 'upper', sqrt(0.1)), (1, 'upper', 'fore', sqrt(0.1625)), (2, 'fore', 'hand', sqrt(0.0904))),
l AS (SELECT p.clip, p.t, i, rest, sqrt((p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2) AS l FROM b JOIN pose p ON p.link = a JOIN pose q ON q.link = c AND q.clip = p.clip AND q.t = p.t),
m AS (SELECT clip, i, avg(abs(l-rest)) AS r, stddev_pop(l) AS s, quantile_disc(l, 0.5) AS m FROM l GROUP BY ALL), d AS (SELECT clip, avg(d) AS d FROM (SELECT clip, t, max(abs(l-m)) AS d FROM l JOIN m USING (clip, i) GROUP BY clip, t) GROUP BY clip)
SELECT clip, round(avg(r)*1000,5) AS rigidity_residual_mm, round(avg(s)*1000,5) AS rigidity_wobble_mm, round(any_value(d)*1000,5) AS rigidity_worst_bone_mm FROM m JOIN d USING (clip) GROUP BY clip""",
    "torque_joints": f"WITH RECURSIVE {_torque_sql(_VALUES)} SELECT clip, t, joint, round(tau,5) AS tau FROM tau",
    "metrics_torque_chain": f"WITH RECURSIVE {_torque_sql(_SMOOTH)}, m AS (SELECT clip, t, max(abs(tau)/effort) AS s FROM tau GROUP BY clip, t) SELECT kp.clip, round(100*(SELECT quantile_cont(s, 0.98) FROM m WHERE m.clip = kp.clip),5) AS torque_frac_rated, CASE WHEN count(*) < 3 THEN 'too_few_frames:' || count(*) || '<3' END AS reason FROM kp GROUP BY kp.clip",
    "robot_links": f"WITH {_CUSTOMERS} SELECT robot, link, CASE WHEN key % 7 > 0 THEN (key % 7)::DOUBLE END AS mass, CASE WHEN key % 7 > 0 THEN 1.0::DOUBLE END AS izz FROM g",
    "robot_joints": f"WITH {_CUSTOMERS} SELECT robot, joint, kind, parent, link AS child, (n % 10)/10.0::DOUBLE AS z, 0.6::DOUBLE AS ay, 0.8::DOUBLE AS az, lower, 0.5::DOUBLE AS upper FROM g WHERE n > 0",
    "robot_joint_limits": f"WITH {_CUSTOMERS} SELECT robot, joint, round(coalesce(lower, 0) - 0.2,5) AS lower, 0.7::DOUBLE AS upper, 1000.0::DOUBLE AS velocity, NULL::DOUBLE AS effort FROM g WHERE n % 3 > 0",
    "robot_depths": f"""WITH RECURSIVE {_CUSTOMERS}, e AS (SELECT robot, parent, link, (n % 3 > 0)::INT AS moves FROM g WHERE n > 0),
d AS (SELECT DISTINCT robot, parent AS link, 0 AS depth FROM e WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.robot = e.robot AND c.link = e.parent) UNION ALL SELECT e.robot, e.link, d.depth + e.moves FROM d JOIN e ON e.robot = d.robot AND e.parent = d.link)
SELECT * FROM d""",
    "robot_problems": f"""WITH {_CUSTOMERS}
SELECT DISTINCT 'n' || file || '.urdf' AS robot, 'unreadable' AS problem FROM s WHERE file % 4 = 3
UNION ALL SELECT robot, 'unknown_link:' || parent FROM g WHERE n > 0 AND key % 50 = 0 UNION ALL SELECT robot, 'not_a_number:' || joint FROM g WHERE n > 0 AND lower IS NULL
UNION ALL SELECT robot, 'empty_range:' || joint FROM g WHERE n % 3 > 0 AND coalesce(lower, 0) > 0.5""",
}
