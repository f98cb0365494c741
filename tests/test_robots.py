"""Robot descriptions, spatial kinematics and dynamics against closed forms and numpy."""

import math

import numpy as np
import pytest

from strider.functions import spatial as V
from strider.operators import blocks, metrics
from strider.plans import robots as plans
from strider.robots import body, description, dynamics, kinematics

FRAME = "clip long, t long, q array<double>, aux array<double>"


def files(spark, *texts):
    return spark.createDataFrame([(f"f{k}.urdf", t) for k, t in enumerate(texts)], "path string, text string")


def pose(xyz, rpy):
    r, p, y = rpy
    x = np.array([[1, 0, 0], [0, math.cos(r), -math.sin(r)], [0, math.sin(r), math.cos(r)]])
    yy = np.array([[math.cos(p), 0, math.sin(p)], [0, 1, 0], [-math.sin(p), 0, math.cos(p)]])
    z = np.array([[math.cos(y), -math.sin(y), 0], [math.sin(y), math.cos(y), 0], [0, 0, 1]])
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = z @ yy @ x, xyz
    return m


def test_spatial_numbers():
    rng = np.random.default_rng(0)
    rpy, axis, angle = rng.uniform(-2, 2, 3), rng.standard_normal(3), 0.7
    axis /= np.linalg.norm(axis)
    assert np.allclose(np.reshape(V.from_rpy(*rpy), (3, 3)), pose([0, 0, 0], rpy)[:3, :3])
    turned = np.reshape(V.about(list(axis), angle), (3, 3))
    assert np.allclose(turned @ axis, axis) and np.isclose(np.trace(turned), 1 + 2 * math.cos(angle))
    assert np.allclose(V.vee(list(turned.ravel())), axis * math.sin(angle))
    a, b = rng.standard_normal(9), rng.standard_normal(9)
    assert np.allclose(V.product(list(a), list(b)), (a.reshape(3, 3) @ b.reshape(3, 3)).ravel())
    assert np.allclose(V.cross(list(a[:3]), list(b[:3])), np.cross(a[:3], b[:3]))


def test_files_as_a_source(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "arm.urdf").write_text(plans.ARM)
    (tmp_path / "bad.urdf").write_text("<robot><link")
    read = description.read_files(spark, str(tmp_path))
    robots = description.parsed(read)
    assert {(r.robot.rsplit("/")[-1], r.readable) for r in robots.collect()} == {("column_arm", True), ("bad.urdf", False)}
    import hashlib

    assert hashlib.sha256(plans.ARM.encode()).hexdigest() in {r.sha256 for r in robots.collect()}
    assert [r.problem for r in description.problems(robots).collect()] == ["unreadable"]
    robot = body.Robot.read(read, plans.SPEC)
    assert robot.sha256 and robot.depth("left_finger") == 6 and robot.depth("head") == 1 and robot.depth("base") == 0
    assert robot.limits[0] == (-0.4, 0.4) and robot.limits[4] == (-math.inf, math.inf)
    assert robot.speed_limits == [2.0, 2.0, 1000.0, 1.0, 5.0] and robot.effort_limits == [80, 60, 30, 100, 10]
    assert robot.capabilities == {"ROTATIONS", "EFFORT_LIMITS", "COLLIDERS", "SUPPORT_POLYGON"}
    link = {r.link: r for r in description.links(robots).collect()}["column"]
    assert (link.mass, link.com, link.inertia[1]) == (6.0, [0.0, 0.02, 0.15], 0.01)


def test_problems(spark):
    link = lambda *names: "".join(f'<link name="{n}"/>' for n in names)
    joint = lambda n, p, c, kind="fixed", more="": f'<joint name="{n}" type="{kind}">{p and f"""<parent link="{p}"/>"""}{c and f"""<child link="{c}"/>"""}{more}</joint>'
    cases = {
        "": {"unreadable"}, "<robot name='empty'/>": {"no_links"}, f"<robot name='r2'>{link('a', 'a')}</robot>": {"duplicate_link:a"},
        f"<robot name='r3'>{link('a', 'b')}{joint('j', 'a', 'b')}{joint('j', 'a', 'b')}</robot>": {"duplicate_joint:j", "two_parents:b"},
        f"<robot name='r4'>{link('a', 'b')}{joint('j', '', 'b')}{joint('k', 'a', '')}</robot>": {"no_parent:j", "no_child:k"},
        f"<robot name='r5'>{link('a', 'b', 'c')}{joint('j', 'a', 'b')}</robot>": {"several_roots"},
        f"<robot name='r6'>{link('a', 'b')}{joint('j', 'a', 'b')}{joint('k', 'b', 'a')}</robot>": {"no_root", "unreachable:a", "unreachable:b"},
        f"<robot name='r7'>{link('a', 'b')}{joint('j', 'a', 'b', 'revolute')}</robot>": {"no_limit:j"},
        f"""<robot name='r8'>{link('a', 'b')}{joint('j', 'a', 'b', 'prismatic', '<limit lower="2" upper="1"/>')}</robot>""": {"empty_range:j"},
        f"""<robot name='r9'>{link('a', 'b')}{joint('j', 'a', 'b', 'fixed', '<origin xyz="1 2"/>')}</robot>""": {"not_a_number:j"},
        f"""<robot name='ra'>{link('b')}{joint('j', 'a', 'b')}</robot>""": {"unknown_link:a", "no_root"},
    }
    robots = description.parsed(files(spark, *cases))
    found = {}
    for r in description.problems(robots).collect():
        found.setdefault(r.robot, set()).add(r.problem)
    names = [r.robot for r in sorted(robots.collect(), key=lambda r: int(r.path[1:].split(".")[0]))]
    assert found == dict(zip(names, cases.values(), strict=True))
    assert description.problems(description.parsed(files(spark))).count() == 0


def test_refusals(spark):
    one = files(spark, plans.ARM)
    for spec, said in ((body.Spec("nobody", (), ()), "no description"), (body.Spec("column_arm", ("knee",), ()), "joints absent"), (body.Spec("column_arm", (), ("tail",)), "links absent"), (body.Spec("column_arm", ("neck",), ()), None)):
        if said:
            with pytest.raises(ValueError, match=said):
                body.Robot.read(one, spec)
        else:
            assert body.Robot.read(one, spec).limits == [(-math.inf, math.inf)]
    with pytest.raises(ValueError, match="2 descriptions"):
        body.Robot.read(files(spark, plans.ARM, plans.ARM), plans.SPEC)
    with pytest.raises(KeyError, match="franka_panda"):
        body.get("nothing")
    assert body.available() == ["airbot_mmk2", "aloha_bimanual", "fourier_gr1", "franka_panda"]
    gr1 = body.get("fourier_gr1")
    assert len(gr1.joints) == 17 and len(gr1.keypoints) == 12 and gr1.driven["R_thumb_distal_joint"] == (11, 1.0, 0.0) and gr1.joints[7] == "right_shoulder_pitch_joint"
    assert len(body.get("aloha_bimanual").keypoints) == 18 and body.get("aloha_bimanual").driven["right/right_finger"][0] == 1


def test_forward_kinematics_equals_products_of_matrices(spark):
    rng = np.random.default_rng(4)
    robot = plans.arm(spark)
    q, grip = rng.uniform(-3, 3, (20, 5)), rng.uniform(0, 1, 20)
    frames = spark.createDataFrame([(0, t, q[t].tolist(), [float(grip[t])]) for t in range(20)], FRAME)
    got = {(r.t, r.link): r for r in kinematics.link_poses(frames, robot).collect()}
    assert len(got) == 20 * len(robot.links)
    for t in range(20):
        values = dict(zip(plans.MOVED, q[t], strict=True)) | {"left_grip": 0.04 * grip[t], "right_grip": 0.04 * grip[t]}
        for link in robot.links:
            m = np.eye(4)
            for j in robot.above(link):
                step = np.eye(4)
                step[:3, :3], step[:3, 3] = np.reshape(j.rotation, (3, 3)), j.xyz
                move, v = np.eye(4), values.get(j.name, 0.0)
                if j.kind in ("revolute", "continuous"):
                    move[:3, :3] = np.reshape(V.about(list(j.axis), v), (3, 3))
                elif j.kind == "prismatic":
                    move[:3, 3] = v * np.array(j.axis)
                m = m @ step @ move
            r = got[t, link]
            assert np.allclose([r.x, r.y, r.z], m[:3, 3]) and np.allclose(r.r, m[:3, :3].ravel())


def test_planar_arm_is_a_special_case(spark):
    text = """<robot name="planar"><link name="b"/><link name="u"/><link name="f"/><link name="tip"/>
      <joint name="a" type="revolute"><parent link="b"/><child link="u"/><limit lower="-9" upper="9"/></joint>
      <joint name="c" type="revolute"><origin xyz="0.4 0 0"/><parent link="u"/><child link="f"/><limit lower="-9" upper="9"/></joint>
      <joint name="e" type="fixed"><origin xyz="0.3 0 0"/><parent link="f"/><child link="tip"/></joint></robot>"""
    robot = body.Robot.read(files(spark, text), body.Spec("planar", ("a", "c"), ("b", "f", "tip")))
    rng = np.random.default_rng(2)
    frames = spark.createDataFrame([(c, t, rng.uniform(-0.5, 0.5, 2).tolist(), None) for c in (1, 2) for t in range(1, 9)], FRAME)
    flat, solid = metrics.arm_2r(frames), kinematics.keypoints(frames, robot)
    for a, b in zip(flat.orderBy("clip", "t").collect(), solid.orderBy("clip", "t").collect(), strict=True):
        assert np.allclose(a.p, b.p)
    two = [{r.clip: [r[c] for c in ("mean_angvel_radps", "max_angvel_radps", "mean_angacc_radps2")] for r in df.collect()} for df in (metrics.angular(flat, 0.1), metrics.angular_3d(kinematics.keypoints(frames, robot, ["b", "u", "f"]), 3, 0.1))]
    assert all(np.allclose(two[0][c], two[1][c]) for c in (1, 2))


def test_rest_bones_and_sites(spark):
    robot = plans.arm(spark)
    found = kinematics.bones(spark, robot)
    assert [(i, j, kept) for i, j, _, kept, _ in found] == [(0, 1, True), (1, 2, True), (2, 3, True), (3, 4, False), (4, 5, False)]
    assert found[4][2] == 0.0 and found[4][4] == "left_finger->right_finger"
    frames = spark.createDataFrame([(0, 1, [0.5, 0.0, 0.0, 0.0, 0.0], None)], FRAME)
    site = kinematics.site_poses(frames, body.Robot(body.Spec("column_arm", plans.MOVED, (), ("head", "column")), robot.joints, robot.links)).collect()
    column = next(r for r in site if r.site == "column")
    assert np.allclose([column.rx, column.ry, column.rz], [0, 0, 0.5], atol=1e-5)


PENDULUM = """<robot name="pendulum"><link name="b"/>
  <link name="rod"><inertial><origin xyz="{c} 0 0"/><mass value="{m}"/><inertia ixx="0.01" ixy="0" ixz="0" iyy="{i}" iyz="0" izz="{i}"/></inertial></link>
  <joint name="a" type="continuous"><parent link="b"/><child link="rod"/><axis xyz="0 -1 0"/><limit effort="10" velocity="9"/></joint></robot>"""


def test_torque_of_a_pendulum(spark):
    c, m, i, dt = 0.5, 2.0, 0.3, 1e-3
    robot = body.Robot.read(files(spark, PENDULUM.format(c=c, m=m, i=i)), body.Spec("pendulum", ("a",), ("rod",), chains=(("arm", ("a",), None),)))
    t = np.arange(1, 200)
    angle = 0.8 * np.sin(5 * t * dt)
    frames = spark.createDataFrame([(0, int(k), [float(a)], None) for k, a in zip(t, angle, strict=True)], FRAME)
    rows = sorted((r for r in dynamics.torques(frames, robot, dt).collect()), key=lambda r: r.t)
    assert [r.inner for r in rows] == [False, *[True] * 197, False]
    want = (i + m * c * c) * (-25 * angle) + m * 9.81 * c * np.cos(angle)
    # From the third frame on, since the turning of an end counts as none.
    assert np.allclose([r.tau for r in rows][2:-2], want[2:-2], atol=2e-3)
    still = spark.createDataFrame([(0, k, [0.3], None) for k in range(1, 6)], FRAME)
    assert np.allclose([r.tau for r in dynamics.torques(still, robot, 0.1).collect()], m * 9.81 * c * math.cos(0.3))


def test_torque_reasons(spark):
    whole = PENDULUM.format(c=0.5, m=2, i=0.3)
    spec = body.Spec("pendulum", ("a",), ("rod",), chains=(("arm", ("a",), None),))
    read = lambda text, spec=spec: body.Robot.read(files(spark, text), spec)
    frames = spark.createDataFrame([(1, 1, [0.1], None), (1, 2, [0.1], None), *[(2, k, [0.1], None) for k in range(4)]], FRAME)
    said = lambda robot: {r.clip: (r.torque_frac_rated and round(r.torque_frac_rated, 3), r.reason) for r in dynamics.torque_share(frames, robot, 0.1).collect()}
    assert said(read(whole)) == {1: (None, "too_few_frames:2<3"), 2: (round(100 * 9.81 * math.cos(0.1) / 10, 3), None)}
    assert said(read(whole.replace('effort="10"', ""))) == dict.fromkeys((1, 2), (None, "missing_input:effort_limits:arm:a"))
    assert said(read(whole.replace('value="2"', 'value="0"'))) == dict.fromkeys((1, 2), (None, "missing_input:inertial:arm:rod"))
    assert said(read(whole, body.Spec("pendulum", ("a",), ("rod",)))) == dict.fromkeys((1, 2), (None, "unsupported_robot:pendulum"))


@pytest.mark.parametrize("size", [5, 8, 64])
def test_blocks_change_nothing(spark, monkeypatch, size):
    frames = plans.frames(spark, "/root/testdata/sf0.001")
    robot = plans.arm(spark)
    out = []
    for n in (4096, size):
        monkeypatch.setattr(blocks.blocked, "__defaults__", (n,))
        torque = {(r.clip, r.t, r.joint): r.tau for r in dynamics.torques(dynamics.prepared(frames, robot, 1.0), robot, 0.1).where("inner").collect()}
        angular = {r.clip: (r.n_frames, r.mean_angacc_radps2) for r in metrics.angular_3d(kinematics.keypoints(frames, robot), 6, 0.1).collect()}
        out.append((torque, angular))
    assert out[0][0].keys() == out[1][0].keys() and all(abs(v - out[1][0][k]) < 1e-9 for k, v in out[0][0].items())
    assert all(a[0] == out[1][1][c][0] and abs(a[1] - out[1][1][c][1]) < 1e-9 for c, a in out[0][1].items())


def test_empty_frames(spark):
    frames, robot = spark.createDataFrame([], FRAME), plans.arm(spark)
    assert kinematics.link_poses(frames, robot).count() == 0 and dynamics.torque_share(frames, robot, 0.1).count() == 0 and kinematics.balance_margin(frames, robot).count() == 0


def test_files_are_parsed_once_and_depths_end_with_the_levels(spark):
    robots = description.parsed(files(spark))
    assert "xml" not in description.problems(robots)._jdf.queryExecution().optimizedPlan().toString().lower()
    chain = [("r", k, "revolute", f"l{k}", f"l{k + 1}") for k in range(30)] + [("r", 30, "fixed", "l2", "side"), ("r", 31, "revolute", "l9", "side"), ("r", 32, "revolute", "x", "y"), ("r", 33, "revolute", "y", "x")]
    got = {(r.link, r.depth) for r in description.depths(spark.createDataFrame(chain, "robot string, at int, kind string, parent string, child string")).collect()}
    assert got == {(f"l{k}", k) for k in range(31)} | {("side", 2)}
