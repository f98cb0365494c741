"""Suites and registries: one pass equals the metrics apart, reasons, identities, frames."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from strider.operators import blocks, feasibility, metrics, suites
from strider.operators.metrics import MetricSpec
from strider.operators.registry import Registry
from strider.plans import robots as robot_plans
from strider.plans import suites as plans
from strider.robots import body, dynamics, kinematics

DATA = "/root/testdata/sf0.001"


def test_registry():
    r = Registry("thing")
    assert r.register("b", 1) == 1 and r.register("a", 2) == 2
    assert r.available() == ["a", "b"] and list(r) == ["b", "a"] and "a" in r and r.get("a") == 2
    with pytest.raises(ValueError, match="there already"):
        r.register("a", 3)
    with pytest.raises(KeyError, match="there are a, b"):
        r.get("c")


def test_specs_and_suites_are_checked():
    for bad in ({"key": "a b"}, {"requires": ("Z",)}, {"min_frames": 0}, {"unobservable_when": ("squashed",)}):
        with pytest.raises(ValueError):
            MetricSpec(**({"key": "k", "units": "m", "dt_exponent": 0, "requires": ("P",), "min_frames": 1} | bad))
    for keys, invariant in ((("sparc", "sparc"), None), (("sparc",), ("mean_speed_mps",))):
        with pytest.raises(ValueError):
            suites.Suite("s", keys, invariant)
    with pytest.raises(KeyError):
        suites.Suite("s", ("nothing",))
    with pytest.raises(ValueError):
        suites.Context(0.0)
    assert suites.SUITES.available() == ["all_metrics", "invariant_v1", "rate_free"]
    whole, free = suites.SUITES.get("all_metrics"), suites.SUITES.get("rate_free")
    assert len(suites.SUITES.get("invariant_v1").keys) == 26 and len(whole.keys) == 28 and whole.quantity_keys == ("no_teleport_frac", "torque_frac_rated", "rigidity_worst_bone_mm")
    assert all(d["dt_exponent"] == 0 and not d["in_invariant"] for d in free.describe()) and free.spec_of("com_margin_m").direction == "higher_better"
    with pytest.raises(KeyError):
        free.spec_of("mean_speed_mps")
    a, b = suites.Suite("s", ("sparc", "mean_speed_mps")), suites.Suite("s", ("mean_speed_mps", "sparc"))
    assert a.suite_id != b.suite_id and a.suite_id != suites.Suite("s", a.keys, ("sparc",)).suite_id and a.suite_id == metrics.suite_id("s", list(a.keys), list(a.keys))


@pytest.fixture(scope="module")
def arm(spark):
    robot = robot_plans.arm(spark)
    frames = plans.arm_frames(spark, DATA).where("t <= 30").cache()
    return robot, frames, suites.Context.of(spark, robot, 0.1)


def test_one_pass_equals_metrics_apart(spark, arm, monkeypatch):
    robot, frames, context = arm
    monkeypatch.setattr(blocks.blocked, "__defaults__", (11,))
    rows = suites.evaluate(frames, [suites.SUITES.get("all_metrics")], context)
    got = {r.clip: r.asDict() for r in suites.scalars(rows, suites.SUITES.get("all_metrics")).collect()}
    assert set(got[0]) == {"clip", *suites.SUITES.get("all_metrics").keys} and suites.reasons(rows).count() == 0
    bones = [(i, j) for i, j, _ in context.bones]
    apart = [
        metrics.temporal(frames, 0.1), metrics.energy(frames, 0.1), metrics.rigidity(frames, bones, [b[2] for b in context.bones]), metrics.joint_limits(frames, robot.limits), metrics.joint_dynamics(frames, 0.1, robot.speed_limits, robot.effort_limits),
        metrics.angular_3d(frames, 6, 0.1), metrics.log_dimensionless_jerk(frames, 3, 0.1), metrics.sparc(frames, 3, 0.1), kinematics.balance_margin(frames, robot), dynamics.torque_share(frames, robot, 0.1), feasibility.collisions(suites.depths(frames, robot)),
    ]
    seen = set()
    for table in apart:
        for r in table.collect():
            for k, v in r.asDict().items():
                if k in got[r.clip] and k != "clip":
                    assert got[r.clip][k] == pytest.approx(v, abs=1e-9), k
                    seen.add(k)
    assert seen == set(suites.SUITES.get("all_metrics").keys)


def test_penetration_against_a_loop(spark, arm):
    robot, frames, _ = arm
    rows = {(r.clip, r.t): r.depth for r in suites.depths(frames.where("t <= 3"), robot).collect()}
    balls = [((0, 0, z), 0.18) for z in (0, 0.25, 0.5)]
    for r in frames.where("t <= 3").select("clip", "t", "p").collect():
        p = [r.p[3 * k : 3 * k + 3] for k in range(6)]
        chain = [[a + (b - a) * s / 3 for a, b in zip(p[i], p[i + 1], strict=True)] for i in range(1, 5) for s in range(3)] + [p[5]]
        gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
        assert rows[r.clip, r.t] >= max(0.0, *[0.05 + rad - gap(c, at) for c in chain for at, rad in balls]) - 1e-12


def test_each_reason(spark, arm):
    robot, frames, context = arm
    said = lambda f, c, *keys: {(r.clip, r.metric): r.reason for r in suites.evaluate(f, [suites.Suite("s", keys)], c).collect()}
    short = frames.where("t <= 2 and clip = 0")
    got = said(short, context, "mean_speed_mps", "mean_jerk_mps3", "sparc", "torque_frac_rated", "kinetic_energy_tstd")
    assert got == {(0, "mean_speed_mps"): None, (0, "mean_jerk_mps3"): "too_few_frames:2<4", (0, "sparc"): "too_few_frames:2<8", (0, "torque_frac_rated"): "too_few_frames:2<3", (0, "kinetic_energy_tstd"): "too_few_frames:2<3"}
    assert said(short.drop("q", "r"), context, "mean_qdot_radps", "mean_angvel_radps") == {(0, "mean_qdot_radps"): "missing_input:q", (0, "mean_angvel_radps"): "missing_input:R"}
    table = body.Robot(dataclasses.replace(robot.spec, body=(), feet=(), chains=()), {k: dataclasses.replace(j, effort=None) for k, j in robot.joints.items()}, robot.links)
    bare = dataclasses.replace(context, robot=table)
    assert said(frames.where("clip = 0"), bare, "effort_proxy", "penetration_mm", "com_margin_m", "torque_frac_rated") == {
        (0, "effort_proxy"): "missing_input:effort_limits", (0, "penetration_mm"): "missing_input:colliders", (0, "com_margin_m"): "missing_input:support_polygon", (0, "torque_frac_rated"): "unsupported_robot:column_arm"
    }
    nobody = suites.Context(0.1)
    assert said(frames.where("clip = 0"), nobody, "rigidity_residual_mm", "limit_headroom_rad") == {(0, "rigidity_residual_mm"): "missing_input:robot", (0, "limit_headroom_rad"): "missing_input:robot"}
    still = frames.where("clip = 0").withColumn("p", F.array(*[F.lit(0.5)] * 18))
    assert said(still, context, "log_dimensionless_jerk", "sparc", "mean_speed_mps") == {(0, "log_dimensionless_jerk"): "degenerate_input:non_finite_result", (0, "sparc"): "degenerate_input:non_finite_result", (0, "mean_speed_mps"): None}
    spec = dataclasses.replace(metrics.SPECS["limit_excess_rad"], key="squashed_excess", unobservable_when=("limit_semantics=squashed",))
    assert suites.reasons_before(spec, dataclasses.replace(context, flags={"limit_semantics": "squashed"}), ["q_raw"]) == "unobservable:limit_semantics=squashed"
    assert suites.reasons_before(spec, context, ["q_raw"]) is None


def test_frames_of_metrics(spark, arm):
    robot, frames, context = arm
    suite = suites.SUITES.get("all_metrics")
    rows = suites.perframe(frames, suite, context)
    values = {r.clip: r.asDict() for r in suites.scalars(suites.evaluate(frames, [suite], context), suite).collect()}
    means = {(r.clip, r.metric): (r.n, r.v, r.first) for r in rows.groupBy("clip", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.min("t").alias("first")).collect()}
    for clip in values:
        n, v, first = means[clip, "no_teleport_frac"]
        assert (n, first) == (29, 2) and v == pytest.approx(values[clip]["no_teleport_frac"])
        n, v, first = means[clip, "rigidity_worst_bone_mm"]
        assert (n, first) == (30, 1) and v == pytest.approx(values[clip]["rigidity_worst_bone_mm"])
        assert means[clip, "torque_frac_rated"][0] == 28 and means[clip, "torque_frac_rated"][2] == 2
    assert suites.perframe(frames, suites.SUITES.get("rate_free"), context).count() == 0


def test_two_suites_scan_the_frames_once(spark):
    rows = suites.evaluate(plans.short_clips(spark, DATA), [suites.SUITES.get("invariant_v1"), suites.SUITES.get("rate_free")], suites.Context(0.1))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and rows.limit(0).count() == 0


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "clip long, t long, p array<double>")
    assert suites.evaluate(empty, [suites.SUITES.get("invariant_v1")], suites.Context(0.1)).count() == 0
