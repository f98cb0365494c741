"""Traces on files, their alignment, and torque of an arm at rest."""

import math

import pytest
from pyspark.sql import functions as F

from strider.operators import feasibility, traces


def test_first_frame(spark):
    rows = [(10, 10, "same_length", 0), (10, 9, "same_length", None), (10, 7, "front", 3), (10, 8, "interior", 1), (10, 7, "interior", None), (3, 5, "front", None), (5, 5, "other", None)]
    table = spark.createDataFrame(rows, "n int, l int, a string, want int")
    assert all(r.got == r.want for r in table.withColumn("got", traces.first_frame(F.col("n"), F.col("l"), F.col("a"))).collect())


def test_store(spark, tmp_path):
    frames = spark.createDataFrame([("c", t, None if t < 3 else float(t), float(-t)) for t in range(1, 9)], "clip_id string, t int, jerk double, step double")
    uri = f"file://{tmp_path}/traces"
    own = traces.traces(frames, ["jerk", "step"])
    traces.append(own.where("metric = 'step'"), uri)
    rest = traces.missing(own, traces.read(spark, uri))
    assert [r.metric for r in rest.collect()] == ["jerk"]
    traces.append(rest, uri)
    got = traces.unfolded(traces.read(spark, uri)).where("metric = 'jerk'").orderBy("frame").collect()
    assert [(r.frame, r.value) for r in got] == [(t - 1, float(t)) for t in range(3, 9)]


def test_arm_at_rest_holds_its_weight(spark):
    joints = spark.createDataFrame([("c", t, [0.0, math.pi / 2]) for t in range(1, 8)], "clip string, t int, q array<double>")
    got = feasibility.planar_torques(feasibility.smoothed(joints), 0.1, [0.4, 0.3], [2.0, 1.0]).orderBy("t").collect()
    assert [r.t for r in got] == list(range(2, 7))
    for r in got:
        assert r.tau == pytest.approx([9.81 * (2.0 * 0.2 + 1.0 * 0.4), 0.0], abs=1e-9)
    peak = feasibility.peak_share(spark.createDataFrame([("c", i, [float(i), -2.0 * i]) for i in range(101)], "clip string, t int, tau array<double>"), [1.0, 4.0])
    assert peak.first().torque_frac_rated == pytest.approx(9800)


def test_bodies_that_touch(spark):
    p = [0.0, 0, 0, 9, 9, 9, 0.1, 0, 0, 0.1, 0, 0]
    far = [0.0, 0, 0, 9, 9, 9, 5.0, 0, 0, 5.0, 0, 0]
    rows = spark.createDataFrame([("c", 1, [float(v) for v in p]), ("c", 2, [float(v) for v in far])], "clip string, t int, p array<double>")
    depth = [r.depth for r in feasibility.penetration(rows, [[2, 3]], {0: 0.2}).orderBy("t").collect()]
    assert depth == pytest.approx([0.05 + 0.2 - 0.1, 0.0])
    said = feasibility.collisions(feasibility.penetration(rows, [[2, 3]], {0: 0.2})).first()
    assert (said.penetration_mm, said.self_collision_frac) == pytest.approx((75.0, 0.5))
    assert feasibility.balance(rows, {2: 1.0}, [0, 3], 0.1).where("clip = 'c'").first().com_margin_m == pytest.approx((0.0 + 0.1 + 0.1) / 2 + 0.0, abs=0.2)
