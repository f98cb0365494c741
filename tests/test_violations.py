"""Reports of collision and bend angles against numpy."""

import numpy as np
import pandas as pd
from strider.operators import violations
from strider.plans import queries


def check(got, frames, score, threshold, higher):
    got = got.toPandas().set_index("clip")
    for clip, g in frames.groupby("clip"):
        s = g.sort_values("t")[score].to_numpy()
        flag = s > threshold if higher else s < threshold
        ratio = s / threshold if higher else threshold / np.maximum(s, 1e-9)
        assert got.loc[clip, "n_flagged"] == flag.sum() and got.loc[clip, "runs"] == (np.diff(flag.astype(int), prepend=0) == 1).sum()
        np.testing.assert_allclose(got.loc[clip, ["severity_median", "severity_p90"]].astype(float), [np.median(ratio), np.percentile(ratio, 90)], atol=6e-4)


def test_collision_flags_the_closest_frames(spark):
    rng = np.random.default_rng(1)
    frames = pd.DataFrame({"clip": np.repeat([1, 2], 100), "t": np.tile(np.arange(1, 101), 2), "collision": rng.uniform(10, 300, 200)})
    table = spark.createDataFrame(frames)
    threshold = violations.thresholds(table, "collision", floor=500.0, higher_is_worse=False)
    np.testing.assert_allclose(threshold.first()[0], np.percentile(frames.collision, 5))
    check(violations.report(table, "collision", threshold, higher_is_worse=False), frames, "collision", np.percentile(frames.collision, 5), False)


def test_bend_angles_are_calibrated(spark):
    rng = np.random.default_rng(2)
    angles = pd.DataFrame({"clip": np.repeat([1, 2], 400), "t": np.tile(np.repeat(np.arange(1, 201), 2), 2), "joint": np.tile([0, 1], 400), "angle": rng.normal(90, 20, 800)})
    lo, hi = angles.groupby("joint").angle.quantile(0.01), angles.groupby("joint").angle.quantile(0.99)
    over = np.maximum(angles.angle - angles.joint.map(hi), 0) + np.maximum(angles.joint.map(lo) - angles.angle, 0)
    frames = angles.assign(bend=over).groupby(["clip", "t"], as_index=False).bend.max()
    table = violations.bend_excess(spark.createDataFrame(angles))
    threshold = violations.thresholds(table, "bend", floor=2.0)
    check(violations.report(table, "bend", threshold), frames, "bend", max(2.0, np.percentile(frames.bend, 95)), True)


def test_reports_are_registered(spark):
    for name in ("violations_collision", "violations_bend"):
        got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
        assert len(got) and got.n_flagged.sum() > 0
