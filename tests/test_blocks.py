"""Clips cut into small blocks have the results of whole clips; intervals and profiles against numpy."""

import numpy as np
import pytest

from strider.operators import blocks, feasibility, metrics, order, violations

DT = 0.1


@pytest.fixture
def small(monkeypatch):
    whole = blocks.blocked
    return lambda: monkeypatch.setattr(blocks, "blocked", lambda frames, reach, size=0: whole(frames, reach, max(reach + 1, 5)))


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(11)
    rows = [(c, t, [float(x) for x in rng.normal(size=9)], [float(x) for x in rng.normal(size=2)]) for c, n in (("a", 33), ("b", 10), ("c", 1), (None, 12)) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "clip string, t int, p array<double>, q array<double>")


def flat(df):
    return {(r[0], r["t"] if "t" in df.columns else 0): [x for v in r[1:] for x in (v if isinstance(v, list) else [v])] for r in df.collect()}


@pytest.mark.parametrize("of", [
    lambda f: metrics.temporal(f, DT), lambda f: metrics.energy(f, DT), lambda f: metrics.joint_dynamics(f, DT, [1.0, 2.0], [3.0, 4.0]), lambda f: metrics.angular(metrics.arm_2r(f), DT),
    lambda f: metrics.log_dimensionless_jerk(f, 2, DT), lambda f: metrics.sparc(f, 1, DT), lambda f: violations.scores(f, [(0, 1), (1, 2)], 0.1), lambda f: feasibility.smoothed(f.select("clip", "t", "q"), 2.0),
    lambda f: feasibility.planar_torques(f, DT, [0.4, 0.3], [2.0, 1.0]),
], ids=["temporal", "energy", "joint_dynamics", "angular", "ldlj", "sparc", "scores", "smoothed", "torques"])
def test_blocks_change_nothing(frames, small, of):
    want = flat(of(frames))
    small()
    got = flat(of(frames))
    assert got.keys() == want.keys() and len(got)
    for k, values in want.items():
        assert len(values) == len(got[k])
        for a, b in zip(values, got[k], strict=True):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-9, abs=1e-12)


def test_intervals_over_borders_and_gaps(spark, small):
    small()
    flags = {"a": {3, 4, 5, 6, 7, 10, 20, 21}, "b": {1}, "c": set(), "d": set(range(1, 24))}
    rows = [(c, t, t in on) for c, on in flags.items() for t in range(1, 24) if not (c == "a" and t in (12, 13))] + [("g", 1, True), ("g", 3, True), ("g", 4, None)]
    found = {}
    for r in violations.intervals(spark.createDataFrame(rows, "clip string, t int, flag boolean")).collect():
        found.setdefault(r.clip, set()).add((r.first, r.last))
    assert found == {"a": {(3, 7), (10, 10), (20, 21)}, "b": {(1, 1)}, "d": {(1, 23)}, "g": {(1, 1), (3, 3)}}


def test_profiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=257), "b": np.array([4.0]), None: rng.integers(0, 3, 50).astype(float)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan")), ("z", None)]
    got = {r.k: r.profile for r in order.profiles(spark.createDataFrame(rows, "k string, value double"), ["k"], "value", 21).collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert np.allclose(got[k], np.quantile(v, np.linspace(0, 1, 21)), rtol=1e-12, atol=1e-12)
    assert order.profiles(spark.createDataFrame([], "k string, value double"), ["k"], "value", 3).count() == 0
