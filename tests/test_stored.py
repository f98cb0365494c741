"""The stored reference in both forms, and configuration rules."""

import json

import numpy as np
import pytest

from strider.operators import fingerprint, reference, suites
from strider.sources import config

SUITE = suites.Suite("two", ("mean_speed_mps", "rigidity_residual_mm", "accel_violation_frac"), ("mean_speed_mps", "accel_violation_frac"))


@pytest.fixture(scope="module")
def real(spark):
    rng = np.random.default_rng(0)
    terms = spark.createDataFrame([(c, m, float(v)) for c in range(9) for m, v in zip(SUITE.keys, rng.uniform(1, 2, 3), strict=True)], "clip long, metric string, value double")
    samples = spark.createDataFrame([(c, q, float(v)) for c in range(9) for q in ("speed", "height") for v in rng.uniform(0, 1, 30)], "clip long, quantity string, value double")
    return terms, samples, fingerprint.build(terms, samples, SUITE, 0.1)


def test_round_trip(spark, real, tmp_path):
    terms, samples, ref = real
    fingerprint.save(spark, ref, str(tmp_path / "ref"))
    back = fingerprint.load(spark, str(tmp_path / "ref"))
    assert (back.dt, back.suite_id, back.terms, back.quantiles, back.quantity_keys) == (ref.dt, ref.suite_id, ref.terms, ref.quantiles, ("height", "speed"))
    np.testing.assert_array_equal(back.gaussian.cov, ref.gaussian.cov)
    assert list(back.terms) == list(SUITE.invariant) and back.gaussian.n == 9
    assert fingerprint.load(spark, str(tmp_path / "ref"), dt=0.1).dt == 0.1
    with pytest.raises(ValueError, match="not the one"):
        fingerprint.load(spark, str(tmp_path / "ref"), dt=0.2)
    assert fingerprint.kinematic_distance(samples, back) == pytest.approx(0, abs=1e-9)
    assert {r.w1 for r in fingerprint.distances(samples.where("clip = 1"), back, 0.1).collect()} == {r.w1 for r in reference.wasserstein(samples.where("clip = 1"), ref.profiles(spark)).collect()}
    fingerprint.rows(spark, ref).replace(2.0, 3.0, "value").write.parquet(str(tmp_path / "new"))
    with pytest.raises(ValueError, match="form 3"):
        fingerprint.load(spark, str(tmp_path / "new"))
    with pytest.raises(ValueError, match="no clip has a value for accel"):
        fingerprint.build(terms.where("metric <> 'accel_violation_frac'"), samples, SUITE, 0.1)


def test_older_form(spark, real, tmp_path):
    terms, _, ref = real
    old = {"inv_baseline": {k: b for k, (b, _) in ref.terms.items()} | {"rigidity_residual_mm": 1.5}, "quantiles": {k: list(v) for k, v in ref.quantiles.items()}, "feat_mu": [0.0] * 4, "feat_cov": np.eye(4).tolist(), "quantity_keys": ["speed"], "n_q": 100}
    path = str(tmp_path / "old.json")
    (tmp_path / "old.json").write_text(json.dumps(old))
    with pytest.raises(ValueError, match="tells no frame time"):
        fingerprint.load(spark, path)
    back = fingerprint.load(spark, path, dt=0.1)
    assert back.schema == 1 and back.suite_id == "legacy:v1" and back.terms["rigidity_residual_mm"] == (1.5, 0.5) and back.terms["mean_speed_mps"][1] == 1e-3
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError, match="missing"):
        fingerprint.load(spark, str(tmp_path / "bad.json"), dt=0.1)
    new, older = fingerprint.scores(terms, ref, 0.1), fingerprint.scores(terms, back, 0.1)
    fingerprint.assert_comparable(new, new)
    with pytest.raises(ValueError, match="different terms"):
        fingerprint.assert_comparable(new, older)
    own = {r.metric: r.value for r in terms.where("clip = 3").collect()}
    want = np.mean([min(max((own[k] - b) / (0.1 if k.endswith("_frac") else b * 2 + 1e-8), 0), 1) for k, b in old["inv_baseline"].items()])
    got = {r.clip: (r.n_terms, r.score) for r in fingerprint.older_scores(terms, back).collect()}
    assert got[3] == (3, pytest.approx(want)) and len(got) == 9


def test_rates_are_refused(spark, real):
    terms, samples, ref = real
    for call in (lambda: fingerprint.scores(terms, ref, 0.2), lambda: fingerprint.distances(samples, ref, 0.2), lambda: fingerprint.kinematic_distance(samples, ref, dt=0.2)):
        with pytest.raises(ValueError, match="does not match"):
            call()
    assert {r.rate_mismatch for r in fingerprint.scores(terms, ref, 0.2, allow_rate_mismatch=True).collect()} == {True}
    assert {r.rate_mismatch for r in fingerprint.scores(terms, ref, 0.1).collect()} == {False}
    with pytest.raises(ValueError, match="not positive"):
        fingerprint.build(terms, samples, SUITE, 0.0)


def test_rules(spark):
    keys = ("generator", "robot", "horizon")
    assert config.rules(16, keys, (int, float), "fps") == [(None, None, None, 16)]
    rows = config.rules({"a": {"r": {"h": 1, "default": 2}, "default": 3}, "b": 4}, keys, (int, float), "fps", "default")
    assert set(rows) == {("a", "r", "h", 1), ("a", "r", None, 2), ("a", None, None, 3), ("b", None, None, 4)}
    cells = spark.createDataFrame([(g, r, h, False) for g in "abc" for r in "rs" for h in "hi"] + [("c", "x", None, True)], "generator string, robot string, horizon string, na boolean")
    done = config.resolved(cells, config.rule_table(spark, rows, keys, "double"), keys, "fps")
    got = {(r.generator, r.robot, r.horizon): r.fps for r in done.collect()}
    assert len(got) == 13 and got["a", "r", "h"] == 1 and got["a", "r", "i"] == 2 and got["a", "s", "h"] == 3 and got["b", "s", "i"] == 4 and got["c", "r", "h"] is None
    assert {r.generator for r in config.unresolved(done, "fps").collect()} == {"c"} and config.unresolved(done, "fps").count() == 4
    assert config.rules(None, keys, str, "iter") == []
    for bad, said in (([1], "no value"), (True, "no value"), (-1, "no value"), ({}, "empty"), ({"a": None}, "fps.a"), ({"a": {"b": {"c": {"d": 1}}}}, "no further level"), ({"a": ["x", "y"]}, "fps.a")):
        with pytest.raises(ValueError, match=said):
            config.rules(bad, keys, (int, float), "fps")


def test_environment_and_embodiments(spark):
    assert config.expand_env({"a": ["${X}/b", 3, None], "c": "$X"}, {"X": "/data"}) == {"a": ["/data/b", 3, None], "c": "$X"}
    with pytest.raises(KeyError, match="Y is not set"):
        config.expand_env("${Y}", {})
    claims = spark.createDataFrame([("r", "arm", "a"), ("r", "arm", "b")], "robot string, embodiment string, generator string")
    cells = spark.createDataFrame([("r", "a"), ("r", "c"), ("s", "a")], "robot string, generator string")
    assert {(r.robot, r.generator): (r.embodiment, r.claimed) for r in config.embodiments(cells, claims).collect()} == {("r", "a"): ("arm", True), ("r", "c"): ("arm", False), ("s", "a"): (None, False)}
