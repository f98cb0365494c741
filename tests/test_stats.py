"""Paired tests against the plain form of the reference's bootstrap."""

import inspect
import itertools
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from strider.operators import order, stats


def plain(d, draws=10_000, seed=0):
    boot = np.median(d[np.random.default_rng(seed).integers(0, len(d), (draws, len(d)))], axis=1)
    norm = NormalDist()
    z0 = norm.inv_cdf(min(max((boot < np.median(d)).mean(), 1 / (draws + 1)), 1 - 1 / (draws + 1)))
    left = np.array([np.median(np.delete(d, i)) for i in range(len(d))])
    den = 6 * ((left.mean() - left) ** 2).sum() ** 1.5
    a = ((left.mean() - left) ** 3).sum() / den if den else 0.0
    return np.percentile(boot, [100 * norm.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (norm.inv_cdf(0.025), norm.inv_cdf(0.975))])


def test_intervals_are_the_references():
    assert inspect.signature(stats.tests).parameters["draws"].default == 10_000
    rng = np.random.default_rng(1)
    for d in (rng.standard_normal(1001), rng.exponential(1, 500), np.array([1.0, 2, 2, 2, 2, 2, 9]), np.array([1.0, 3])):
        np.testing.assert_allclose(stats.bootstrap_ci(d), plain(d), rtol=1e-9)


def test_many_deltas_of_a_method(spark):
    rng = np.random.default_rng(2)
    d = {"odd": np.round(rng.standard_normal(1001) + 0.05, 2), "even": rng.exponential(1, 1000) - 0.7}
    rows = pd.DataFrame([(m, f"e{i:05d}", float(x)) for m, v in d.items() for i, x in enumerate(v)], columns=["method", "episode", "delta"])
    table = spark.createDataFrame(rows)
    one = stats.tests(table).toPandas().set_index("method")
    two = stats.tests(table, whole=100).toPandas().set_index("method")
    for m, v in d.items():
        np.testing.assert_allclose(two.loc[m, ["n", "median", "p", "r"]].astype(float), one.loc[m, ["n", "median", "p", "r"]].astype(float), rtol=1e-9)
        np.testing.assert_allclose(one.loc[m, ["lo", "hi"]].astype(float), plain(v), rtol=1e-9)
        np.testing.assert_allclose(two.loc[m, ["lo", "hi"]].astype(float), plain(v), atol=0.02)


def test_small_samples_are_exact():
    rng = np.random.default_rng(5)
    for n in (1, 4, 9):
        d = rng.permutation(np.arange(1, n + 1)) * rng.choice([-1, 1], n) + 0.0
        sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=n)]
        low = min(np.abs(d)[d > 0].sum(), np.abs(d)[d < 0].sum())
        assert np.isclose(stats.wilcoxon(d)[0], min(1.0, 2 * np.mean(np.array(sums) <= low)))
    for m, n in ((1, 3), (3, 4), (5, 2)):
        x = rng.permutation(m + n).astype(float)
        u = lambda a, b: sum(i > j for i in a for j in b)
        all_u = [u(c, [v for v in range(m + n) if v not in c]) for c in itertools.combinations(range(m + n), m)]
        own = max(u(x[:m], x[m:]), u(x[m:], x[:m]))
        assert np.isclose(stats.mann_whitney(x[:m], x[m:]), min(1.0, 2 * np.mean(np.array(all_u) >= own)))


def test_mixed_suites_are_refused(spark):
    rows = [("m", f"e{i}", r, float(i), f"s{i % 2}") for i in range(6) for r in ("gt", "pred")]
    table = spark.createDataFrame(rows, "method string, episode string, role string, value double, suite_id string")
    with pytest.raises(ValueError, match="several suites"):
        stats.aggregate(table)
    assert "s0, s1" in stats.aggregate(table, allow_mixed_suites=True, draws=50).first()["warning"]


def test_percentiles_and_running_sums(spark):
    rng = np.random.default_rng(6)
    values = np.round(np.concatenate([rng.normal(0, 1, 30_000), np.full(10_000, 0.25)]), 4)
    group = np.where(np.arange(len(values)) % 3 == 0, "a", "b")
    table = spark.createDataFrame(pd.DataFrame({"g": group, "v": values, "one": 1}))
    got = order.percentiles(table, ["g"], "v", [0.0, 0.05, 0.5, 0.999, 1.0]).toPandas()
    for r in got.itertuples():
        assert np.isclose(r.q, np.quantile(values[group == r.g], r.p)) and r.n == (group == r.g).sum()
    assert order.percentile(table.limit(0), [], "v", 0.5, "q").first()["q"] is None
    sums = order.running_sums(table, ["g"], ["v"], {"before": "one"}).toPandas()
    for _, g in sums.groupby("g"):
        assert sorted(g.before) == list(range(len(g))) and g.sort_values("before").v.is_monotonic_increasing


@pytest.mark.parametrize("n", [1, 2, 3, 40, 41, 999, 30_001])
def test_percentiles_of_groups_of_any_size(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.standard_normal(n), 2)
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(2, float("nan")), (2, None), (2, 5.0)], "g int, v double").repartition(7)
    probs = [0.0, 0.02, 0.05, 0.5, 0.9, 0.95, 0.98, 0.999, 1.0]
    got = {(r.g, r.p): r.q for r in order.percentiles(df, ["g"], "v", probs).collect()}
    assert all(abs(got[1, p] - np.quantile(values, p)) < 1e-12 and got[2, p] == 5.0 for p in probs)
