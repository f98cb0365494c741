"""Noise floors, reports and rankings, small cases."""

import html
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strider.operators import noise, report


def test_settings(spark):
    df = spark.createDataFrame([("episode_0012",), ("x",), (None,), ("a13b99",), ("9" * 30,), ("9" * 60,)], "e string")
    assert [r.s for r in df.select(noise.setting(F.col("e")).alias("s")).collect()] == [23, 23, 23, 24, 23 + int("9" * 30) % 12, 23]


def measured(spark, rows, second=False):
    return spark.createDataFrame(rows, f"path string, {'setting int' if second else 'episode string'}, values map<string, double>")


def test_pairs_keep_every_clip_and_metric(spark):
    first = measured(spark, [("a", "e1", {"m": 1.0, "k": math.inf}), ("b", "e2", {"m": 2.0}), ("c", "e3", None)])
    again = measured(spark, [("a", 24, {"m": 1.5, "k": 1.0}), ("a", 24, {"m": 1.25}), ("b", 24, {"m": 9.0}), ("b", 25, {"m": math.nan})], second=True)
    got = {(r.path, r.metric): (r.setting, r.delta) for r in noise.pairs(first, again, ("m", "k")).collect()}
    assert got == {("a", "m"): (24, 0.25), ("a", "k"): (24, None), ("b", "m"): (25, None), ("b", "k"): (25, None), ("c", "m"): (26, None), ("c", "k"): (26, None)}
    left = noise.unmeasured(first.drop("values"), again)
    assert [(r.path, r.setting) for r in left.collect()] == [("c", 26)]


def test_floors_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = {"m": rng.normal(size=501), "k": rng.exponential(size=40), "none": []}
    rows = [(m, float(v)) for m, vs in values.items() for v in vs] + [("none", None), ("m", None)]
    got = {r.metric: r for r in noise.floors(spark.createDataFrame(rows, "metric string, delta double")).collect()}
    for m in ("m", "k"):
        v, r = np.asarray(values[m]), got[m]
        want = (len(v), v.mean(), np.median(v), v.std(), np.percentile(np.abs(v), 95), np.median(np.abs(v)))
        assert np.allclose((r.n, r.null_mean, r.null_median, r.null_std, r.null_p95, r.null_abs_median), want, rtol=1e-12)
    assert got["none"].n == 0 and got["none"].null_p95 is None
    assert noise.floors(spark.createDataFrame([], "metric string, delta double")).count() == 0


def test_below_a_floor(spark):
    df = spark.createDataFrame([(2.0, 1.0), (-1.0, 1.0), (0.5, 1.0), (1.0, 0.0), (1.0, None), (None, 1.0), (math.nan, 1.0), (1.0, math.inf)], "d double, f double")
    assert [r.b for r in df.select(noise.below(F.col("d"), F.col("f")).alias("b")).collect()] == [False, False, True, True, True, True, True, True]


def test_shortest_numbers_are_those_of_python(spark):
    rng = np.random.default_rng(5)
    values = [0.0, 1.0, -1.0, 10.0, 9999.6, 12345.678, 1e-4, 9.9996e-5, 1e-5, 0.1, 1e22, 1e100, -1e-100, 123.4, 100.0, 0.09999999, *(float(x) for x in rng.normal(size=300) * 10.0 ** rng.integers(-8, 9, 300))]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (4, 6):
        got = [r.s for r in df.select(report.shortest(F.col("x"), digits).alias("s")).collect()]
        assert got == [f"{x:.{digits}g}" for x in values]
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (-math.inf,)], "x double")
    assert [r.s for r in odd.select(report.shortest(F.col("x")).alias("s")).collect()] == ["-", "NaN", "inf", "-inf"]


def tables(spark):
    separation = spark.createDataFrame([("a", "m", "u", 7, True, 0.5, None, True, None), ("b", "k", "u", 2, False, None, None, None, "too_few_episodes:2<5")], "method string, metric string, units string, n int, rate_comparable boolean, separation double, verdict string, above_noise boolean, reason string")
    ranks = spark.createDataFrame([("b", 1.5, 2, {"y": 1, "x": 2}, {"x": -0.25, "y": 3.0}), ("a", None, 0, None, None)], "method string, mean_rank double, n_axes int, axis_ranks map<string, int>, extra_cost map<string, double>")
    return separation, ranks


def written(lines, path):
    report.write(lines, str(path))
    return "".join(p.read_text() for p in sorted(path.glob("*.txt"))).split("\n")


def test_markdown(spark, tmp_path):
    separation, ranks = tables(spark)
    text = written(report.markdown(spark, None, separation, ranks, "v1"), tmp_path / "report.md")
    assert text[:3] == ["# Report", "", "v1"]
    rows = [t for t in text if t.startswith("| a") or t.startswith("| b")]
    assert rows == [
        "| a | m | u | 7 | - | - | - | - | - | - | - | - | - | 0.5 | - | - | True |  |  |",
        "| b | k | u | 2 | - | - | - | - | - | - | - | - | - | - | - | - | - | not comparable across frame rates | too_few_episodes:2<5 |",
        "| a | - | 0 | - | - |", "| b | 1.5 | 2 | x=2, y=1 | x=-0.25, y=+3 |",
    ]
    assert all(t.count("|") == rows[0].count("|") for t in text if t.startswith("| method | metric | units"))


def test_html_is_escaped(spark, tmp_path):
    summary = spark.createDataFrame([("<a>&'\"", "m", 3, 0.5, None)], "method string, metric string, n int, median double, warning string")
    text = "".join(written(report.html(spark, summary, about="<x>"), tmp_path / "report.html"))
    assert f"<td>{html.escape('<a>&' + chr(39) + chr(34))}</td>" in text and "&lt;x&gt;" in text and "<x>" not in text
    assert text.count("no rows") == 2 and text.count("<table>") == text.count("</table>") == 3 and text.endswith("</body></html>")


def test_ranks_and_their_forms(spark):
    scores = spark.createDataFrame([("b", "e1", "gt", 1.0), ("b", "e1", "pred", 3.0), ("a", "e1", "gt", 1.0), ("a", "e1", "pred", math.nan), ("a", "e2", "gt", None), ("c", "e,1", "gt", 5.0), ("c", "e,1", "pred", 5.5)], "method string, episode string, role string, value double")
    rows = report.ranked(report.unpaired(scores), "value", "lower_better")
    assert [(r.rank, r.method, r.role) for r in rows.orderBy("rank").collect()] == [(1, "c", "pred"), (2, "c", "gt"), (3, "b", "pred"), (4, "a", "gt"), (5, "b", "gt")]
    assert [r.method for r in report.ranked(report.unpaired(scores, ["a", "b"]), "value", "higher_better", top=2).orderBy("rank").collect()] == ["a", "b"]
    pairs = report.ranked(report.paired(scores), "delta", "lower_better")
    columns = ["rank", "method", "episode", "delta"]
    said = lambda form: [r.text for r in report.rendered(pairs, columns, form).orderBy("rank").collect()]
    assert set(said("table")) == {"rank  method  episode  delta", "----  ------  -------  -----", "1     b       e1       2    ", "2     c       e,1      0.5  "}
    assert said("csv") == ["rank,method,episode,delta", "1,b,e1,2.0", '2,c,"e,1",0.5']
    assert said("json") == ['{"rank":1,"method":"b","episode":"e1","delta":2.0}', '{"rank":2,"method":"c","episode":"e,1","delta":0.5}']
    assert [r.text for r in report.rendered(pairs.limit(0), columns).collect()] == ["rank  method  episode  delta", "----  ------  -------  -----"]
    with pytest.raises(ValueError):
        report.rendered(pairs, columns, "xml")


def test_floors_read_their_deltas_once(spark):
    rows = spark.createDataFrame([("a", float(k)) for k in range(5)], "metric string, d double").select("metric", (F.col("d") - 12345.0).alias("delta"))
    got = noise.floors(rows)
    assert "12345.0" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.n, r.null_median, r.null_abs_median) for r in got.collect()] == [(5, -12343.0, 12343.0)]
