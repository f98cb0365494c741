"""Rates, reference distances and streams against closed forms."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strider.functions import series as S
from strider.operators import blocks, reference, resample
from strider.plans import motion
from strider.plans import queries as engine
from strider.sources import tables
from strider.streaming import detectors
from tests.test_oracle import DATA


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes of the monotone piecewise cubic through the rows of ``y`` (weighted harmonic means of the secants)."""
    h = np.diff(x)[:, None]
    s = np.diff(y, axis=0) / h
    if len(s) == 1:
        return np.vstack([s, s])
    out = np.zeros_like(y)
    a, b = s[:-1], s[1:]
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = a * b > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        out[1:-1] = np.where(same, (w1 + w2) / (w1 / a + w2 / b), 0.0)

    def end(h0, h1, s0, s1):
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        d = np.where(np.sign(d) != np.sign(s0), 0.0, d)
        return np.where((np.sign(s0) != np.sign(s1)) & (np.abs(d) > 3 * np.abs(s0)), 3 * s0, d)

    out[0], out[-1] = end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2])
    return out


def monotone_cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values at ``at`` of the monotone cubic through (x, rows of y); ``at`` lies within ``x``."""
    if len(x) == 1:
        return np.repeat(y, len(at), axis=0)
    d = monotone_slopes(x, y)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = (x[i + 1] - x[i])[:, None]
    u = (at - x[i])[:, None] / h
    return (
        y[i] * (1 + 2 * u) * (1 - u) ** 2 + d[i] * h * u * (1 - u) ** 2
        + y[i + 1] * u**2 * (3 - 2 * u) + d[i + 1] * h * u**2 * (u - 1)
    )


def test_rate_policy():
    assert resample.parse_rate_policy("paired").kind == "paired"
    assert resample.parse_rate_policy("resample:12.5").target_fps == 12.5
    for bad in ("", "resample", "resample:0", "resample:x", "paired:3"):
        with pytest.raises(ValueError):
            resample.parse_rate_policy(bad)


def test_monotone_cubic():
    x = np.arange(6) * 0.5
    line = np.stack([3 * x - 1, -x], axis=1)
    at = np.array([0, 0.3, 0.5, 1.77, 2.5])
    np.testing.assert_allclose(monotone_cubic(x, line, at), np.stack([3 * at - 1, -at], axis=1))
    step = np.array([0, 0, 0, 1, 1, 1.0])[:, None]
    fine = monotone_cubic(x, step, np.linspace(0, 2.5, 200))[:, 0]
    assert (np.diff(fine) >= -1e-12).all() and fine.min() >= 0 and fine.max() <= 1
    np.testing.assert_allclose(monotone_cubic(x, step, x), step)


def test_interpolate(spark):
    rows = [(c, t + 1, [2.0 * t, 5.0]) for c, n in ((1, 10), (2, 1)) for t in range(n)]
    got = resample.interpolate(spark.createDataFrame(rows, "clip long, t int, q array<double>"), 0.1, 0.25).orderBy("clip", "t").collect()
    assert [(r.clip, r.t) for r in got] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]
    np.testing.assert_allclose([r.q for r in got[:4]], [[5.0 * i, 5] for i in range(4)])


def test_frechet(spark):
    rows = motion.samples(spark, DATA).toPandas()
    f = rows.groupby(["clip", "quantity"])["value"].agg(mean="mean", std=lambda v: v.std(ddof=0)).unstack()
    f = f.reindex(columns=[(c, q) for q in motion.QUANTITIES for c in ("mean", "std")])
    a, b = (f[f.index % 2 == r].to_numpy() for r in (0, 1))
    wanted = reference.frechet(*(reference.Gaussian(x.mean(axis=0), np.cov(x.T), len(x)) for x in (a, b)))
    got = motion.frechet(spark, DATA).first()
    assert (got.n_reference, got.n) == (len(a), len(b)) and got.kfd == pytest.approx(wanted, rel=1e-6)
    one = reference.Gaussian(np.zeros(2), np.diag([4.0, 1]), 9)
    assert reference.frechet(one, reference.Gaussian(np.array([3.0, 0]), np.eye(2), 9)) == pytest.approx(10)


def test_invariance_without_values(spark):
    rows = spark.createDataFrame([(1, "a_mm", 1.0), (2, "a_mm", 2.0), (3, "a_mm", None), (3, "b_frac", 0.5)], "clip long, metric string, value double")
    ref = reference.baselines(rows)
    strict = {r.clip: r.score for r in reference.invariance(rows, ref).collect()}
    assert strict == {1: None, 2: None, 3: None}
    some = {r.clip: (r.n_terms, r.score) for r in reference.invariance(rows, ref, "available").collect()}
    assert some[1] == (1, 0) and some[3] == (1, 0) and some[2][1] == pytest.approx(0.5 / 3)
    assert reference.baselines(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        reference.same_rate(0.1, 0.2)


def test_stream_equals_table(spark, tmp_path):
    events = tables.table(spark, DATA, "events").select("ts", "event_type", "value")
    last = events.agg(F.max("ts")).first()[0]
    parts = [events.where(F.col("ts") <= F.lit(last) - F.expr("INTERVAL 10 DAYS")), events.where(F.col("ts") > F.lit(last) - F.expr("INTERVAL 10 DAYS"))]
    # A row far past the others closes all their windows.
    end = spark.createDataFrame([(None, "end", 0.0)], "ts timestamp, event_type string, value double").withColumn("ts", (F.lit(last) + F.expr("INTERVAL 90 DAYS")).cast(events.schema["ts"].dataType))
    for i, part in enumerate([*parts, end.select(*events.columns)]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = detectors.windowed(detectors.flagged(stream, motion.BOUND), delay="60 days")
    query = out.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    wanted = detectors.windowed(detectors.flagged(events, motion.BOUND))
    got = spark.table("windows").where("event_type <> 'end'")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("size", [5, 4096])
def test_interpolate_equals_the_cubic(spark, monkeypatch, size):
    monkeypatch.setattr(blocks.blocked, "__defaults__", (size,))
    rng = np.random.default_rng(7)
    clips = {c: rng.standard_normal((n, 2)).round(1).cumsum(axis=0) for c, n in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 23), (6, 40))}
    rows = [(c, t + 1, y[t].tolist(), float(y[t, 0])) for c, y in clips.items() for t in range(len(y))]
    df = spark.createDataFrame(rows, "clip long, t int, q array<double>, name double").repartition(5)
    for target in (0.13, 0.07, 0.25, 0.1):
        got = {}
        for r in resample.interpolate(df, 0.1, target).collect():
            got.setdefault(r.clip, {})[r.t] = r.q
        for c, y in clips.items():
            n = int(np.floor((len(y) - 1) * 0.1 / target + 1e-9)) + 1
            x = np.arange(len(y)) * 0.1
            want = monotone_cubic(x, y, np.minimum(np.arange(n) * target, x[-1]))
            assert sorted(got[c]) == list(range(1, n + 1))
            np.testing.assert_allclose([got[c][t] for t in range(1, n + 1)], want, atol=1e-9)


def test_interpolated_values_round_as_in_sql(spark, tmp_path):
    """Times of new frames are exact products, and values whose double ends in a five go where SQL's rounding takes them."""
    values = [0.0] * 24 + [563.06, 563.24, 563.0, 562.0]
    rows = [(e, 1, e, v, '{"k": %d}' % (e * 7 % 5)) for e, v in enumerate(values)] + [(100 + e, 2, e, (e * 37 % 101) / 10, '{"k": %d}' % (e * e % 11)) for e in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long, value double, props string")
    events.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", F.lit("x").alias("event_type"), "value", "props").toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours = motion.resample_interpolate(spark, str(tmp_path)).collect()
    theirs = con.execute(engine.oracle_sql()["resample_interpolate"]).fetchall()
    assert sorted(tuple(r) for r in ours) == sorted(theirs)


def test_resample_frames(spark):
    rows = [(1, t + 1, [2.0 * t, 1.0], float(t), f"frame {t}") for t in range(11)]
    df = spark.createDataFrame(rows, "clip long, t int, q array<double>, height double, note string")
    policy = resample.parse_rate_policy
    assert resample.resample_frames(df, 0.1, policy("paired")).columns == df.columns and resample.resample_frames(df, 0.1, policy("resample:10")).count() == 11
    half = resample.resample_frames(df, 0.1, policy("resample:5")).orderBy("t").collect()
    assert [r.note for r in half] == [f"frame {t}" for t in range(0, 11, 2)]
    new = resample.resample_frames(df, 0.1, policy("resample:8")).orderBy("t").collect()
    assert "note" not in new[0] and [r.t for r in new] == list(range(1, 10))
    np.testing.assert_allclose([(r.height, *r.q) for r in new], [(1.25 * k, 2.5 * k, 1.0) for k in range(9)])
    with pytest.raises(ValueError, match="does not add frames"):
        resample.resample_frames(df, 0.1, policy("resample:30"))
    more = resample.resample_frames(df, 0.1, policy("resample:20", allow_upsample=True))
    assert more.count() == 21 and [resample.looks_per_frame(k) for k in ("array<float>", "decimal(5,2)", "string", "array<string>")] == [True, True, False, False]


def test_shared_steps_are_worked_out_once(spark):
    flat = F.transform(F.col("p"), lambda x: x + 12345.0)
    df = spark.createDataFrame([([1.0, 2.0, 2.0, 0.0, 3.0, 4.0],), (None,)], "p array<double>")
    said = df.select(S.norms(flat).alias("n"), S.point_sum(flat).alias("s"))._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert said.count("12345.0") == 2
    assert [tuple(r) for r in df.select(S.norms(F.col("p"))).collect()] == [([3.0, 5.0],), (None,)]
    assert "Window" not in motion.terms(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
