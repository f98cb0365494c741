"""Queries of rates, the reference of real motion and event windows over the shared tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.functions import series as S
from strider.operators import blocks, feasibility, metrics, reference, resample, traces
from strider.sources import tables
from strider.sources.shared import stored
from strider.streaming import detectors

DT, BOUND, QUANTITIES = 0.1, 90.0, ["height", "speed"]


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def resample_plan(spark: SparkSession, d: str) -> DataFrame:
    """How each user's clip, at 5 to 30 frames a second, comes to 10."""
    clips = tables.table(spark, d, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("n"))
    fps = (F.col("clip") % 6 + 1) * F.lit(5.0)
    return clips.withColumn("fps", fps).withColumn("plan", resample.plan(F.col("fps"), 10.0)).select("clip", "n", "fps", "plan.action", "plan.factor")


def resample_decimate(spark: SparkSession, d: str) -> DataFrame:
    rows = resample.decimate(tables.joints(spark, d), 3)
    return _rounded(rows.select("clip", "t", F.get("q", F.lit(0)).alias("a"), F.get("q", F.lit(1)).alias("b")))


def resample_interpolate(spark: SparkSession, d: str) -> DataFrame:
    rows = resample.interpolate(tables.joints(spark, d), DT, 0.13)
    # Values between frames often end in a five: round as SQL does, the scaled double and not its digits.
    at = lambda j, name: (F.round(F.get("q", F.lit(j)) * 1e5) / 1e5).alias(name)
    return rows.select("clip", "t", at(0, "a"), at(1, "b"))


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(clip, metric, value) of the temporal metrics, worked out once: baselines and scores read them several times."""
    return stored(metrics.with_reason(metrics.temporal(tables.keypoints(spark, d), DT)).select("clip", "metric", "value"), "terms")


def baselines(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reference.baselines(terms(spark, d)))


def invariance(spark: SparkSession, d: str) -> DataFrame:
    own = terms(spark, d)
    return _rounded(reference.invariance(own, reference.baselines(own)))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(clip, quantity, value): speed of each point between frames, height of the points in each."""
    kp = tables.keypoints(spark, d)
    moved = blocks.blocked(kp, 1).select("clip", "own", S.difference("p", 1, blocks.window(), DT).alias("v")).where("own")
    speed = moved.select("clip", F.explode(S.norms(F.col("v"))).alias("value"))
    height = kp.select("clip", F.get(S.point_sum(F.col("p")), F.lit(2)).alias("value"))
    return speed.select("clip", F.lit("speed").alias("quantity"), "value").unionByName(height.select("clip", F.lit("height").alias("quantity"), "value"))


def wasserstein(spark: SparkSession, d: str) -> DataFrame:
    own = samples(spark, d)
    return _rounded(reference.wasserstein(own, reference.quantiles(own, ["quantity"])), 4)


def frechet(spark: SparkSession, d: str) -> DataFrame:
    """One row: the distance of clips of odd label from those of even label, exact and symmetrised."""
    own = samples(spark, d)
    a, b = (reference.feature_gaussian(own.where(F.col("clip") % 2 == r), QUANTITIES) for r in (0, 1))
    return spark.createDataFrame([(a.n, b.n, reference.frechet(a, b), reference.frechet(a, b, True))], "n_reference long, n long, kfd double, kfd_approx double")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return detectors.flagged(tables.table(spark, d, "events"), BOUND)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = detectors.windowed(_events(spark, d), "1 day")
    return _rounded(rows.withColumn("start", F.unix_timestamp("start")))


def event_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = detectors.windowed(_events(spark, d), "2 days", "1 day")
    return _rounded(rows.withColumn("start", F.unix_timestamp("start")))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = detectors.sessions(_events(spark, d))
    return rows.withColumn("start", F.unix_timestamp("start")).withColumn("end", F.unix_timestamp("end"))


ARMS, BODY, FEET = [[2, 3, 4, 5], [8, 9, 10, 11]], {0: 0.2, 1: 0.1}, [18, 19]
MASSES = {0: 5.0, 1: 3.0, 20: 1.0}
LENGTHS, LINKS, RATED = [0.4, 0.3], [2.0, 1.0], [40.0, 15.0]


def collisions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feasibility.collisions(feasibility.penetration(tables.keypoints(spark, d), ARMS, BODY)))


def balance(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(feasibility.balance(tables.keypoints(spark, d), MASSES, FEET))


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    rows = feasibility.smoothed(tables.joints(spark, d))
    return _rounded(rows.select("clip", "t", F.get("q", F.lit(0)).alias("a"), F.get("q", F.lit(1)).alias("b")))


def torque(spark: SparkSession, d: str) -> DataFrame:
    own = feasibility.planar_torques(feasibility.smoothed(tables.joints(spark, d)), DT, LENGTHS, LINKS)
    return _rounded(feasibility.peak_share(own, RATED), 4)


def frame_traces(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's largest step and jerk of a clip as traces, unfolded again."""
    w = blocks.window()
    rows = blocks.blocked(tables.keypoints(spark, d), 3)
    frames = rows.select("own", F.col("clip").cast("string").alias("clip_id"), "t", F.array_max(S.norms(S.difference("p", 1, w))).alias("step"), F.array_max(S.norms(S.difference("p", 3, w))).alias("jerk")).where("own")
    return _rounded(traces.unfolded(traces.traces(frames, ["step", "jerk"])))


QUERIES = {
    "metrics_collision": collisions, "metrics_balance": balance, "joints_smoothed": smoothed, "metrics_torque": torque, "frame_traces": frame_traces,
    "resample_plan": resample_plan, "resample_decimate": resample_decimate, "resample_interpolate": resample_interpolate,
    "reference_baselines": baselines, "reference_invariance": invariance, "reference_w1": wasserstein, "reference_frechet": frechet,
    "event_windows": event_windows, "event_sliding_windows": event_sliding_windows, "event_sessions": event_sessions,
}

_E = f"e AS (SELECT *, coalesce(value > {BOUND}, false) AS flag FROM events)"


def sql(temporal: str, points: str, joints: str) -> dict[str, str]:
    """SQL by query, from that of the temporal metrics, keypoints with differences, and joints."""
    terms = f"""{temporal}, u AS (SELECT clip, unnest(['mean_speed_mps','mean_accel_mps2','max_accel_mps2','mean_jerk_mps3','accel_violation_frac','no_teleport_frac']) AS metric, unnest([2,3,3,4,3,2]) AS least,
  unnest([mean_speed_mps, mean_accel_mps2, max_accel_mps2, mean_jerk_mps3, accel_violation_frac, no_teleport_frac]) AS v, n_frames FROM m LEFT JOIN tp USING (clip)),
terms AS (SELECT clip, metric, CASE WHEN n_frames >= least THEN v END AS value FROM u),
b0 AS (SELECT metric, median(value) AS base FROM terms GROUP BY metric),
b AS (SELECT metric, any_value(base) AS base, greatest(median(abs(value - base)), 0.001) AS floor FROM terms JOIN b0 USING (metric) GROUP BY metric)"""
    spot = lambda k, c: f"e[{3 * k + c + 1}]"
    sphere = lambda chain, first: [
        *[[f"({spot(i, c)} + ({spot(j, c)} - {spot(i, c)}) * {s / 3!r})" for c in range(3)] for i, j in zip(chain[first:], chain[first + 1 :], strict=False) for s in range(3)], [spot(chain[-1], c) for c in range(3)],
    ]
    gap = lambda r, a, b: f"{r!r} - sqrt({' + '.join(f'({x} - {y})**2' for x, y in zip(a, b, strict=True))})"
    radius = feasibility.ARM_RADIUS
    depths = [gap(radius + r, a, [spot(k, c) for c in range(3)]) for arm in ARMS for a in sphere(arm, 1) for k, r in BODY.items()]
    depths += [gap(2 * radius, a, b) for a in sphere(ARMS[0], 0) for b in sphere(ARMS[1], 0)]
    taps = [math.exp(-0.5 * k * k) for k in range(-3, 4)]
    near = lambda c, k: f"coalesce({'lead' if k > 0 else 'lag'}({c}, {abs(k)}) OVER w, {'last_value' if k > 0 else 'first_value'}({c}) OVER v)" if k else c
    mixed = lambda c: " + ".join(f"{near(c, k)} * {v / sum(taps)!r}" for k, v in zip(range(-3, 4), taps, strict=True))
    smooth = f"{joints}, sm AS (SELECT clip, t, {mixed('a')} AS a, {mixed('b')} AS b FROM j WINDOW w AS (PARTITION BY clip ORDER BY t), v AS (PARTITION BY clip ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    com = lambda c: f"({' + '.join(f'{m!r} * {spot(k, c)}' for k, m in MASSES.items())}) / {sum(MASSES.values())!r}"
    edge = lambda c: f"{com(c)} - (least({spot(18, c)}, {spot(19, c)}) - 0.12), greatest({spot(18, c)}, {spot(19, c)}) + 0.12 - {com(c)}"
    second = lambda c: f"(lead({c}) OVER w - 2 * {c} + lag({c}) OVER w) / 0.01"
    edge_slope = lambda near, next_: f"CASE WHEN {next_} IS NULL THEN {near} WHEN sign((3*{near}-{next_})/2) <> sign({near}) THEN 0 WHEN sign({near}) <> sign({next_}) AND abs((3*{near}-{next_})/2) > 3*abs({near}) THEN 3*{near} ELSE (3*{near}-{next_})/2 END"
    slope = lambda c: f"CASE WHEN {c}b1 IS NOT NULL AND {c}e1 IS NOT NULL THEN CASE WHEN ({c}-{c}b1)*({c}e1-{c}) > 0 THEN 2/(1/({c}-{c}b1) + 1/({c}e1-{c})) ELSE 0 END WHEN {c}e1 IS NOT NULL THEN {edge_slope(f'({c}e1-{c})', f'({c}e2-{c}e1)')} ELSE {edge_slope(f'({c}-{c}b1)', f'({c}b1-{c}b2)')} END"
    at = ", ".join(repr(i / (reference.QUANTILES - 1)) for i in range(reference.QUANTILES))
    return {
        "metrics_collision": f"""WITH {points}, z AS (SELECT clip, greatest(0, {", ".join(depths)}) AS depth FROM kp)
SELECT clip, round(avg(depth) * 1000, 5) AS penetration_mm, round(avg(CASE WHEN depth > 0.01 THEN 1.0 ELSE 0.0 END), 5) AS self_collision_frac FROM z GROUP BY clip""",
        "metrics_balance": f"WITH {points} SELECT clip, round(avg(least({edge(0)}, {edge(1)})), 5) AS com_margin_m FROM kp GROUP BY clip",
        "joints_smoothed": f"WITH {smooth} SELECT clip, t, round(a, 5) AS a, round(b, 5) AS b FROM sm",
        "metrics_torque": f"""WITH {smooth}, po AS (SELECT clip, t, a AS a1, a + b AS a2, 0.2 * cos(a) AS x1, 0.2 * sin(a) AS y1, 0.4 * cos(a) AS px, 0.4 * sin(a) AS py, 0.4 * cos(a) + 0.15 * cos(a + b) AS x2, 0.4 * sin(a) + 0.15 * sin(a + b) AS y2 FROM sm),
ac AS (SELECT *, {second('x1')} AS ax1, {second('y1')} AS ay1, {second('x2')} AS ax2, {second('y2')} AS ay2, {second('a1')} AS s1, {second('a2')} AS s2 FROM po WINDOW w AS (PARTITION BY clip ORDER BY t)),
tq AS (SELECT clip, (x1 * 2 * (ay1 + 9.81) - y1 * 2 * ax1) + 2 * 0.16 / 12 * s1 + (x2 * (ay2 + 9.81) - y2 * ax2) + 0.09 / 12 * s2 AS t1, ((x2 - px) * (ay2 + 9.81) - (y2 - py) * ax2) + 0.09 / 12 * s2 AS t2 FROM ac WHERE ax1 IS NOT NULL)
SELECT clip, round(100 * quantile_cont(greatest(abs(t1) / 40, abs(t2) / 15), 0.98), 4) AS torque_frac_rated FROM tq GROUP BY clip""",
        "frame_traces": f"""WITH {points}, g AS (SELECT clip::VARCHAR AS clip_id, t, max(d1) AS step, max(d3) AS jerk FROM d GROUP BY clip, t)
SELECT clip_id, 'step' AS metric, (t - 1)::INT AS frame, round(step, 5) AS value FROM g WHERE step IS NOT NULL UNION ALL SELECT clip_id, 'jerk', (t - 1)::INT, round(jerk, 5) FROM g WHERE jerk IS NOT NULL""",
        "resample_plan": """WITH c AS (SELECT user_id AS clip, count(*) AS n, (user_id % 6 + 1) * 5.0::DOUBLE AS fps FROM events GROUP BY user_id)
SELECT *, CASE WHEN fps = 10 THEN 'noop' WHEN fps < 10 THEN 'refuse' WHEN fps % 10 = 0 THEN 'decimate' ELSE 'interpolate' END AS action, CASE WHEN fps > 10 AND fps % 10 = 0 THEN (fps / 10)::INT END AS factor FROM c""",
        "resample_decimate": f"WITH {joints} SELECT clip, ((t - 1) // 3 + 1)::INT AS t, round(a, 5) AS a, round(b, 5) AS b FROM j WHERE (t - 1) % 3 = 0",
        "resample_interpolate": f"""WITH {joints}, ny AS (SELECT *, {", ".join(f"lag({c}, {n}) OVER w AS {c}b{n}, lead({c}, {n}) OVER w AS {c}e{n}" for c in "ab" for n in (1, 2))} FROM j WINDOW w AS (PARTITION BY clip ORDER BY t)),
sl AS (SELECT *, {slope("a")} AS da, {slope("b")} AS db FROM ny), iv AS (SELECT *, lead(da) OVER w AS fa, lead(db) OVER w AS fb, ceil((t-1)*0.1/0.13 - 1e-9) AS lo, CASE WHEN ae1 IS NULL THEN floor((t-1)*0.1/0.13 + 1e-9) ELSE ceil(t*0.1/0.13 - 1e-9) - 1 END AS hi FROM sl WINDOW w AS (PARTITION BY clip ORDER BY t)),
kk AS (SELECT *, unnest(range(lo::BIGINT, hi::BIGINT + 1)) AS k FROM iv WHERE lo <= hi), uu AS (SELECT *, least(greatest(k*0.13/0.1 - (t-1), 0), 1) AS u FROM kk)
SELECT clip, (k+1)::INT AS t, {", ".join(f"round(CASE WHEN ae1 IS NULL THEN {c} ELSE {c}*(1+2*u)*(1-u)**2 + d{c}*u*(1-u)**2 + {c}e1*u**2*(3-2*u) + f{c}*u**2*(u-1) END, 5) AS {c}" for c in "ab")} FROM uu""",
        "reference_baselines": f"WITH {terms} SELECT metric, round(base, 5) AS base, round(floor, 5) AS floor FROM b",
        "reference_invariance": f"""WITH {terms}, s AS (SELECT clip, least(greatest(CASE WHEN metric LIKE '%\\_frac' ESCAPE '\\' THEN (value - base) / 0.1 ELSE (value - base) / (greatest(base, floor) * 2) END, 0), 1) AS s, value FROM terms JOIN b USING (metric))
SELECT clip, count(value) AS n_terms, count(*) - count(value) AS n_missing, CASE WHEN count(*) = count(value) THEN round(avg(s), 5) END AS score FROM s GROUP BY clip""",
        "reference_w1": f"""WITH {points}, s AS (SELECT clip, 'speed' AS quantity, d1 / 0.1 AS value FROM d WHERE d1 IS NOT NULL UNION ALL SELECT clip, 'height', sum(z) FROM pts GROUP BY clip, t),
own AS (SELECT clip, quantity, quantile_cont(value, [{at}]) AS q FROM s GROUP BY clip, quantity), ref AS (SELECT quantity, quantile_cont(value, [{at}]) AS r FROM s GROUP BY quantity)
SELECT clip, quantity, round(list_avg(list_transform(list_zip(q, r), lambda x: abs(x[1] - x[2]))), 4) AS w1 FROM own JOIN ref USING (quantity)""",
        "event_windows": f"WITH {_E} SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, count(*) FILTER (flag) AS n_flagged, round(max(value), 5) AS worst FROM e GROUP BY ALL",
        "event_sliding_windows": f"WITH {_E} SELECT epoch(date_trunc('day', ts))::BIGINT - 86400 * back AS start, event_type, count(*) AS n, count(*) FILTER (flag) AS n_flagged, round(max(value), 5) AS worst FROM e, range(2) r(back) GROUP BY ALL",
        "event_sessions": f"""WITH {_E}, g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR AS fresh FROM e),
i AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 6 HOUR))::BIGINT AS "end", count(*) AS n, count(*) FILTER (flag) AS n_flagged FROM i GROUP BY user_id, run""",
    }
