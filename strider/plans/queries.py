"""Queries of the engine's operators over the shared tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strider.operators import metrics, stats, violations
from strider.plans import layouts, motion, reports, results, robots, samples, stored, suites, trees, views
from strider.sources import manifest, tables
from strider.sources.shared import stored as stored_once

DT, REST, BEND_FLOOR = 0.1, 0.15, 3.0
LIMITS, SPEEDS, EFFORTS = [(0.1, 0.9), (0.5, 8.0)], [5.0, 40.0], [10.0, 20.0]


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _kp(body):
    return lambda spark, d: _rounded(body(tables.keypoints(spark, d)))


def _joints(body):
    return lambda spark, d: _rounded(body(tables.joints(spark, d)))


def _scores(body):
    return lambda spark, d: _rounded(body(tables.scores(spark, d)))


def _frames(kp: DataFrame) -> DataFrame:
    return violations.scores(kp, tables.BONES, REST)


def _report(score: str, higher_is_worse: bool = True):
    def of(kp: DataFrame) -> DataFrame:
        frames = stored_once(_frames(kp).select("clip", "t", score), "scores")
        return violations.report(frames, score, violations.thresholds(frames, score, higher_is_worse=higher_is_worse), higher_is_worse)

    return _kp(of)


def _bend_report(kp: DataFrame) -> DataFrame:
    frames = stored_once(violations.bend_excess(violations.bend_angles(kp, tables.POINTS)), "scores")
    return violations.report(frames, "bend", violations.thresholds(frames, "bend", floor=BEND_FLOOR))


MEASURES = (("l_extendedprice", "lower_better", 2, 500.0), ("l_quantity", "higher_better", None, 0.0), ("l_discount", "lower_better", 0, 0.01))


def _long_scores(spark: SparkSession, d: str) -> DataFrame:
    """(method, metric, episode, role, value) of three measures and, for metric ``lonely``, of few episodes."""
    parts = [tables.scores(spark, d, m).withColumn("metric", F.lit(m)) for m, *_ in MEASURES]
    few = tables.scores(spark, d).where("episode <= 3").withColumn("metric", F.lit("lonely"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(few)


def _specs(spark: SparkSession) -> DataFrame:
    rows = [(m, "u", e, way, floor) for m, way, e, floor in MEASURES] + [("lonely", "u", 1, "lower_better", None)]
    return spark.createDataFrame(rows, "metric string, units string, dt_exponent int, direction string, noise_floor double")


def _seconds(spark: SparkSession, d: str) -> DataFrame:
    """Paired deltas with a method ``X`` that has no episode in common with the others."""
    own = stats.paired_deltas(tables.scores(spark, d)).select("method", "episode", "delta")
    return own.unionByName(own.where("method = 'R'").select(F.lit("X").alias("method"), (F.col("episode") + 1_000_000).alias("episode"), (F.col("delta") / 2).alias("delta")))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.rank_methods(_taxes(spark, d).unionByName(spark.createDataFrame([("Z", None, "l_tax", "lower_better")], "method string, tax double, metric string, direction string")), "N")
    said = lambda c, x: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], x(e["value"]))), ",")
    return rows.select("method", F.round("mean_rank", 5).alias("mean_rank"), "n_axes", F.coalesce(said("axis_ranks", lambda v: v.cast("string")), F.lit("")).alias("axis_ranks"), F.coalesce(said("extra_cost", lambda v: F.when(v >= 0, "+").otherwise("-")), F.lit("")).alias("dearer"))


def _taxes(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        stats.paired_deltas(tables.scores(spark, d, m)).groupBy("method").agg(F.median("delta").alias("tax")).withColumn("metric", F.lit(m)).withColumn("direction", F.lit(way))
        for m, way in (("l_extendedprice", "lower_better"), ("l_quantity", "higher_better"), ("l_discount", "lower_better"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def holm_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Holm over p-values made from shares of lines, one for each ship month and method."""
    rows = tables.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").cast("string").alias("metric")).agg(
        F.round(F.avg((F.col("l_quantity") < 3).cast("double")), 9).alias("p")
    )
    return _rounded(stats.holm(rows, ["method"]), 6)


def clip_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clips: customer market as family, two roles by parity of the order line."""
    o, c = tables.table(spark, d, "orders"), tables.table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("path"), F.col("c_mktsegment").alias("family"), F.col("o_custkey").alias("pair_key"),
        F.when(F.col("o_orderkey") % 2 == 0, "gt").otherwise("pred").alias("role"), F.col("o_orderstatus").alias("codec"),
        (F.col("o_totalprice") / 1000).alias("dt"), F.length("o_orderpriority").alias("w"),
    )


def episode_cap(spark: SparkSession, d: str) -> DataFrame:
    return manifest.capped(clip_manifest(spark, d), 100).select("path", "family")


def resume(spark: SparkSession, d: str) -> DataFrame:
    done = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path")).distinct()
    return manifest.unscored(clip_manifest(spark, d), done).select("path", "family")


def pairing(spark: SparkSession, d: str) -> DataFrame:
    return manifest.pairing_report(clip_manifest(spark, d))


def summarize_group(spark: SparkSession, d: str) -> DataFrame:
    return clip_manifest(spark, d).groupBy("family").agg(
        F.count("*").alias("n"), F.count_if(F.col("codec") == "F").alias("n_f"), F.array_join(F.array_sort(F.collect_set("codec")), "|").alias("codecs"),
        F.round(F.median("dt"), 5).alias("median_dt"),
    )


def cell_matrix(spark: SparkSession, d: str) -> DataFrame:
    axes = [tables.table(spark, d, "region").select(F.col("r_name").alias("view")), tables.table(spark, d, "nation").select(F.col("n_name").alias("robot")), tables.table(spark, d, "part").select(F.col("p_brand").alias("generator")).distinct()]
    return manifest.cells(axes, [{"view": "ASIA"}, {"robot": "FRANCE", "view": "EUROPE"}]).withColumn("cell_id", F.concat_ws("/", "view", "robot", "generator"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.table(spark, d, "pages")
    return pages.select("page_id", manifest.clip_id(F.col("url"), F.lit("suite"), F.lit(None)).alias("clip_id"), manifest.episode_name(F.col("url")).alias("episode"))


def score_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 20 worst episodes of all methods: a top-k report."""
    rows = stats.paired_deltas(tables.scores(spark, d)).orderBy(F.desc("delta"), "method", "episode").limit(20)
    return _rounded(rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta"), "method", "episode"))).select("rank", "method", "episode", "delta"), 4)


def reasons(kp: DataFrame) -> DataFrame:
    values = metrics.temporal(kp, DT)
    return metrics.with_reason(values)


_QUERIES = {
    "metrics_temporal": _kp(lambda kp: metrics.temporal(kp, DT)),
    "metrics_energy": _kp(lambda kp: metrics.energy(kp, DT)),
    "metrics_rigidity": _kp(lambda kp: metrics.rigidity(kp, tables.BONES, REST)),
    "metrics_joint_limits": _joints(lambda j: metrics.joint_limits(j, LIMITS)),
    "metrics_joint_dynamics": _joints(lambda j: metrics.joint_dynamics(j, DT, SPEEDS, EFFORTS)),
    "metrics_angular": _joints(lambda j: metrics.angular(metrics.arm_2r(j), DT)),
    "metrics_ldlj": _kp(lambda kp: metrics.log_dimensionless_jerk(kp, tables.POINTS - 1, DT)),
    "metrics_sparc": _kp(lambda kp: metrics.sparc(kp, tables.POINTS - 1, DT)),
    "metric_reasons": _kp(reasons),
    "paired_deltas": _scores(stats.paired_deltas),
    "auroc": _scores(stats.auroc),
    "paired_tests": _scores(lambda s: stats.tests(stats.paired_deltas(s))),
    "separation": lambda spark, d: _rounded(stats.separation(_long_scores(spark, d), _specs(spark))),
    "separation_tests": lambda spark, d: _rounded(stats.separation_tests(_long_scores(spark, d), _specs(spark))),
    "second_difference": lambda spark, d: _rounded(stats.second_difference(_seconds(spark, d), "N")),
    "second_difference_tests": lambda spark, d: _rounded(stats.second_difference_tests(_seconds(spark, d), "N")),
    "noise_floor": _scores(lambda s: stats.null_deltas(stats.paired_deltas(s))),
    "rank_methods": _ranked,
    "holm": holm_by_method,
    "violations_teleport": _report("teleport"),
    "violations_jerk": _report("jerk"),
    "violations_rigidity": _report("rigidity"),
    "violations_collision": _report("collision", higher_is_worse=False),
    "violations_bend": _kp(_bend_report),
    "violation_scores": _kp(lambda kp: _frames(kp)),
    "violations_joint_envelope": _kp(lambda kp: violations.joint_envelope(violations.bend_angles(kp, tables.POINTS))),
    "episode_cap": episode_cap,
    "resume_anti_join": resume,
    "pairing_report": pairing,
    "summarize_group": summarize_group,
    "cell_matrix": cell_matrix,
    "identities": identities,
    "score_rank": score_rank,
}

_KP = """kp AS (SELECT label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS t, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
pts AS (SELECT clip, t, k, e[3*k+1] AS x, e[3*k+2] AS y, e[3*k+3] AS z FROM kp, range(21) r(k))"""
_D = """, lagged AS (SELECT *, lag(x) OVER w AS x1, lag(y) OVER w AS y1, lag(z) OVER w AS z1, lag(x,2) OVER w AS x2, lag(y,2) OVER w AS y2, lag(z,2) OVER w AS z2, lag(x,3) OVER w AS x3, lag(y,3) OVER w AS y3, lag(z,3) OVER w AS z3
  FROM pts WINDOW w AS (PARTITION BY clip, k ORDER BY t)),
d AS (SELECT clip, t, k, sqrt((x-x1)**2+(y-y1)**2+(z-z1)**2) AS d1, sqrt((x-2*x1+x2)**2+(y-2*y1+y2)**2+(z-2*z1+z2)**2) AS d2, sqrt((x-3*x1+3*x2-x3)**2+(y-3*y1+3*y2-y3)**2+(z-3*z1+3*z2-z3)**2) AS d3 FROM lagged)"""
_J = """j AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, coalesce(value/100, 0) AS a, coalesce(CAST(props->>'$.k' AS DOUBLE)/10, 0) AS b FROM events)"""
_S = """s AS (SELECT l_returnflag AS method, l_suppkey AS episode, CASE WHEN l_linestatus = 'F' THEN 'gt' ELSE 'pred' END AS role, avg({m}) AS value FROM lineitem GROUP BY ALL),
pd AS (SELECT g.method, g.episode, g.value AS gt, p.value AS pred, p.value - g.value AS delta FROM s g JOIN s p ON g.method = p.method AND g.episode = p.episode AND g.role = 'gt' AND p.role = 'pred')"""
_SP = _S.format(m="l_extendedprice")
_TEMPORAL = f"""{_KP}{_D}, m AS (SELECT clip, (SELECT count(*) FROM kp WHERE kp.clip = d.clip) AS n_frames, avg(d1)/0.1 AS mean_speed_mps, avg(d2)/0.01 AS mean_accel_mps2, max(d2)/0.01 AS max_accel_mps2, avg(d3)/0.001 AS mean_jerk_mps3, avg(CASE WHEN d2/0.01 > 5 THEN 1.0 WHEN d2 IS NOT NULL THEN 0.0 END) AS accel_violation_frac FROM d GROUP BY clip),
tp AS (SELECT clip, avg(CASE WHEN v > 2 THEN 1.0 ELSE 0.0 END) AS no_teleport_frac FROM (SELECT clip, t, max(d1)/0.1 AS v FROM d WHERE d1 IS NOT NULL GROUP BY clip, t) GROUP BY clip)"""
_BONES = f"""{_KP}, bones AS (SELECT a.clip, a.t, a.k AS b, sqrt((a.x-c.x)**2+(a.y-c.y)**2+(a.z-c.z)**2) AS l FROM pts a JOIN pts c ON a.clip = c.clip AND a.t = c.t AND c.k = a.k + 1)"""
_FRAMES = f"""{_BONES}{_D}, g AS (SELECT clip, t, max(d1)*1000 AS tele, max(d3)*1000 AS j FROM d GROUP BY clip, t),
h AS (SELECT clip, t, coalesce(tele, 0) AS teleport, coalesce(lead(j) OVER (PARTITION BY clip ORDER BY t), 0) AS jerk FROM g),
f AS (SELECT h.*, r.rigidity FROM h JOIN (SELECT clip, t, max(abs(l - 0.15))*1000 AS rigidity FROM bones GROUP BY clip, t) r USING (clip, t))"""


def _report_sql(score: str, frames: str = _FRAMES, floor: float = 0.0) -> str:
    return f"""WITH {frames}, th AS (SELECT greatest(quantile_cont({score}, 0.95), {floor}) AS threshold FROM f),
fl AS (SELECT clip, t, {score} AS s, threshold, {score} > threshold AS flag FROM f, th),
isl AS (SELECT clip, t - row_number() OVER (PARTITION BY clip ORDER BY t) AS i FROM fl WHERE flag),
runs AS (SELECT clip, count(DISTINCT i) AS runs FROM isl GROUP BY clip)
SELECT fl.clip, round(any_value(threshold), 2) AS threshold, round(avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END), 3) AS fraction, count(*) FILTER (flag) AS n_flagged,
  round(median(s/threshold), 3) AS severity_median, round(quantile_cont(s/threshold, 0.9), 3) AS severity_p90, coalesce(any_value(runs), 0) AS runs
FROM fl LEFT JOIN runs ON fl.clip = runs.clip GROUP BY fl.clip"""


_BEND = f"""{_KP}, bone AS (SELECT a.clip, a.t, a.k, c.x-a.x AS x, c.y-a.y AS y, c.z-a.z AS z FROM pts a JOIN pts c ON a.clip = c.clip AND a.t = c.t AND c.k = a.k + 1),
an AS (SELECT a.clip, a.t, a.k AS joint, degrees(acos(greatest(-1.0, least(1.0, (a.x*c.x+a.y*c.y+a.z*c.z)/(sqrt(a.x**2+a.y**2+a.z**2)*sqrt(c.x**2+c.y**2+c.z**2)+1e-6))))) AS angle FROM bone a JOIN bone c ON a.clip = c.clip AND a.t = c.t AND c.k = a.k + 1),
fit AS (SELECT joint, quantile_cont(angle, 0.01) AS lo, quantile_cont(angle, 0.99) AS hi FROM an GROUP BY joint),
f AS (SELECT clip, t, max(greatest(angle-hi, 0) + greatest(lo-angle, 0)) AS bend FROM an JOIN fit USING (joint) GROUP BY clip, t)"""
_COLLISION = "col AS (SELECT a.clip, a.t, min(sqrt((a.x-c.x)**2+(a.y-c.y)**2+(a.z-c.z)**2))*1000 AS collision FROM pts a JOIN pts c ON a.clip = c.clip AND a.t = c.t AND c.k >= a.k + 2 GROUP BY a.clip, a.t)"

_MAN = """man AS (SELECT o_orderkey AS path, c_mktsegment AS family, o_custkey AS pair_key, CASE WHEN o_orderkey % 2 = 0 THEN 'gt' ELSE 'pred' END AS role, o_orderstatus AS codec, o_totalprice/1000 AS dt, length(o_orderpriority) AS w FROM orders JOIN customer ON o_custkey = c_custkey)"""

_SQL = {
    "metrics_temporal": f"WITH {_TEMPORAL} SELECT m.clip, n_frames, round(mean_speed_mps,5) AS mean_speed_mps, round(mean_accel_mps2,5) AS mean_accel_mps2, round(max_accel_mps2,5) AS max_accel_mps2, round(mean_jerk_mps3,5) AS mean_jerk_mps3, round(accel_violation_frac,5) AS accel_violation_frac, round(no_teleport_frac,5) AS no_teleport_frac FROM m JOIN tp USING (clip)",
    "metric_reasons": f"""WITH {_TEMPORAL}, u AS (SELECT clip, unnest(['mean_speed_mps','mean_accel_mps2','max_accel_mps2','mean_jerk_mps3','accel_violation_frac','no_teleport_frac']) AS metric, unnest([2,3,3,4,3,2]) AS least,
  unnest([mean_speed_mps, mean_accel_mps2, max_accel_mps2, mean_jerk_mps3, accel_violation_frac, no_teleport_frac]) AS v, n_frames FROM m LEFT JOIN tp USING (clip))
SELECT clip, metric, CASE WHEN n_frames >= least THEN round(v,5) END AS value, CASE WHEN n_frames < least THEN 'too_few_frames:' || n_frames || '<' || least WHEN v IS NULL THEN 'degenerate_input:non_finite_result' END AS reason FROM u""",
    "metrics_energy": f"""WITH {_KP}{_D}, l2 AS (SELECT clip, t, sum(((x-x1)**2+(y-y1)**2+(z-z1)**2))/0.01*0.5 AS ke, sum(z1) AS h, sum(x-x1)/0.1 AS mx, sum(y-y1)/0.1 AS my, sum(z-z1)/0.1 AS mz FROM lagged WHERE x1 IS NOT NULL GROUP BY clip, t),
l3 AS (SELECT *, sqrt((mx-lag(mx) OVER w)**2+(my-lag(my) OVER w)**2+(mz-lag(mz) OVER w)**2)/0.1 AS f FROM l2 WINDOW w AS (PARTITION BY clip ORDER BY t))
SELECT clip, round(stddev_samp(ke),5) AS kinetic_energy_tstd, round(stddev_samp(ke+9.81*h),5) AS total_energy_tstd, round(avg(f),5) AS momentum_dp_mean FROM l3 GROUP BY clip""",
    "metrics_rigidity": f"""WITH {_BONES}, pb AS (SELECT clip, b, avg(abs(l-0.15)) AS r, stddev_pop(l) AS s, quantile_disc(l, 0.5) AS m FROM bones GROUP BY clip, b),
w AS (SELECT clip, t, max(abs(l-m)) AS d FROM bones JOIN pb USING (clip, b) GROUP BY clip, t)
SELECT clip, round(avg(r)*1000,5) AS rigidity_residual_mm, round(avg(s)*1000,5) AS rigidity_wobble_mm, (SELECT round(avg(d)*1000,5) FROM w WHERE w.clip = pb.clip) AS rigidity_worst_bone_mm FROM pb GROUP BY clip""",
    "metrics_joint_limits": f"""WITH {_J}, x AS (SELECT clip, greatest(a-0.9,0)+greatest(0.1-a,0)+greatest(b-8,0)+greatest(0.5-b,0) AS x, least(0.9-a,a-0.1,8-b,b-0.5) AS r FROM j)
SELECT clip, count(*) AS n_frames, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END),5) AS limit_violation_frac, round(avg(x),5) AS limit_excess_rad, round(avg(r),5) AS limit_headroom_rad FROM x GROUP BY clip""",
    "metrics_joint_dynamics": f"""WITH {_J}, l AS (SELECT clip, abs(a-lag(a) OVER w)/0.1 AS va, abs(b-lag(b) OVER w)/0.1 AS vb, abs(a-2*lag(a) OVER w+lag(a,2) OVER w)/0.01 AS aa, abs(b-2*lag(b) OVER w+lag(b,2) OVER w)/0.01 AS ab FROM j WINDOW w AS (PARTITION BY clip ORDER BY t))
SELECT clip, round(avg((va+vb)/2),5) AS mean_qdot_radps, round(avg((aa+ab)/2),5) AS mean_qddot_radps2, round(avg(CASE WHEN va IS NOT NULL THEN ((va>5)::INT+(vb>40)::INT)/2.0 END),5) AS vel_violation_frac, round(avg(aa/10+ab/20),5) AS effort_proxy FROM l GROUP BY clip""",
    "metrics_angular": f"""WITH {_J}, o AS (SELECT clip, t, sin(a-lag(a) OVER w)/0.1 AS o1, sin((a+b)-lag(a+b) OVER w)/0.1 AS o2 FROM j WINDOW w AS (PARTITION BY clip ORDER BY t)),
q AS (SELECT *, abs(o1-lag(o1) OVER w)/0.1 AS c1, abs(o2-lag(o2) OVER w)/0.1 AS c2 FROM o WINDOW w AS (PARTITION BY clip ORDER BY t))
SELECT clip, round(avg((abs(o1)+abs(o2))/3),5) AS mean_angvel_radps, round(max(greatest(abs(o1),abs(o2))),5) AS max_angvel_radps, round(avg((c1+c2)/3),5) AS mean_angacc_radps2 FROM q GROUP BY clip""",
    "metrics_ldlj": f"""WITH {_KP}{_D}, z AS (SELECT clip, count(*) AS n, sum(d1) AS path, sum((d3/0.001)**2*0.1) AS jj FROM d WHERE k = 20 GROUP BY clip)
SELECT clip, CASE WHEN n >= 8 AND path > 1e-9 THEN round(-ln(((n-1)*0.1)**5/path**2*jj),5) END AS log_dimensionless_jerk FROM z""",
    "paired_deltas": f"WITH {_SP} SELECT method, episode, round(gt,5) AS gt, round(pred,5) AS pred, round(delta,5) AS delta FROM pd",
    "auroc": f"""WITH {_SP}, r AS (SELECT method, role, rank() OVER (PARTITION BY method ORDER BY value) + (count(*) OVER (PARTITION BY method, value) - 1)/2.0 AS r FROM s),
q AS (SELECT method, (sum(r) FILTER (role='pred') - count(*) FILTER (role='pred')*(count(*) FILTER (role='pred')+1)/2.0)/(count(*) FILTER (role='pred')*count(*) FILTER (role='gt')+1e-9) AS a FROM r GROUP BY method)
SELECT method, round(a,5) AS auroc, round(2*a-1,5) AS cliffs_delta FROM q""",
    "second_difference": f"""WITH {_SP}, x AS (SELECT method, episode, delta FROM pd UNION ALL SELECT 'X', episode + 1000000, delta / 2 FROM pd WHERE method = 'R'),
c AS (SELECT p.method, count(*) AS n, median(p.delta-b.delta) AS extra FROM x p JOIN x b ON p.episode = b.episode AND b.method = 'N' WHERE p.method <> 'N' GROUP BY p.method),
o AS (SELECT method, count(*) AS n, median(delta) AS m FROM x WHERE method <> 'N' GROUP BY method), b AS (SELECT count(*) AS n, median(delta) AS m FROM x WHERE method = 'N')
SELECT o.method, c.n IS NOT NULL AS paired, coalesce(c.n, least(o.n, b.n)) AS n, round(coalesce(c.extra, o.m - b.m),5) AS extra FROM o LEFT JOIN c ON o.method = c.method, b""",
    "separation": f"""WITH spec(metric, dt_exponent, direction, noise_floor) AS (VALUES ('l_extendedprice', 2, 'lower_better', 500.0::DOUBLE), ('l_quantity', NULL, 'higher_better', 0.0), ('l_discount', 0, 'lower_better', 0.01), ('lonely', 1, 'lower_better', NULL)),
s AS ({" UNION ALL ".join(f"SELECT l_returnflag AS method, '{m}' AS metric, l_suppkey AS episode, CASE WHEN l_linestatus = 'F' THEN 'gt' ELSE 'pred' END AS role, avg({c}) AS value FROM lineitem {w} GROUP BY ALL" for m, c, w in (("l_extendedprice", "l_extendedprice", ""), ("l_quantity", "l_quantity", ""), ("l_discount", "l_discount", ""), ("lonely", "l_extendedprice", "WHERE l_suppkey <= 3")))}),
pd AS (SELECT g.method, g.metric, p.value - g.value AS delta, direction FROM s g JOIN s p ON g.method = p.method AND g.metric = p.metric AND g.episode = p.episode AND g.role = 'gt' AND p.role = 'pred' JOIN spec ON spec.metric = g.metric),
t AS (SELECT method, metric, count(*) AS n, median(delta) AS dm, avg(CASE WHEN (delta > 0 AND direction = 'lower_better') OR (delta < 0 AND direction = 'higher_better') THEN 1.0 ELSE 0.0 END) AS fw FROM pd GROUP BY ALL),
sd AS (SELECT method, metric, median(value) FILTER (role = 'gt') AS rm, median(value) FILTER (role = 'pred') AS gm FROM s GROUP BY ALL),
r AS (SELECT method, metric, role, rank() OVER (PARTITION BY method, metric ORDER BY value) + (count(*) OVER (PARTITION BY method, metric, value) - 1)/2.0 AS r FROM s),
q AS (SELECT method, metric, (sum(r) FILTER (role='pred') - count(*) FILTER (role='pred')*(count(*) FILTER (role='pred')+1)/2.0)/(count(*) FILTER (role='pred')*count(*) FILTER (role='gt')+1e-9) AS a FROM r GROUP BY ALL),
z AS (SELECT s.method, s.metric, spec.dt_exponent, spec.direction, spec.noise_floor, coalesce(t.n, 0) AS n, dm, fw, rm, gm, CASE WHEN spec.direction = 'higher_better' THEN 1 - a ELSE a END AS a, coalesce(t.n, 0) >= 5 AS ok
  FROM (SELECT DISTINCT method, metric FROM s) s JOIN spec USING (metric) LEFT JOIN t USING (method, metric) LEFT JOIN sd USING (method, metric) LEFT JOIN q USING (method, metric))
SELECT method, metric, 'u' AS units, dt_exponent, direction, dt_exponent IS NOT NULL AS rate_comparable, n, CASE WHEN ok THEN round(rm,5) END AS real_median, CASE WHEN ok THEN round(gm,5) END AS gen_median, CASE WHEN ok THEN round(dm,5) END AS delta_median, CASE WHEN ok THEN round(fw,5) END AS frac_worse,
  CASE WHEN ok THEN round(a,5) END AS separation, CASE WHEN ok THEN round(2*a-1,5) END AS cliffs_delta, noise_floor, CASE WHEN ok AND noise_floor <> 0 THEN abs(dm)/noise_floor > 1 END AS above_noise,
  CASE WHEN ok AND a IS NOT NULL THEN CASE WHEN greatest(a, 1-a) >= 0.8 THEN 'strong' WHEN greatest(a, 1-a) >= 0.6 THEN 'clear' ELSE 'can''t tell' END END AS verdict, CASE WHEN NOT ok THEN 'too_few_episodes:' || n || '<5' END AS reason FROM z""",
    "rank_methods": f"""WITH {", ".join(_S.format(m=m).replace("s AS", f"s{i} AS").replace("pd AS", f"pd{i} AS").replace("FROM s g JOIN s p", f"FROM s{i} g JOIN s{i} p") for i, m in enumerate(("l_extendedprice", "l_quantity", "l_discount")))},
x AS (SELECT method, 'l_extendedprice' AS metric, median(delta) AS o FROM pd0 GROUP BY method UNION ALL SELECT method, 'l_quantity', -median(delta) FROM pd1 GROUP BY method UNION ALL SELECT method, 'l_discount', median(delta) FROM pd2 GROUP BY method),
y AS (SELECT *, count(*) OVER (PARTITION BY metric) AS many FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY o, method) AS rank, max(CASE WHEN method = 'N' THEN o END) OVER (PARTITION BY metric) AS base FROM y WHERE many >= 2),
g AS (SELECT method, avg(rank) AS mean_rank, count(*) AS n_axes, string_agg(metric || '=' || rank, ',' ORDER BY metric) AS axis_ranks, string_agg(CASE WHEN method <> 'N' AND base IS NOT NULL THEN metric || '=' || CASE WHEN o - base >= 0 THEN '+' ELSE '-' END END, ',' ORDER BY metric) AS dearer FROM r GROUP BY method)
SELECT m.method, round(mean_rank,5) AS mean_rank, coalesce(n_axes, 0) AS n_axes, coalesce(axis_ranks, '') AS axis_ranks, coalesce(dearer, '') AS dearer FROM (SELECT DISTINCT method FROM x UNION SELECT 'Z') m LEFT JOIN g USING (method)""",
    "noise_floor": f"WITH {_SP} SELECT method, count(*) AS n, round(avg(delta),5) AS mean, round(median(delta),5) AS median, round(stddev_pop(delta),5) AS std, round(quantile_cont(abs(delta),0.95),5) AS p95_abs, round(median(abs(delta)),5) AS median_abs FROM pd GROUP BY method",
    "holm": """WITH p AS (SELECT l_returnflag AS method, l_linenumber::VARCHAR AS metric, round(avg(CASE WHEN l_quantity < 3 THEN 1.0 ELSE 0.0 END),9) AS p FROM lineitem GROUP BY ALL),
q AS (SELECT *, (count(*) OVER (PARTITION BY method) - row_number() OVER (PARTITION BY method ORDER BY p, metric) + 1)*p AS s FROM p)
SELECT method, metric, round(p,6) AS p, round(least(1.0, max(s) OVER (PARTITION BY method ORDER BY p, metric ROWS UNBOUNDED PRECEDING)),6) AS p_holm FROM q""",
    "violations_teleport": _report_sql("teleport"), "violations_jerk": _report_sql("jerk"), "violations_rigidity": _report_sql("rigidity"),
    "violations_bend": _report_sql("bend", _BEND, BEND_FLOOR),
    "violations_joint_envelope": f"WITH {_BEND} SELECT clip, round(max(bend),5) AS worst, round(avg(bend),5) AS mean FROM f GROUP BY clip",
    "violations_collision": f"""WITH {_KP}, {_COLLISION}, th AS (SELECT quantile_cont(collision, 0.05) AS threshold FROM col),
fl AS (SELECT clip, t, threshold / greatest(collision, 1e-9) AS s, threshold, collision < threshold AS flag FROM col, th),
isl AS (SELECT clip, t - row_number() OVER (PARTITION BY clip ORDER BY t) AS i FROM fl WHERE flag), runs AS (SELECT clip, count(DISTINCT i) AS runs FROM isl GROUP BY clip)
SELECT fl.clip, round(any_value(threshold), 2) AS threshold, round(avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END), 3) AS fraction, count(*) FILTER (flag) AS n_flagged,
  round(median(s), 3) AS severity_median, round(quantile_cont(s, 0.9), 3) AS severity_p90, coalesce(any_value(runs), 0) AS runs FROM fl LEFT JOIN runs ON fl.clip = runs.clip GROUP BY fl.clip""",
    "violation_scores": f"""WITH {_FRAMES}, {_COLLISION}
SELECT clip, t, round(rigidity,5) AS rigidity, round(teleport,5) AS teleport, round(jerk,5) AS jerk, round(collision,5) AS collision FROM f JOIN col USING (clip, t)""",
    "episode_cap": f"WITH {_MAN} SELECT path, family FROM man QUALIFY row_number() OVER (PARTITION BY family ORDER BY path) <= 100",
    "resume_anti_join": f"WITH {_MAN} SELECT path, family FROM man WHERE path NOT IN (SELECT l_orderkey FROM lineitem)",
    "pairing_report": f"""WITH {_MAN}, g AS (SELECT * FROM man WHERE role='gt' QUALIFY row_number() OVER (PARTITION BY pair_key ORDER BY path)=1), p AS (SELECT * FROM man WHERE role='pred' QUALIFY row_number() OVER (PARTITION BY pair_key ORDER BY path)=1)
SELECT g.pair_key, g.codec = p.codec AS same_codec, abs(g.dt-p.dt) <= 0.01*greatest(abs(g.dt),abs(p.dt)) AS same_dt, g.w = p.w AS same_size FROM g JOIN p ON g.pair_key = p.pair_key""",
    "summarize_group": f"WITH {_MAN} SELECT family, count(*) AS n, count(*) FILTER (codec='F') AS n_f, array_to_string(list_sort(list(DISTINCT codec)), '|') AS codecs, round(median(dt),5) AS median_dt FROM man GROUP BY family",
    "cell_matrix": "SELECT r_name AS view, n_name AS robot, p_brand AS generator, (r_name='ASIA' OR (n_name='FRANCE' AND r_name='EUROPE')) AS na, r_name || '/' || n_name || '/' || p_brand AS cell_id FROM region, nation, (SELECT DISTINCT p_brand FROM part)",
    "identities": "SELECT page_id, substr(sha1(coalesce(url,'') || chr(9247) || 'suite' || chr(9247)), 1, 16) AS clip_id, CASE WHEN starts_with(replace(replace(url,'/','__'),':','_'),'episode_') THEN replace(replace(url,'/','__'),':','_') ELSE 'episode_' || replace(replace(url,'/','__'),':','_') END AS episode FROM pages",
    "score_rank": f"WITH {_SP}, r AS (SELECT row_number() OVER (ORDER BY delta DESC, method, episode) AS rank, method, episode, round(delta,4) AS delta FROM pd) SELECT * FROM r WHERE rank <= 20",
}


def queries() -> dict:
    return _QUERIES | motion.QUERIES | results.QUERIES | layouts.QUERIES | robots.QUERIES | trees.QUERIES | suites.QUERIES | stored.QUERIES | samples.QUERIES | views.QUERIES | reports.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | motion.sql(_TEMPORAL, _KP + _D, _J) | results.SQL | layouts.SQL | robots.SQL | trees.SQL | suites.SQL | stored.sql(_TEMPORAL, _KP + _D) | samples.SQL | views.SQL | reports.SQL
