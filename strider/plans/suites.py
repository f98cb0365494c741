"""Queries of suites of metrics, with and without a robot, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strider.operators import metrics, suites
from strider.plans import robots
from strider.robots import kinematics
from strider.sources import tables

#: Of the arm: what SQL can say of all its metrics, and those of them that no rate changes.
ARM_KEYS = (*[k for k in suites.SUITES.get("invariant_v1").keys if k not in ("sparc", "penetration_mm", "self_collision_frac")], "rigidity_worst_bone_mm", "rigidity_residual_all_mm", "rigidity_wobble_all_mm")
ARM = suites.Suite("arm", ARM_KEYS, suites.SUITES.get("invariant_v1").invariant)
ARM_RATE_FREE = suites.Suite("arm_rate_free", tuple(k for k in ARM_KEYS if metrics.SPECS[k].dt_exponent == 0), ())


def arm_frames(spark: SparkSession, d: str) -> DataFrame:
    """(clip, t, q, aux, p, r, q_raw) of the arm: its joints are read as they are."""
    return kinematics.keypoints(robots.frames(spark, d), robots.arm(spark), keep=("q", "aux")).withColumn("q_raw", F.col("q"))


def _arm(spark: SparkSession, d: str) -> DataFrame:
    context = suites.Context.of(spark, robots.arm(spark), robots.DT)
    rows = suites.evaluate(arm_frames(spark, d), [ARM, ARM_RATE_FREE], context)
    return rows.withColumn("value", F.round("value", 5))


def short_clips(spark: SparkSession, d: str) -> DataFrame:
    """(clip, t, p): each three vectors with neighbouring ids a clip."""
    rows = tables.table(spark, d, "embeddings").where("embedding is not null").select(F.floor(F.col("vec_id") / 3).alias("clip"), "vec_id", F.slice("embedding", 1, 63).cast("array<double>").alias("p"))
    return rows.select("clip", F.row_number().over(Window.partitionBy("clip").orderBy("vec_id")).alias("t"), "p")


def _bare(spark: SparkSession, d: str) -> DataFrame:
    rows = suites.evaluate(short_clips(spark, d), [suites.SUITES.get("invariant_v1"), suites.SUITES.get("rate_free")], suites.Context(robots.DT))
    return rows.withColumn("value", F.round("value", 5))


QUERIES = {"suite_arm": _arm, "suite_bare": _bare}

_LAG = ", ".join(f"lag({c}, {n}) OVER w AS {c}{n}" for c in "xyz" for n in (1, 2, 3))
_NORM = lambda f: "sqrt(" + " + ".join(f"({f.format(c=c)})**2" for c in "xyz") + ")"
_D = f"""lagged AS (SELECT *, {_LAG} FROM pts WINDOW w AS (PARTITION BY clip, k ORDER BY t)),
d AS (SELECT *, {_NORM("{c}-{c}1")} AS d1, {_NORM("{c}-2*{c}1+{c}2")} AS d2, {_NORM("{c}-3*{c}1+3*{c}2-{c}3")} AS d3 FROM lagged),
fm AS (SELECT clip, t, max(d1) AS top, sum(d1*d1)/0.01*0.5 AS ke, CASE WHEN max(d1) IS NOT NULL THEN sum(z1) END AS h, {_NORM("sum({c}-2*{c}1+{c}2)")}/0.01 AS f FROM d GROUP BY clip, t),
m1 AS (SELECT clip, count(DISTINCT t) AS n, avg(d1)/0.1 AS mean_speed_mps, avg(d2)/0.01 AS mean_accel_mps2, max(d2)/0.01 AS max_accel_mps2, avg(d3)/0.001 AS mean_jerk_mps3, avg(CASE WHEN d2/0.01 > 5 THEN 1.0 WHEN d2 IS NOT NULL THEN 0.0 END) AS accel_violation_frac FROM d GROUP BY clip),
m2 AS (SELECT clip, stddev_samp(ke) AS kinetic_energy_tstd, stddev_samp(ke+9.81*h) AS total_energy_tstd, avg(f) AS momentum_dp_mean, avg(CASE WHEN top/0.1 > 2 THEN 1.0 WHEN top IS NOT NULL THEN 0.0 END) AS no_teleport_frac FROM fm GROUP BY clip)"""
_ID = lambda s: f"'sha256:' || substr(sha256('{s.name}|{','.join(s.keys)}|inv:{','.join(sorted(s.invariant))}'), 1, 16)"
_LINKS = "('column', 0), ('upper', 1), ('fore', 2), ('hand', 3), ('left_finger', 4), ('right_finger', 5)"
_Q = lambda n: [f"abs(q{k}-lag(q{k}) OVER w)/0.1" if n == 1 else f"abs(q{k}-2*lag(q{k}) OVER w+lag(q{k},2) OVER w)/0.01" for k in range(1, 6)]


def _long(keys: tuple[str, ...], source: str) -> str:
    return f"SELECT clip, unnest([{', '.join(repr(k) for k in keys)}]) AS metric, unnest([{', '.join(f'{k}::DOUBLE' for k in keys)}]) AS value FROM {source}"


_ARM_SQL = f"""WITH RECURSIVE {robots._POSES}, {robots._COM}, link(link, k) AS (VALUES {_LINKS}), pts AS (SELECT clip, t, k, x, y, z FROM pose JOIN link USING (link)), {_D},
o AS (SELECT clip, t, link, {robots._vee_sql("r{k}", "b{k}", "10.0")} FROM (SELECT *, {", ".join(f"lag(r{k}) OVER w AS b{k}" for k in range(9))} FROM pose JOIN link USING (link) WINDOW w AS (PARTITION BY clip, link ORDER BY t))),
oa AS (SELECT *, sqrt(o0**2+o1**2+o2**2) AS s, sqrt((o0-lag(o0) OVER w)**2+(o1-lag(o1) OVER w)**2+(o2-lag(o2) OVER w)**2)*10 AS a FROM o WINDOW w AS (PARTITION BY clip, link ORDER BY t)),
m3 AS (SELECT clip, avg(s) AS mean_angvel_radps, max(s) AS max_angvel_radps, avg(a) AS mean_angacc_radps2 FROM oa GROUP BY clip),
q AS (SELECT clip, t, v[1] AS q1, v[2] AS q2, v[3] AS q3, v[4] AS q4, v[5] AS q5 FROM fr),
ql AS (SELECT *, {", ".join(f"{x} AS v{k + 1}" for k, x in enumerate(_Q(1)))}, {", ".join(f"{x} AS a{k + 1}" for k, x in enumerate(_Q(2)))} FROM q WINDOW w AS (PARTITION BY clip ORDER BY t)),
qx AS (SELECT *, greatest(q1-0.4,0)+greatest(-0.4-q1,0)+greatest(q2-0.6,0)+greatest(-0.5-q2,0)+greatest(q3-0.6,0)+greatest(-0.6-q3,0)+greatest(q4-0.3,0)+greatest(-0.3-q4,0) AS x, least(0.4-q1,q1+0.4,0.6-q2,q2+0.5,0.6-q3,q3+0.6,0.3-q4,q4+0.3) AS room FROM ql),
m4 AS (SELECT clip, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS limit_violation_frac, avg(x) AS limit_excess_rad, avg(room) AS limit_headroom_rad, avg((v1+v2+v3+v4+v5)/5) AS mean_qdot_radps, avg((a1+a2+a3+a4+a5)/5) AS mean_qddot_radps2,
  avg(CASE WHEN v1 IS NOT NULL THEN ((v1>2)::INT+(v2>2)::INT+(v3>1000)::INT+(v4>1)::INT+(v5>5)::INT)/5.0 END) AS vel_violation_frac, avg(a1/80+a2/60+a3/30+a4/100+a5/10) AS effort_proxy FROM qx GROUP BY clip),
m5 AS (SELECT clip, -ln(((count(*)-1)*0.1)**5/sum(d1)**2*sum((d3/0.001)**2*0.1)) AS log_dimensionless_jerk FROM d WHERE k = 3 GROUP BY clip),
m6 AS (SELECT clip, avg(least(x+0.12, 0.12-x, y+0.32, 0.32-y)) AS com_margin_m FROM com GROUP BY clip),
bone(b, rest) AS (VALUES (0, sqrt(0.1)), (1, sqrt(0.1625)), (2, sqrt(0.0904)), (3, 0.1), (4, 0.0)),
bl AS (SELECT p.clip, p.t, b, rest, sqrt((p.x-n.x)**2+(p.y-n.y)**2+(p.z-n.z)**2) AS l FROM bone JOIN pts p ON p.k = b JOIN pts n ON n.k = b + 1 AND n.clip = p.clip AND n.t = p.t),
bm AS (SELECT clip, b, avg(abs(l-rest))*1000 AS r, stddev_pop(l)*1000 AS s, quantile_disc(l, 0.5) AS m FROM bl GROUP BY ALL),
m7 AS (SELECT clip, avg(r) FILTER (b < 3) AS rigidity_residual_mm, avg(s) FILTER (b < 3) AS rigidity_wobble_mm, avg(r) AS rigidity_residual_all_mm, avg(s) AS rigidity_wobble_all_mm FROM bm GROUP BY clip),
m8 AS (SELECT clip, avg(x)*1000 AS rigidity_worst_bone_mm FROM (SELECT clip, t, max(abs(l-m)) AS x FROM bl JOIN bm USING (clip, b) WHERE b < 3 GROUP BY clip, t) GROUP BY clip),
whole AS (SELECT * FROM m1 JOIN m2 USING (clip) JOIN m3 USING (clip) JOIN m4 USING (clip) JOIN m5 USING (clip) JOIN m6 USING (clip) JOIN m7 USING (clip) JOIN m8 USING (clip)),
lo AS ({_long(ARM.keys, "whole")})
SELECT clip, 'arm' AS suite, {_ID(ARM)} AS suite_id, metric, round(value,5) AS value, NULL::VARCHAR AS reason FROM lo
UNION ALL SELECT clip, 'arm_rate_free', {_ID(ARM_RATE_FREE)}, metric, round(value,5), NULL FROM lo WHERE metric IN ({', '.join(repr(k) for k in ARM_RATE_FREE.keys)})""".replace("lo AS (SELECT clip, unnest", "lv AS (SELECT clip, unnest").replace("FROM lo\nUNION", "FROM lv\nUNION").replace("FROM lo WHERE", "FROM lv WHERE")

_GIVEN = ("mean_speed_mps", "mean_accel_mps2", "max_accel_mps2", "mean_jerk_mps3", "accel_violation_frac", "kinetic_energy_tstd", "total_energy_tstd", "momentum_dp_mean", "no_teleport_frac")
_RULES = ", ".join(
    f"('{k}', {least}, {missing}, {after})"
    for keys, missing, after in (
        (_GIVEN, "NULL", "NULL"), (("rigidity_residual_mm", "rigidity_wobble_mm", "sparc", "log_dimensionless_jerk"), "NULL", "'missing_input:robot'"),
        (("mean_angvel_radps", "max_angvel_radps", "mean_angacc_radps2"), "'missing_input:R'", "NULL"), (("limit_violation_frac", "limit_excess_rad"), "'missing_input:q_raw'", "NULL"),
        (("limit_headroom_rad", "mean_qdot_radps", "mean_qddot_radps2", "vel_violation_frac", "effort_proxy"), "'missing_input:q'", "NULL"), (("penetration_mm", "self_collision_frac"), "'missing_input:colliders,q'", "NULL"), (("com_margin_m",), "'missing_input:q,support_polygon'", "NULL"),
    )
    for k in keys
    for least in [{"rigidity_residual_mm": 1, "mean_speed_mps": 2, "rigidity_wobble_mm": 2, "no_teleport_frac": 2, "mean_jerk_mps3": 4, "sparc": 8, "log_dimensionless_jerk": 8}.get(k, 3)]
)
_FREE = suites.SUITES.get("rate_free")
SQL = {
    "suite_arm": _ARM_SQL,
    "suite_bare": f"""WITH kp AS (SELECT vec_id // 3 AS clip, row_number() OVER (PARTITION BY vec_id // 3 ORDER BY vec_id) AS t, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
pts AS (SELECT clip, t, k, e[3*k+1] AS x, e[3*k+2] AS y, e[3*k+3] AS z FROM kp, range(21) r(k)), {_D}, whole AS (SELECT * FROM m1 JOIN m2 USING (clip)), lv AS ({_long(_GIVEN, "whole")}),
ru(metric, least, missing, after) AS (VALUES {_RULES}), j AS (SELECT m1.clip, m1.n, ru.*, lv.value FROM m1 CROSS JOIN ru LEFT JOIN lv ON lv.clip = m1.clip AND lv.metric = ru.metric),
re AS (SELECT *, coalesce(missing, CASE WHEN n < least THEN 'too_few_frames:' || n || '<' || least END, after) AS reason FROM j)
SELECT clip, 'invariant_v1' AS suite, {_ID(suites.SUITES.get("invariant_v1"))} AS suite_id, metric, CASE WHEN reason IS NULL THEN round(value,5) END AS value, reason FROM re
UNION ALL SELECT clip, 'rate_free', {_ID(_FREE)}, metric, CASE WHEN reason IS NULL THEN round(value,5) END, reason FROM re WHERE metric IN ({', '.join(repr(k) for k in _FREE.keys)})""",
}
