"""Queries of the results store and of export over orders as clips and their lines as measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators import export
from strider.sources import results, tables

ROOT, READER = "/data", "reader-1"
METRICS = ("cost", "discount", "late")


def clips(spark: SparkSession, d: str) -> DataFrame:
    """A manifest: each order a clip below ``ROOT``, a seventh of them in a place that names no group."""
    o = tables.table(spark, d, "orders")
    group = F.concat(F.lit("video_gen_physics/"), F.lower("o_orderstatus"), F.lit("/e"), F.col("o_custkey") % 3, F.lit("/output/v"), F.col("o_orderkey") % 2, F.lit("/g"), F.col("o_custkey") % 4, F.lit("/h"), F.length("o_orderpriority"), F.lit("/"))
    place = F.when(F.col("o_orderkey") % 7 == 0, "other/place/").otherwise(group)
    return o.select(
        F.concat(F.lit(ROOT + "/"), place, F.col("o_orderkey"), F.lit(".mp4")).alias("path"), F.concat(F.lit("ep"), F.col("o_orderkey")).alias("episode"), F.when(F.col("o_orderkey") % 2 == 0, "gt").otherwise("pred").alias("role"),
        (F.col("o_custkey") % 4 + 1).cast("double").alias("fps_probed"), F.lit("h264").alias("codec"), F.col("o_orderkey").alias("key"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Results of the clips that have lines: measures of the lines, or, of each eleventh clip, a failure."""
    lines = tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_extendedprice").alias("cost"), F.min(F.when(F.col("l_discount") > 0.03, F.col("l_discount"))).alias("discount"), F.count_if(F.col("l_returnflag") == "N").cast("double").alias("late")
    )
    known = clips(spark, d).join(lines, F.col("key") == F.col("l_orderkey"))
    run = {"robot": "arm", "reader_id": READER, "limit_semantics": "hard", "suite_id": "sha256:1", "suite_name": "s"}
    fine = known.where("key % 11 <> 0")
    lack = F.map_filter(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.when(F.col(m).isNull(), "degenerate_input:non_finite_result"))]), lambda k, v: v.isNotNull())
    ok = fine.select(
        F.lit(1).alias("schema_version"), F.lit("ok").alias("status"), F.struct("path", F.lit(None).cast("string").alias("episode"), F.lit(None).cast("string").alias("role"), F.lit(0.1).alias("dt")).alias("clip"),
        F.struct(*[F.lit(v).alias(k) for k, v in run.items()]).alias("run"), F.struct(F.lit(10).alias("n_frames_scored"), F.lit(1.0).alias("gate_coverage")).alias("coverage"),
        F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))]).alias("metrics"), lack.alias("metrics_unavailable"),
    )
    broken = results.failed(known.where("key % 11 = 0").select("path", "episode", "role", F.lit(0.1).alias("dt")), run, list(METRICS), "error:Decode")
    return results.conformed(ok).unionByName(results.conformed(broken))


def flat(spark: SparkSession, d: str) -> DataFrame:
    return results.flatten(scored(spark, d)).select("clip_path", "status", "run_suite_id", "coverage_n_frames_scored", F.col("metrics")["cost"].alias("metrics_cost"))


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    return results.metric_rows(scored(spark, d)).select("path", "metric", "value", "reason")


def resume(spark: SparkSession, d: str) -> DataFrame:
    return results.unscored(clips(spark, d), scored(spark, d), "sha256:1", READER).select("path")


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    return results.key_sets(scored(spark, d))


def joined_scores(spark: SparkSession, d: str) -> DataFrame:
    return results.scores(clips(spark, d), scored(spark, d)).select("episode", "role", "metric", "value")


def rows(spark: SparkSession, d: str) -> DataFrame:
    return export.clip_rows(scored(spark, d), clips(spark, d), ROOT, "no reader")


def clip_rows(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).select("group", "path", "episode", "role", "fps_probed", "dt", "codec", "suite_id", "status", "failure_reason", F.col("metrics")["cost"].alias("cost"))


def worst_first(spark: SparkSession, d: str) -> DataFrame:
    return export.worst_first(rows(spark, d), "discount", "higher_better").select("group", "path", "place")


def summary(spark: SparkSession, d: str) -> DataFrame:
    own = export.summary(rows(spark, d), list(METRICS))
    return own.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in own.dtypes])


QUERIES = {
    "results_flatten": flat, "results_metric_rows": metric_rows, "results_resume": resume, "results_key_sets": key_sets, "results_scores": joined_scores,
    "export_clip_rows": clip_rows, "export_worst_first": worst_first, "export_summary": summary,
}

_R = """c AS (SELECT o_orderkey AS key, '/data/' || CASE WHEN o_orderkey % 7 = 0 THEN 'other/place/' ELSE 'video_gen_physics/' || lower(o_orderstatus) || '/e' || o_custkey % 3 || '/output/v' || o_orderkey % 2 || '/g' || o_custkey % 4 || '/h' || length(o_orderpriority) || '/' END || o_orderkey || '.mp4' AS path,
  CASE WHEN o_orderkey % 7 = 0 THEN '_unmatched/other/place' ELSE lower(o_orderstatus) || '/e' || o_custkey % 3 || '/v' || o_orderkey % 2 || '/g' || o_custkey % 4 || '/h' || length(o_orderpriority) END AS "group",
  'ep' || o_orderkey AS episode, CASE WHEN o_orderkey % 2 = 0 THEN 'gt' ELSE 'pred' END AS role, (o_custkey % 4 + 1)::DOUBLE AS fps_probed FROM orders),
l AS (SELECT l_orderkey, max(l_extendedprice) AS cost, min(l_discount) FILTER (l_discount > 0.03) AS discount, (count(*) FILTER (l_returnflag = 'N'))::DOUBLE AS late FROM lineitem GROUP BY l_orderkey),
r AS (SELECT c.*, CASE WHEN key % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN key % 11 <> 0 THEN cost END AS cost, CASE WHEN key % 11 <> 0 THEN discount END AS discount, CASE WHEN key % 11 <> 0 THEN late END AS late FROM c JOIN l ON key = l_orderkey),
u AS (SELECT path, episode, role, status, unnest(['cost', 'discount', 'late']) AS metric, unnest([cost, discount, late]) AS value FROM r),
a AS (SELECT c.*, coalesce(r.status, 'skipped') AS status, cost, discount, late FROM c LEFT JOIN r USING (key))"""

SQL = {
    "results_flatten": f"WITH {_R} SELECT path AS clip_path, status, 'sha256:1' AS run_suite_id, CASE WHEN status = 'ok' THEN 10 ELSE 0 END AS coverage_n_frames_scored, cost AS metrics_cost FROM r",
    "results_metric_rows": f"WITH {_R} SELECT path, metric, value, CASE WHEN status = 'failed' THEN 'error:Decode' WHEN value IS NULL THEN 'degenerate_input:non_finite_result' END AS reason FROM u",
    "results_resume": f"WITH {_R} SELECT path FROM c WHERE key NOT IN (SELECT l_orderkey FROM lineitem)",
    "results_key_sets": f"WITH {_R} SELECT 'sha256:1' AS suite_id, 'cost,discount,late' AS metrics, count(*) AS n FROM r",
    "results_scores": f"WITH {_R} SELECT episode, role, metric, value FROM u",
    "export_clip_rows": f"""WITH {_R} SELECT "group", substr(path, 7) AS path, episode, role, fps_probed, CASE WHEN status <> 'skipped' THEN 0.1::DOUBLE END AS dt, 'h264' AS codec, CASE WHEN status = 'skipped' THEN '' ELSE 'sha256:1' END AS suite_id, status,
  CASE status WHEN 'failed' THEN 'error:Decode' WHEN 'skipped' THEN 'no reader' ELSE '' END AS failure_reason, cost FROM a""",
    "export_worst_first": f"""WITH {_R} SELECT "group", substr(path, 7) AS path, row_number() OVER (PARTITION BY "group" ORDER BY discount IS NULL, discount, path) - 1 AS place FROM a""",
    "export_summary": f"""WITH {_R} SELECT "group", count(*) AS n_clips, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped,
  CASE WHEN bool_or(status <> 'skipped') THEN 'arm' ELSE '' END AS robot, CASE WHEN bool_or(status <> 'skipped') THEN 'reader-1' ELSE '' END AS reader_id, CASE WHEN bool_or(status <> 'skipped') THEN 'sha256:1' ELSE '' END AS suite_id,
  CASE WHEN min(fps_probed) = max(fps_probed) THEN min(fps_probed) END AS fps, round(median(cost), 5) AS median_cost, round(median(discount), 5) AS median_discount, round(median(late), 5) AS median_late FROM a GROUP BY "group" """,
}
