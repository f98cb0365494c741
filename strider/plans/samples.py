"""Queries of training frames over events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strider.sources import samples, tables

DOWN, DRAWN, SEED = 3, 4, 7


def logs(spark: SparkSession, d: str) -> DataFrame:
    """(episode, row, q, kind): the events of each user with an even number as its log."""
    own = tables.table(spark, d, "events").where("user_id % 2 = 0")
    row = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return own.select(F.concat(F.lit("scene_"), F.col("user_id") % 23, F.lit("_"), F.col("user_id")).alias("episode"), row.alias("row"), F.round("value", 4).alias("q"), F.col("event_type").alias("kind"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(episode, frame): a video of each user that runs a little longer than its log."""
    n = tables.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit("scene_"), F.col("user_id") % 23, F.lit("_"), F.col("user_id")).alias("episode"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / DOWN).cast("int") + 2)).alias("frame"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return samples.split(frames(spark, d), logs(spark, d), DOWN)


def _drawn(spark: SparkSession, d: str) -> DataFrame:
    return samples.drawn(samples.joined(frames(spark, d), logs(spark, d), DOWN), "kind", DRAWN, SEED, ["episode", "frame"])


def _problems(spark: SparkSession, d: str) -> DataFrame:
    u = tables.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    k = F.col("user_id")
    return samples.problems(u.select(
        k.cast("string").alias("episode"), F.when(k % 17 == 0, "simulated").when(k % 19 != 0, "real").alias("joint_source"), F.when(k % 13 == 0, "multi").otherwise("single").alias("view_layout"),
        F.lit(256).alias("n_tokens"), F.when(k % 29 == 0, 384).otherwise(768).alias("embed_dim"), F.lit(7).alias("n_joints"), (k % 11 != 0).alias("has_gripper"),
    ))


QUERIES = {"split_frames": _split, "split_drawn": _drawn, "split_problems": _problems}

_ROWS = """lg AS (SELECT 'scene_' || user_id % 23 || '_' || user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row, round(value, 4) AS q, event_type AS kind FROM events WHERE user_id % 2 = 0),
vf AS (SELECT 'scene_' || user_id % 23 || '_' || user_id AS episode, unnest(range(0, count(*) // 3 + 3)) AS frame FROM events GROUP BY user_id),
en AS (SELECT episode, max(row) AS last FROM lg GROUP BY episode), jo AS (SELECT vf.episode, vf.frame::INT AS frame, lg.row::INT AS row, q, kind FROM vf JOIN en USING (episode) JOIN lg ON lg.episode = vf.episode AND lg.row = least(vf.frame * 3, last))"""
SQL = {
    "split_frames": f"""WITH {_ROWS}, sc AS (SELECT regexp_replace(episode, '[-_]?[0-9]+$', '') AS scene, count(*) AS n FROM en GROUP BY ALL),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, md5('0:' || scene) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, round(sum(n) OVER () * 0.15) AS most FROM sc)
SELECT jo.*, CASE WHEN before + n <= most OR before = 0 THEN 'val' ELSE 'train' END AS split FROM jo JOIN u ON u.scene = regexp_replace(jo.episode, '[-_]?[0-9]+$', '')""",
    "split_drawn": f"WITH {_ROWS} SELECT * FROM jo QUALIFY row_number() OVER (PARTITION BY kind ORDER BY md5('7|' || kind || '|' || episode || '|' || frame), episode, frame) <= 4",
    "split_problems": """WITH u AS (SELECT DISTINCT user_id AS k FROM events)
SELECT k::VARCHAR AS episode, 'joints are ' || CASE WHEN k % 17 = 0 THEN 'simulated' ELSE 'of no source' END AS problem FROM u WHERE k % 17 = 0 OR k % 19 = 0
UNION ALL SELECT k::VARCHAR, 'view_layout multi, not single' FROM u WHERE k % 13 = 0 UNION ALL SELECT k::VARCHAR, 'embed_dim 384, not 768' FROM u WHERE k % 29 = 0 UNION ALL SELECT k::VARCHAR, 'has_gripper false, not true' FROM u WHERE k % 11 = 0""",
}
