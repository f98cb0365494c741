"""Queries of trees of clips and of splits over orders and parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.sources import layout, tables

GLOBS = ["**/iter2/**", "c?/r1/**", "*/r2/g[01]/*/h0/**/pred.mp4"]


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, w, h, fps, n_frames): two files of most orders, every fifth below an iteration, some outside the tree."""
    o = tables.table(spark, d, "orders").where("o_orderkey % 13 <> 0")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    place = F.concat(F.lit("c"), k % 3, F.lit("/r"), c % 3, F.lit("/g"), c % 4, F.lit("/v"), k % 2, F.lit("/h"), F.length("o_orderpriority") % 2, F.lit("/"), F.when(k % 5 == 0, F.concat(F.lit("iter"), k % 3, F.lit("/"))).otherwise(""))
    both = o.select("o_orderkey", place.alias("place"), F.explode(F.when(k % 11 == 0, F.array(F.lit("gt"))).when(k % 17 == 0, F.array(F.lit("pred"))).otherwise(F.array(F.lit("pred"), F.lit("gt")))).alias("f"))
    k = F.col("o_orderkey")
    name = F.when(k % 19 == 0, F.concat(F.lit("lost/"), k)).otherwise(F.concat("place", F.lit("episode_"), k))
    return both.select(
        F.concat(name, F.lit("/"), "f", F.lit(".mp4")).alias("path"), (F.lit(640) + F.when(k % 7 == 0, 8).otherwise(0)).alias("w"), F.lit(480).alias("h"),
        F.when(k % 23 == 0, 12.0).otherwise(10.0).alias("fps"), (F.lit(50) + F.when((k % 29 == 0) & (F.col("f") == "gt"), 1).otherwise(0)).alias("n_frames"),
    )


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return layout.episodes(files(spark, d)).select("path", *layout.AXES, "iter", "episode", "file")


def kept(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where(~layout.excluded(F.col("path"), GLOBS)).select("path")


def problems(spark: SparkSession, d: str) -> DataFrame:
    specs = spark.createDataFrame([("g0", 640, 480, 10.0, True), ("g1", 640, 480, None, False), ("g2", 648, 480, 10.0, True)], "generator string, width int, height int, fps double, has_gt boolean")
    clips = layout.episodes(files(spark, d)).select(F.concat_ws("/", *layout.AXES).alias("cell"), "generator", "episode", F.regexp_replace("file", "[.]mp4$", "").alias("file"), "w", "h", "fps", "n_frames")
    return layout.problems(clips, specs)


def scene_split(spark: SparkSession, d: str) -> DataFrame:
    parts = tables.table(spark, d, "part").select(F.concat(F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("_"), F.col("p_size"), F.lit("_"), F.col("p_partkey")).alias("episode"))
    return layout.scene_split(parts).groupBy(layout.scene(F.col("episode")).alias("scene"), "split").agg(F.count("*").alias("n"))


QUERIES = {"layout_episodes": episodes, "layout_kept": kept, "layout_problems": problems, "scene_split": scene_split}

_F = """o AS (SELECT o_orderkey AS k, 'c' || o_orderkey % 3 AS cache, 'r' || o_custkey % 3 AS robot, 'g' || o_custkey % 4 AS generator, 'v' || o_orderkey % 2 AS view, 'h' || length(o_orderpriority) % 2 AS horizon, CASE WHEN o_orderkey % 5 = 0 THEN 'iter' || o_orderkey % 3 END AS iter FROM orders WHERE o_orderkey % 13 <> 0),
f AS (SELECT *, unnest(CASE WHEN k % 11 = 0 THEN ['gt'] WHEN k % 17 = 0 THEN ['pred'] ELSE ['pred', 'gt'] END) AS f FROM o),
t AS (SELECT *, CASE WHEN k % 19 = 0 THEN 'lost/' || k ELSE cache || '/' || robot || '/' || generator || '/' || view || '/' || horizon || '/' || coalesce(iter || '/', '') || 'episode_' || k END || '/' || f || '.mp4' AS path, 640 + CASE WHEN k % 7 = 0 THEN 8 ELSE 0 END AS w, 480 AS h, CASE WHEN k % 23 = 0 THEN 12.0 ELSE 10.0 END AS fps, 50 + CASE WHEN k % 29 = 0 AND f = 'gt' THEN 1 ELSE 0 END AS n FROM f)"""

SQL = {
    "layout_episodes": f"WITH {_F} SELECT path, cache, robot, generator, view, horizon, iter, 'episode_' || k AS episode, f || '.mp4' AS file FROM t WHERE k % 19 <> 0",
    "layout_kept": f"WITH {_F} SELECT path FROM t WHERE NOT (k % 19 <> 0 AND (coalesce(iter, '') = 'iter2' OR robot = 'r1' OR (robot = 'r2' AND generator IN ('g0', 'g1') AND horizon = 'h0' AND f = 'pred')))",
    "layout_problems": f"""WITH {_F}, sp(generator, width, height, fps, has_gt) AS (VALUES ('g0', 640, 480, 10.0, true), ('g1', 640, 480, NULL, false), ('g2', 648, 480, 10.0, true)),
e AS (SELECT cache || '/' || robot || '/' || generator || '/' || view || '/' || horizon || '/episode_' || k AS place, generator, max(w) FILTER (f = 'pred') AS pw, max(w) FILTER (f = 'gt') AS gw, max(fps) FILTER (f = 'pred') AS pf, max(n) FILTER (f = 'pred') AS pn, max(n) FILTER (f = 'gt') AS gn FROM t WHERE k % 19 <> 0 GROUP BY ALL),
j AS (SELECT e.*, sp.width, sp.fps AS sf, sp.has_gt FROM e LEFT JOIN sp ON e.generator = sp.generator)
SELECT place, 'generator unknown' AS problem FROM j WHERE has_gt IS NULL
UNION ALL SELECT place, 'pred: missing' FROM j WHERE has_gt IS NOT NULL AND pw IS NULL UNION ALL SELECT place, 'gt: missing' FROM j WHERE has_gt AND gw IS NULL
UNION ALL SELECT place, 'pred: size ' || pw || 'x480 is not ' || width || 'x480' FROM j WHERE pw <> width UNION ALL SELECT place, 'gt: size ' || gw || 'x480 is not ' || width || 'x480' FROM j WHERE gw <> width
UNION ALL SELECT place, 'pred: rate differs' FROM j WHERE abs(pf - sf) > 0.01 * greatest(pf, sf) UNION ALL SELECT place, 'frames differ' FROM j WHERE has_gt IS NOT NULL AND pn <> gn""",
    "scene_split": """WITH s AS (SELECT lower(replace(p_type, ' ', '_')) || '_' || p_size AS scene, count(*) AS n FROM part GROUP BY ALL),
u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, md5('0:' || scene) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, round(sum(n) OVER () * 0.15) AS most FROM s)
SELECT scene, CASE WHEN before + n <= most OR before = 0 THEN 'val' ELSE 'train' END AS split, n FROM u""",
}
