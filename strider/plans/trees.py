"""Queries of shipped trees and manifests over orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.sources import clips, layout, tables, trees
from strider.sources.shared import stored

_SIZE = {"width": 640, "height": 480, "n_views": 1, "fps_tolerant": False}
SPEC = {
    "generators": {
        "g0": {"shape": "episode_dir", "has_iter_level": False, "has_ground_truth": True, "fps": 10, "pred_filename": "full_pred.mp4", "gt_filename": "full_gt.mp4", **_SIZE},
        "g1": {"shape": "task_episode", "has_iter_level": True, "has_ground_truth": False, "fps_by_robot": {"r0": 16, "r2": 10}, "pred_glob": "episode_*.mp4", **_SIZE},
        "g2": {"shape": "flat_or_dir", "has_iter_level": True, "has_ground_truth": True, "fps": 10, "flat_pred_glob": "*_pred.mp4", "flat_gt_glob": "*_gt.mp4", "dir_pred_filename": "p.mp4", "dir_gt_filename": "g.mp4", **_SIZE},
    },
    "exclude_globs": ["tree/c1/e2", "**/iter_3*"],
}
ROBOTS = {"robots": {"r0": {"embodiment": "e0", "generators": ["g0", "g1"]}, "r1": {"embodiment": "e0", "generators": ["g2", "g1"]}, "r2": {"embodiment": "e1", "generators": ["g0", "g1"]}, "r3": {"embodiment": "e2", "generators": ["g0", "g1", "g2"]}}}
GENERATORS, EXCLUDE = trees.parse_spec(SPEC)
CLAIMS = trees.parse_robots(ROBOTS)
ROOT = "tree"


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path): the files of a shipped tree, one or two of each order, in the three shapes, some out of place."""
    o = tables.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    view = F.when(k % 31 == 0, "odd_view").when(k % 4 == 0, "single_view").otherwise("multiview")
    horizon = F.when(k % 37 == 0, "camera").when(F.length("o_orderpriority") % 2 == 0, "makovian").otherwise("non_makovian")
    base = F.format_string("tree/c%s/e%s/output/%s/g%s/%s/", k % 2, c % 3, view, k % 3, horizon)
    turn, bare = F.format_string("iter_%s0/", c % 5), k.cast("string")
    task = F.when(k % 13 == 0, "_debug/").when(k % 7 == 0, "").otherwise(F.format_string("task%s/", k % 2))
    whole = k % 11 != 0
    pair = lambda pred, gt: F.when(whole, F.array(pred, gt)).otherwise(F.array(pred))
    join = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    names = F.when(k % 3 == 0, pair(join("episode_", bare, "/full_pred.mp4"), join("episode_", bare, "/full_gt.mp4"))).when(k % 3 == 1, F.array(join(turn, task, "episode_", bare, ".mp4")))
    names = names.when(k % 2 == 0, pair(join(turn, bare, "_pred.mp4"), join(turn, bare, "_gt.mp4"))).otherwise(pair(join(turn, "episode_", bare, "/p.mp4"), join(turn, "episode_", bare, "/g.mp4")))
    return o.select(base.alias("base"), F.explode(names).alias("name")).select(F.concat("base", "name").alias("path"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return trees.found(files(spark, d), GENERATORS, CLAIMS, ROOT, EXCLUDE)


def unplaced(spark: SparkSession, d: str) -> DataFrame:
    """What is left to place once the files of cache c0 are."""
    plan = trees.placing(trees.episodes(found(spark, d)))
    return trees.unplaced(plan, plan.where(F.col("target").startswith("c0/")))


def problems(spark: SparkSession, d: str) -> DataFrame:
    return trees.problems(files(spark, d), GENERATORS, CLAIMS, ROOT)


def declared(spark: SparkSession, d: str) -> DataFrame:
    """Cells with the counts that files in or above their folders declare: the number of customers, and that of a priority's letters."""
    rows = stored(trees.cells(found(spark, d)), "cells")  # a row a cell, read by both files and their cells
    own = rows.select(trees.cell_dir(ROOT).alias("dir"), "generator", "n_episodes")
    info = own.where("generator = 'g0'").select(F.concat("dir", F.lit("/info.json")).alias("path"), F.format_string('{"total_episodes": %s}', F.col("n_episodes") + 3).alias("text"))
    above = own.where("generator = 'g1'").select(F.concat(F.regexp_replace("dir", "/[^/]*$", ""), F.lit("/all_summary.json")).alias("path"), F.lit('{"mean_psnr": 1.5, "n_episodes": 7}').alias("text"))
    return trees.declared(info.unionByName(above), rows, ROOT)


def discovered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed clips of whole episodes as a source tells them, and records of a probe: sizes and rates follow the number of the order, some records are broken."""
    pair = F.concat_ws("/", "cache", "generator", "episode")
    role = lambda r: F.struct(F.lit(r).alias("role"), F.col(f"{'pred' if r == 'pred' else 'gt'}_path").alias("path"))
    hint = F.when(F.col("generator") == "g1", 16.0).when(F.col("generator") == "g0", 10.0)
    told = rows.select(F.col("cache").alias("method"), F.col("generator").alias("family"), "episode", pair.alias("pair_key"), hint.alias("fps_hint"), F.lit("single").alias("view_layout"), F.inline(F.array(role("gt"), role("pred")))).where("path is not null")
    k = F.regexp_extract("path", r"([0-9]+)(?:_[a-z]+)?(?:/[a-z_]+)?[.]mp4$", 1).cast("long")
    rate = F.when(k % 43 == 0, "0/0").when(k % 41 == 0, "30000/1001").when(F.col("path").contains("/g1/"), "16/1").otherwise("10/1")
    record = F.format_string('{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "%s", "width": %s, "height": 480, "nb_frames": "%s", "r_frame_rate": "%s"}]}', F.when(k % 5 == 0, "hevc").otherwise("h264"), F.when(k % 47 == 0, 0).otherwise(640), k % 90 + 10, rate)
    return told, told.select("path", F.when(k % 53 == 0, "{").otherwise(record).alias("text")).distinct()


def manifest(spark: SparkSession, d: str) -> DataFrame:
    told, records = discovered(trees.episodes(found(spark, d)))
    rows = clips.build(told, clips.probes(records), cap=500)
    return rows.select("method", "family", "episode", "role", "path", "n_frames", F.round("fps", 5).alias("fps"), "w", "h", F.round("dt", 5).alias("dt"), "pair_key", F.round("fps_probed", 5).alias("fps_probed"), "dt_source", "codec", "view_layout")


def left_out(spark: SparkSession, d: str) -> DataFrame:
    told, records = discovered(trees.episodes(found(spark, d)))
    return clips.skipped(told, clips.probes(records))


def summary(spark: SparkSession, d: str) -> DataFrame:
    told, records = discovered(trees.episodes(found(spark, d)))
    return clips.pairing_summary(clips.build(told, clips.probes(records)))


def placed_problems(spark: SparkSession, d: str) -> DataFrame:
    """What the probes of placed clips say against the generators' sizes and each robot's rate."""
    own = trees.episodes(found(spark, d))
    _, records = discovered(own)
    rows = own.select("robot", "generator", F.concat_ws("/", *trees.PLACED).alias("cell"), "episode", F.inline(F.array(F.struct(F.lit("pred").alias("file"), F.col("pred_path").alias("path")), F.struct(F.lit("gt").alias("file"), F.col("gt_path").alias("path")))))
    seen = rows.where("path is not null").join(clips.probes(records).withColumnRenamed("fps_probed", "fps"), "path")
    return layout.problems(seen, trees.rates(spark, GENERATORS), by_robot=True)


QUERIES = {
    "tree_cells": lambda spark, d: trees.cells(found(spark, d)), "tree_episodes": lambda spark, d: trees.episodes(found(spark, d)), "tree_unplaced": unplaced, "tree_problems": problems, "tree_declared": declared,
    "manifest_build": manifest, "manifest_skipped": left_out, "manifest_pairing": summary, "tree_verify": placed_problems,
}

_FILES = """o AS (SELECT o_orderkey AS k, 'c' || o_orderkey % 2 AS cache, 'e' || o_custkey % 3 AS embodiment, CASE WHEN o_orderkey % 31 = 0 THEN 'odd_view' WHEN o_orderkey % 4 = 0 THEN 'single_view' ELSE 'multiview' END AS view,
  'g' || o_orderkey % 3 AS generator, CASE WHEN o_orderkey % 37 = 0 THEN 'camera' WHEN length(o_orderpriority) % 2 = 0 THEN 'makovian' ELSE 'non_makovian' END AS horizon, CASE WHEN o_orderkey % 3 > 0 THEN 'iter_' || o_custkey % 5 || '0' END AS iter FROM orders),
n AS (SELECT *, 'tree/' || cache || '/' || embodiment || '/output/' || view || '/' || generator || '/' || horizon || coalesce('/' || iter, '') AS dir,
  CASE WHEN k % 3 = 1 THEN CASE WHEN k % 13 = 0 THEN '_debug/' WHEN k % 7 = 0 THEN '' ELSE 'task' || k % 2 || '/' END END AS task FROM o),
p AS (SELECT n.*, r.robot, CASE WHEN k % 3 = 0 THEN 'episode_' || k WHEN k % 3 = 1 THEN task || 'episode_' || k WHEN k % 2 = 0 THEN 'flat:' || k ELSE 'dir:' || k END AS episode,
  dir || '/' || CASE WHEN k % 3 = 0 THEN 'episode_' || k || '/full_pred.mp4' WHEN k % 3 = 1 THEN task || 'episode_' || k || '.mp4' WHEN k % 2 = 0 THEN k || '_pred.mp4' ELSE 'episode_' || k || '/p.mp4' END AS pred_path,
  CASE WHEN k % 3 <> 1 AND k % 11 <> 0 THEN dir || '/' || CASE WHEN k % 3 = 0 THEN 'episode_' || k || '/full_gt.mp4' WHEN k % 2 = 0 THEN k || '_gt.mp4' ELSE 'episode_' || k || '/g.mp4' END END AS gt_path FROM n
  JOIN (VALUES ('r0','e0','g0'),('r0','e0','g1'),('r1','e0','g2'),('r2','e1','g0'),('r2','e1','g1'),('r3','e2','g0'),('r3','e2','g1'),('r3','e2','g2')) r(robot, embodiment, generator) USING (embodiment, generator)
  WHERE view <> 'odd_view' AND horizon <> 'camera' AND NOT (cache = 'c1' AND embodiment = 'e2') AND coalesce(iter, '') <> 'iter_30'),
w AS (SELECT *, NOT (generator = 'g1' AND task = '_debug/') AND (generator = 'g1' OR gt_path IS NOT NULL) AS whole FROM p),
it AS (SELECT cache, robot, view, generator, horizon, embodiment, iter, count(*) FILTER (whole) AS n_episodes, count(*) FILTER (NOT whole AND generator <> 'g1') AS n_skipped FROM w GROUP BY ALL),
ce AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY cache, robot, view, generator, horizon, embodiment ORDER BY n_episodes DESC, iter DESC) = 1),
ep AS (SELECT w.* FROM w JOIN ce ON w.cache = ce.cache AND w.robot = ce.robot AND w.view = ce.view AND w.generator = ce.generator AND w.horizon = ce.horizon AND w.embodiment = ce.embodiment AND w.iter IS NOT DISTINCT FROM ce.iter WHERE whole)"""
_TOLD = f"""{_FILES}, cl AS (SELECT robot, k, cache AS method, generator AS family, view, horizon, episode, unnest(['pred', 'gt']) AS role, unnest([pred_path, gt_path]) AS path, cache || '/' || generator || '/' || episode AS pair_key, CASE generator WHEN 'g1' THEN 16.0 WHEN 'g0' THEN 10.0 END::DOUBLE AS hint FROM ep),
pr AS (SELECT *, CASE WHEN k % 53 <> 0 THEN k % 90 + 10 END AS n_frames, CASE WHEN k % 53 = 0 OR k % 43 = 0 THEN NULL WHEN k % 41 = 0 THEN 30000.0/1001 WHEN family = 'g1' THEN 16.0 ELSE 10.0 END::DOUBLE AS probed, CASE WHEN k % 53 <> 0 THEN CASE WHEN k % 47 = 0 THEN 0 ELSE 640 END END AS w, CASE WHEN k % 53 <> 0 THEN 480 END AS h, CASE WHEN k % 53 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'hevc' ELSE 'h264' END END AS codec FROM cl WHERE path IS NOT NULL),
ju AS (SELECT *, CASE WHEN hint IS NULL THEN 'ffprobe' ELSE 'table' END AS dt_source, CASE WHEN n_frames IS NULL THEN 'not probed' WHEN w = 0 THEN 'unusable stream' WHEN probed IS NULL THEN CASE WHEN hint IS NULL THEN 'no rate' ELSE 'rate given but none probed' END WHEN abs(hint - probed) / probed > 0.01 THEN 'table says ' || printf('%.3f', hint) || ', probed ' || printf('%.3f', probed) END AS problem FROM pr)"""

SQL = {
    "tree_cells": f"WITH {_FILES} SELECT * FROM ce",
    "tree_episodes": f"WITH {_FILES} SELECT cache, robot, view, generator, horizon, embodiment, iter, episode, pred_path, gt_path FROM ep",
    "tree_unplaced": f"""WITH {_FILES}, t AS (SELECT cache || '/' || robot || '/' || view || '/' || generator || '/' || horizon || '/' || CASE WHEN starts_with(episode, 'episode_') THEN replace(episode, ':', '_') ELSE 'episode_' || replace(replace(episode, '/', '__'), ':', '_') END AS d, pred_path, gt_path FROM ep WHERE cache <> 'c0')
SELECT d || '/pred.mp4' AS target, pred_path AS source FROM t UNION ALL SELECT d || '/gt.mp4', gt_path FROM t WHERE gt_path IS NOT NULL""",
    "tree_problems": f"""WITH {_FILES} SELECT DISTINCT cache || '/' || embodiment || '/output/odd_view' AS place, 'view unknown' AS problem FROM n WHERE view = 'odd_view'
UNION ALL SELECT DISTINCT cache || '/' || embodiment || '/output/' || view || '/' || generator, 'no robot' FROM n WHERE view <> 'odd_view' AND embodiment = 'e1' AND generator = 'g2'""",
    "tree_declared": f"WITH {_FILES} SELECT *, CASE generator WHEN 'g0' THEN n_episodes + 3 WHEN 'g1' THEN 7 END AS n_declared FROM ce",
    "manifest_build": f"""WITH {_TOLD} SELECT method, family, episode, role, path, n_frames, round(coalesce(hint, probed),5) AS fps, w, h, round(1/coalesce(hint, probed),5) AS dt, pair_key, round(probed,5) AS fps_probed, dt_source, codec, 'single' AS view_layout FROM ju WHERE problem IS NULL QUALIFY row_number() OVER (PARTITION BY family ORDER BY path) <= 500""",
    "manifest_skipped": f"WITH {_TOLD} SELECT pair_key, path, problem FROM ju WHERE problem IS NOT NULL",
    "manifest_pairing": f"""WITH {_TOLD}, a AS (SELECT * FROM ju WHERE problem IS NULL), g AS (SELECT pair_key, min_by(codec || ' ' || w, path) FILTER (role = 'gt') AS g, min_by(codec || ' ' || w, path) FILTER (role = 'pred') AS p, min_by(1/coalesce(hint, probed), path) FILTER (role = 'gt') AS gd, min_by(1/coalesce(hint, probed), path) FILTER (role = 'pred') AS pd FROM a GROUP BY pair_key HAVING count(*) FILTER (role = 'gt') > 0 AND count(*) FILTER (role = 'pred') > 0),
m AS (SELECT count(*) AS n_pairs, count(*) FILTER (g <> p OR abs(gd - pd) > 0.01 * greatest(gd, pd)) AS n_mismatches FROM g) SELECT (SELECT count(*) FROM a) AS n_rows, (SELECT count(DISTINCT family) FROM a) AS n_families, n_pairs, n_mismatches, n_mismatches = 0 AS ok FROM m""",
    "tree_verify": f"""WITH {_TOLD}, s AS (SELECT *, method || '/' || robot || '/' || view || '/' || family || '/' || horizon || '/' || episode AS place, CASE WHEN family <> 'g1' THEN 10.0 WHEN robot = 'r0' THEN 16.0 WHEN robot = 'r2' THEN 10.0 END AS want, family <> 'g1' OR robot IN ('r0', 'r2') AS known FROM pr)
SELECT place, 'generator unknown' AS problem FROM s WHERE NOT known AND role = 'pred' UNION ALL SELECT place, 'pred: rate differs' FROM s WHERE role = 'pred' AND abs(probed - want) > 0.01 * greatest(probed, want)
UNION ALL SELECT place, role || ': size 0x480 is not 640x480' FROM s WHERE known AND w = 0""",
}
