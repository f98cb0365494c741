"""Queries of the stored reference and of configured cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators import fingerprint, suites
from strider.plans import motion
from strider.sources import config, manifest, tables
from strider.sources.shared import new_path

KEYS = ("mean_speed_mps", "mean_accel_mps2", "max_accel_mps2", "mean_jerk_mps3", "accel_violation_frac", "no_teleport_frac")
SUITE = suites.Suite("temporal", KEYS)


def _reference(spark: SparkSession, d: str) -> tuple[DataFrame, fingerprint.Reference]:
    """Terms of all clips, and the reference of those of even label, written and read again."""
    terms = motion.terms(spark, d)
    even = F.col("clip") % 2 == 0
    path = new_path(spark, "reference")
    fingerprint.save(spark, fingerprint.build(terms.where(even), motion.samples(spark, d).where(even), SUITE, motion.DT), path)
    return terms, fingerprint.load(spark, path, motion.DT)


def stored(spark: SparkSession, d: str) -> DataFrame:
    _, ref = _reference(spark, d)
    rows = fingerprint.rows(spark, ref).where("kind in ('base', 'floor', 'quantile', 'mean')")
    return rows.select("kind", "key", "i", F.round("value", 4).alias("value"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all clips against the stored reference, and as older results have them."""
    terms, ref = _reference(spark, d)
    new, old = fingerprint.scores(terms, ref, motion.DT), fingerprint.older_scores(terms, ref).select(F.col("clip").alias("of"), F.round("score", 5).alias("older"))
    return new.join(old, F.col("clip") == F.col("of")).select("clip", "n_terms", F.round("score", 5).alias("score"), "older", "rate_mismatch")


# What a configuration says of cells of region, nation and brand: rates by brand and nation, and an iteration.
RATES = {"Brand#1": 10, "Brand#2": {"FRANCE": 16, "default": 24}, "Brand#3": {"FRANCE": {"EUROPE": 12}, "PERU": 9}}
ITERS = {"FRANCE": {"EUROPE": "iter_1", "default": "iter_2"}, "default": "iter_0"}
NA = [{"view": "ASIA"}, {"robot": "FRANCE", "view": "EUROPE"}]


def cells(spark: SparkSession, d: str) -> DataFrame:
    axes = [tables.table(spark, d, "region").select(F.col("r_name").alias("view")), tables.table(spark, d, "nation").select(F.col("n_name").alias("robot")), tables.table(spark, d, "part").select(F.col("p_brand").alias("generator")).distinct()]
    return manifest.cells(axes, NA)


def configured(spark: SparkSession, d: str) -> DataFrame:
    by_rate, by_iter = ("generator", "robot", "view"), ("robot", "view")
    rate = config.rule_table(spark, config.rules(RATES, by_rate, (int, float), "rates", "default"), by_rate, "double")
    turn = config.rule_table(spark, config.rules(ITERS, by_iter, str, "iters", "default"), by_iter, "string")
    claims = spark.createDataFrame([("FRANCE", "arm", "Brand#1"), ("FRANCE", "arm", "Brand#2"), ("PERU", "leg", "Brand#3")], "robot string, embodiment string, generator string")
    rows = config.resolved(config.resolved(cells(spark, d), rate, by_rate, "fps"), turn, by_iter, "iter")
    return config.embodiments(rows, claims).withColumn("unresolved", F.col("fps").isNull() & ~F.col("na"))


QUERIES = {"reference_stored": stored, "reference_scores": scored, "config_cells": configured}


def sql(temporal: str, points: str) -> dict[str, str]:
    terms = f"""{temporal}, u AS (SELECT clip, unnest([{", ".join(repr(k) for k in KEYS)}]) AS metric, unnest([2,3,3,4,3,2]) AS least, unnest([{", ".join(KEYS)}]) AS v, n_frames FROM m LEFT JOIN tp USING (clip)),
terms AS (SELECT clip, metric, CASE WHEN n_frames >= least THEN v END AS value FROM u), ev AS (SELECT * FROM terms WHERE clip % 2 = 0),
b0 AS (SELECT metric, median(value) AS base FROM ev GROUP BY metric), b AS (SELECT metric, any_value(base) AS base, greatest(median(abs(value - base)), 0.001) AS floor FROM ev JOIN b0 USING (metric) GROUP BY metric)"""
    at = ", ".join(f"({i}, {i / 99!r})" for i in range(100))
    place = "CASE metric " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KEYS)) + " END"
    return {
        "reference_stored": f"""WITH {terms}, s AS (SELECT clip, 'speed' AS quantity, d1 / 0.1 AS value FROM d WHERE d1 IS NOT NULL UNION ALL SELECT clip, 'height', sum(z) FROM pts GROUP BY clip, t), e AS (SELECT * FROM s WHERE clip % 2 = 0),
q(i, p) AS (VALUES {at}), x AS (SELECT quantity, unnest(quantile_cont(value, [{", ".join(repr(i / 99) for i in range(100))}])) AS value, generate_subscripts(quantile_cont(value, [{", ".join(repr(i / 99) for i in range(100))}]), 1) - 1 AS i FROM e GROUP BY quantity),
f AS (SELECT clip, quantity, avg(value) AS m, stddev_pop(value) AS s FROM e GROUP BY clip, quantity)
SELECT 'base' AS kind, metric AS key, {place}::INT AS i, round(base, 4) AS value FROM b UNION ALL SELECT 'floor', metric, {place}::INT, round(floor, 4) FROM b
UNION ALL SELECT 'quantile', quantity, i::INT, round(value, 4) FROM x UNION ALL SELECT 'mean', '', CASE quantity WHEN 'height' THEN 0 ELSE 2 END::INT, round(avg(m), 4) FROM f GROUP BY quantity UNION ALL SELECT 'mean', '', CASE quantity WHEN 'height' THEN 1 ELSE 3 END::INT, round(avg(s), 4) FROM f GROUP BY quantity""",
        "reference_scores": f"""WITH {terms}, s AS (SELECT clip, value, least(greatest(CASE WHEN metric LIKE '%\\_frac' ESCAPE '\\' THEN (value - base) / 0.1 ELSE (value - base) / (greatest(base, floor) * 2) END, 0), 1) AS s, least(greatest(CASE WHEN metric LIKE '%\\_frac' ESCAPE '\\' THEN (value - base) / 0.1 ELSE (value - base) / (base * 2 + 1e-8) END, 0), 1) AS o FROM terms JOIN b USING (metric))
SELECT clip, count(value) AS n_terms, CASE WHEN count(*) = count(value) THEN round(avg(s), 5) END AS score, round(avg(o), 5) AS older, false AS rate_mismatch FROM s GROUP BY clip""",
        "config_cells": """WITH c AS (SELECT r_name AS view, n_name AS robot, p_brand AS generator, (r_name = 'ASIA' OR (n_name = 'FRANCE' AND r_name = 'EUROPE')) AS na FROM region, nation, (SELECT DISTINCT p_brand FROM part)),
r AS (SELECT *, CASE WHEN generator = 'Brand#1' THEN 10.0 WHEN generator = 'Brand#2' THEN CASE WHEN robot = 'FRANCE' THEN 16.0 ELSE 24.0 END WHEN generator = 'Brand#3' THEN CASE WHEN robot = 'FRANCE' AND view = 'EUROPE' THEN 12.0 WHEN robot = 'PERU' THEN 9.0 END END::DOUBLE AS fps,
  CASE WHEN robot = 'FRANCE' THEN CASE WHEN view = 'EUROPE' THEN 'iter_1' ELSE 'iter_2' END ELSE 'iter_0' END AS iter, CASE robot WHEN 'FRANCE' THEN 'arm' WHEN 'PERU' THEN 'leg' END AS embodiment FROM c)
SELECT *, coalesce((robot = 'FRANCE' AND generator IN ('Brand#1', 'Brand#2')) OR (robot = 'PERU' AND generator = 'Brand#3'), false) AS claimed, fps IS NULL AND NOT na AS unresolved FROM r""",
    }
