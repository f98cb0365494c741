"""Queries of camera layouts and clip specs over parts as frames and orders as clips, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators import resample
from strider.sources import tables, views

LAYOUTS = [
    ("one", 1, None, 196, "height", None, None), ("stack", 3, ["a", "b", "c"], 64, "height", None, None), ("row", 2, ["a", "b"], None, "width", None, None),
    ("grid", 4, None, 16, "grid2x2", None, None), ("some", 2, ["a", "c"], 64, "width", 3, [2, 0]), ("bad", 2, None, None, "height", 3, None), ("lost", 2, None, None, "width", 2, [0, 2]),
]
NAMES = [x[0] for x in LAYOUTS]
TARGET = 5.0


def layouts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAYOUTS, views.LAYOUT)


def frames(spark: SparkSession, d: str) -> DataFrame:
    """(clip, layout, width, height, n_tokens): each part a clip, every eighth of a layout that nobody declared."""
    k, s = F.col("p_partkey").cast("long"), F.col("p_size").cast("int")
    named = F.get(F.array(*map(F.lit, [*NAMES, "unknown"])), (k % 8).cast("int"))
    return tables.table(spark, d, "part").select(k.alias("clip"), named.alias("layout"), (s * 12 + 32 * (k % 5)).cast("int").alias("width"), (F.lit(60) * (k % 7 + 1)).cast("int").alias("height"), (F.lit(16) * (k % 13)).cast("int").alias("n_tokens"))


def fits(spark: SparkSession, d: str) -> DataFrame:
    return views.fits(frames(spark, d).drop("n_tokens"), layouts(spark))


def crops(spark: SparkSession, d: str) -> DataFrame:
    return views.crops(frames(spark, d).select("clip", "layout", "width", "height"), layouts(spark))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return views.token_problems(frames(spark, d).select("clip", "layout", "n_tokens"), layouts(spark))


def specs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as clips whose rates, frame times and numbers of frames follow their keys, some of them wrong."""
    o = tables.table(spark, d, "orders")
    k = F.col("o_orderkey").cast("long")
    fps = F.when(k % 17 == 0, 0.0).when(k % 19 != 0, (k % 6 + 1) * 2.5)
    dt = F.when(k % 19 == 0, 0.25).when(k % 23 == 0, 30.0)
    told = o.select(k.alias("path"), fps.cast("double").alias("fps"), dt.cast("double").alias("dt"), (F.col("o_custkey") % 90).cast("long").alias("n_frames"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.lit("one").alias("layout"), F.lit("table").alias("dt_source"))
    return views.specs(told)


def clip_specs(spark: SparkSession, d: str) -> DataFrame:
    """Each clip's spec, and what it is once it keeps every so many frames to come to ``TARGET`` a second where a whole factor does."""
    own = specs(spark, d)
    sound = F.col("problem").isNull()
    plan = F.when(sound, resample.plan(F.when(sound, F.col("fps")).otherwise(1.0), TARGET))
    new = views.subsampled(own.withColumn("factor", plan["factor"]), F.col("factor"))
    return new.select("path", F.round("fps", 5).alias("fps"), F.round("dt", 5).alias("dt"), "n_frames", F.col("stride").cast("int").alias("stride"), F.round("duration_s", 5).alias("duration_s"), "problem")


def records(spark: SparkSession, d: str) -> DataFrame:
    rows = views.records(specs(spark, d), layouts(spark))
    return rows.select("path", F.round("fps", 5).alias("fps"), F.round("dt", 5).alias("dt"), "n_frames", "width", "height", "dt_source", "view_layout", "stride", "codec", "sha1")


QUERIES = {"view_fits": fits, "view_crops": crops, "view_tokens": tokens, "clip_specs": clip_specs, "clip_records": records}

_KEYS = ("1x196:unnamed", "3x64:a+b+c", "2x?:a+b:width:2p:0,1", "4x16:unnamed:grid2x2:4p:0,1,2,3", "2x64:a+c:width:3p:2,0", "2x?:unnamed:height:3p:0,1,2", "2x?:unnamed:width:2p:0,2")
_DOWN, _ACROSS, _COUNT = (1, 3, 1, 2, 1, 3, 1), (1, 1, 2, 2, 3, 1, 2), (1, 3, 2, 4, 3, 3, 2)
_INDICES = ("[0]", "[0,1,2]", "[0,1]", "[0,1,2,3]", "[2,0]", "[0,1,2]", "[0,2]")
_text = lambda x: "NULL" if x is None else f"'{x}'"
_VALUES = ", ".join(
    f"('{x[0]}', {x[1]}, {x[3] or 'NULL'}, '{x[4]}', '{key}', {down}, {across}, {count}, {at}, {x[2] or 'NULL::VARCHAR[]'}, {_text(bad)})"
    for x, key, down, across, count, at, bad in zip(LAYOUTS, _KEYS, _DOWN, _ACROSS, _COUNT, _INDICES, (None, None, None, None, None, "panels are not chosen", "no such panel"), strict=True)
)
_F = f"""lay(layout, n, tpv, how, layout_key, down, across, cnt, idx, names, bad) AS (VALUES {_VALUES}),
fr AS (SELECT p_partkey::BIGINT AS clip, {[*NAMES, "unknown"]}[p_partkey % 8 + 1] AS layout, (p_size * 12 + 32 * (p_partkey % 5))::INT AS width, (60 * (p_partkey % 7 + 1))::INT AS height, (16 * (p_partkey % 13))::INT AS n_tokens FROM part),
g AS (SELECT fr.*, lay.* EXCLUDE (layout), height // down AS ph, width // across AS pw FROM fr LEFT JOIN lay USING (layout)),
ft AS (SELECT *, CASE WHEN n IS NULL THEN 'no layout ' || layout WHEN bad IS NOT NULL THEN bad WHEN width < 1 OR height < 1 THEN 'no size' WHEN height % down <> 0 THEN 'height ' || height || ' is not ' || down || ' panels'
  WHEN width % across <> 0 THEN 'width ' || width || ' is not ' || across || ' panels' WHEN cnt > 1 AND (pw / ph < 0.2 OR pw / ph > 5) THEN 'no camera''s shape: ' || pw || 'x' || ph END AS problem FROM g)"""
_C = """c AS (SELECT o_orderkey::BIGINT AS path, CASE WHEN o_orderkey % 17 = 0 THEN 0.0 WHEN o_orderkey % 19 <> 0 THEN (o_orderkey % 6 + 1) * 2.5 END::DOUBLE AS f, CASE WHEN o_orderkey % 19 = 0 THEN 0.25 WHEN o_orderkey % 23 = 0 THEN 30.0 END::DOUBLE AS d, (o_custkey % 90)::BIGINT AS n FROM orders),
b AS (SELECT path, n, coalesce(f, 1 / d) AS fps, coalesce(d, CASE WHEN f <> 0 THEN 1 / f END) AS dt FROM c),
s AS (SELECT *, CASE WHEN fps <= 0 THEN 'fps is no rate' WHEN dt > 10 THEN 'dt is a rate?' WHEN abs(dt * fps - 1) > 1e-6 THEN 'dt and fps disagree' END AS problem FROM b)"""

SQL = {
    "view_fits": f"""WITH {_F} SELECT clip, layout, width, height, layout_key, CASE WHEN problem IS NULL THEN ph::INT END AS panel_height, CASE WHEN problem IS NULL THEN pw::INT END AS panel_width,
  CASE WHEN problem IS NULL AND layout IN ('one', 'stack') THEN ph::INT END AS view_height, problem FROM ft""",
    "view_crops": f"""WITH {_F}, x AS (SELECT *, unnest(idx) AS panel, unnest(range(len(idx))) AS v FROM ft WHERE problem IS NULL),
y AS (SELECT *, CASE how WHEN 'height' THEN panel WHEN 'grid2x2' THEN panel // 2 ELSE 0 END AS r, CASE how WHEN 'width' THEN panel WHEN 'grid2x2' THEN panel % 2 ELSE 0 END AS q FROM x)
SELECT clip, layout, width, height, v::INT AS "view", names[v + 1] AS name, panel::INT AS panel, (r * ph)::INT AS top, (r * ph + ph)::INT AS bottom, (q * pw)::INT AS "left", (q * pw + pw)::INT AS "right" FROM y""",
    "view_tokens": f"""WITH {_F} SELECT clip, layout, n_tokens, CASE WHEN n IS NULL THEN 'no layout ' || layout WHEN bad IS NOT NULL THEN bad WHEN tpv IS NULL AND n_tokens % n <> 0 THEN n_tokens || ' tokens are no multiple of ' || n
  WHEN n_tokens <> n * tpv THEN n_tokens || ' tokens, not ' || n * tpv END AS problem FROM g""",
    "clip_specs": f"""WITH {_C}, k AS (SELECT *, CASE WHEN problem IS NULL AND fps > {TARGET} AND fps % {TARGET} = 0 THEN (fps / {TARGET})::INT ELSE 1 END AS k FROM s)
SELECT path, round(fps / k, 5) AS fps, round(dt * k, 5) AS dt, ceil(n / k)::BIGINT AS n_frames, k::INT AS stride, CASE WHEN problem IS NULL THEN round(ceil(n / k) * dt * k, 5) END AS duration_s, problem FROM k""",
    "clip_records": f"""WITH {_C} SELECT path, round(fps, 5) AS fps, round(dt, 5) AS dt, n AS n_frames, 640 AS width, 480 AS height, 'table' AS dt_source, '1x196:unnamed' AS view_layout, 1 AS stride, NULL::VARCHAR AS codec, NULL::VARCHAR AS sha1 FROM s WHERE problem IS NULL""",
}
