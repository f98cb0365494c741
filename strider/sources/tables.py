"""Analogue inputs of the operators, made from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators import order

POINTS = 21
BONES = [(i, i + 1) for i in range(POINTS - 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` (clip, ...) with t from 1 on in the order ``by`` of a clip; rows are sorted in ranges, so no clip is one task's."""
    found = order.running_sums(rows.withColumn("__one", F.lit(1)), ["clip"], by, {"__before": "__one"})
    return found.withColumn("t", (F.col("__before") + 1).cast("int"))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, t, p): each label a clip, its vectors in order the frames, 63 components the 21 points."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    return _numbered(rows.select(F.col("label").alias("clip"), "vec_id", F.slice("embedding", 1, 3 * POINTS).cast("array<double>").alias("p")), ["vec_id"]).select("clip", "t", "p")


def numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, t, e): each label a clip, its vectors in order the frames, in doubles."""
    rows = table(spark, sf_dir, "embeddings").where("label is not null and embedding is not null")
    return _numbered(rows.select(F.col("label").alias("clip"), "vec_id", F.col("embedding").cast("array<double>").alias("e")), ["vec_id"]).select("clip", "t", "e")


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, t, q): each user a clip, the events in order the frames, value and ``k`` the two joints."""
    k = F.get_json_object("props", "$.k").cast("double") / 10
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), "ts", "event_id", F.array(F.coalesce(F.col("value") / 100, F.lit(0.0)), F.coalesce(k, F.lit(0.0))).alias("q"))
    return _numbered(rows, ["ts", "event_id"]).select("clip", "t", "q")


def scores(spark: SparkSession, sf_dir: str, measure: str = "l_extendedprice") -> DataFrame:
    """(method, episode, role, value): return flag, supplier and line status F as gt, O as pred."""
    role = F.when(F.col("l_linestatus") == "F", "gt").otherwise("pred")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("episode"), role.alias("role")).agg(F.avg(measure).alias("value"))
