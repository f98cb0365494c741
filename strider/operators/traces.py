"""Traces: the values of a metric frame by frame, kept beside the one value of the clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a trace lies in its clip: a value for each frame; values from a later frame on; values of inner frames only.
ALIGNMENTS = ("same_length", "front", "interior")
SCHEMA = "clip_id string, metric string, first_frame_index int, values array<double>"


def first_frame(n_frames: Column, length: Column, alignment: Column) -> Column:
    """The frame of the first value: none is missing, all that are missing come first, or as many before as behind; null if that cannot be."""
    missing = n_frames - length
    return (
        F.when((alignment == "same_length") & (missing == 0), 0)
        .when((alignment == "front") & (missing >= 0), missing)
        .when((alignment == "interior") & (missing >= 0) & (missing % 2 == 0), missing / 2)
        .cast("int")
    )


def traces(frames: DataFrame, metrics: list[str], alignment: str = "front") -> DataFrame:
    """(clip_id, metric, first_frame_index, values) of (clip_id, t, metrics): the values that are not null, in order of frames.

    A clip's values are one array, so a clip is what fits a task.
    """
    one = lambda m: F.transform(F.filter(F.array_sort(F.collect_list(F.struct("t", F.col(m).alias("v")))), lambda x: x["v"].isNotNull()), lambda x: x["v"])
    wide = frames.groupBy("clip_id").agg(F.count("*").alias("n"), *[one(m).alias(m) for m in metrics])
    long = wide.select("clip_id", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("array<double>").alias("values")) for m in metrics])).alias("x")).select("clip_id", "n", "x.*")
    return long.select("clip_id", "metric", first_frame(F.col("n"), F.size("values"), F.lit(alignment)).alias("first_frame_index"), "values")


def unfolded(rows: DataFrame) -> DataFrame:
    """(clip_id, metric, frame, value): a row for each value of a trace at its frame."""
    return rows.select("clip_id", "metric", "first_frame_index", F.posexplode("values").alias("i", "value")).select("clip_id", "metric", (F.col("first_frame_index") + F.col("i")).alias("frame"), "value")


def missing(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """The (clip_id, metric) of ``wanted`` that have no trace yet."""
    return wanted.join(stored.select("clip_id", "metric"), ["clip_id", "metric"], "left_anti")


def append(rows: DataFrame, uri: str) -> None:
    """Add traces to a store; files of one call are committed together, so a call that fails leaves none."""
    rows.select("clip_id", "metric", "first_frame_index", "values").write.mode("append").partitionBy("metric").parquet(uri)


def read(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(uri).select("clip_id", "metric", "first_frame_index", "values")
