"""Training frames of a split: each frame of a video with the row of its log, and a seeded choice of frames by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.sources import layout

#: The source of joints that may be trained on.
REAL = "real"


def episode_order(episode: Column) -> list[Column]:
    """By which episodes are put in order: names that are numbers first, by number, then the others by name."""
    number = F.when(episode.rlike(r"^\d+$"), episode.cast("decimal(38,0)"))
    return [number.isNull(), number, episode]


def limited(episodes: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` episodes in order; all of them for 0."""
    return episodes if limit <= 0 else episodes.orderBy(*episode_order(F.col("episode"))).limit(limit)


def joined(frames: DataFrame, logs: DataFrame, down_sample: int) -> DataFrame:
    """``frames`` (episode, frame, ...) with the log's columns: logs (episode, row, ...) have ``down_sample`` rows a frame, from 0.

    A frame past the end of its log takes the last row. Frames of episodes without a log go. Frames
    and rows meet by episode and number, so an episode is not one task's.
    """
    if down_sample < 1:
        raise ValueError(f"down_sample {down_sample} is below 1")
    ends = logs.groupBy("episode").agg(F.max("row").alias("__end"))
    at = frames.join(ends, "episode").withColumn("__row", F.least(F.col("frame") * down_sample, F.col("__end")))
    mine = logs.withColumnsRenamed({"episode": "__of", "row": "row"})
    return at.join(mine, (F.col("episode") == F.col("__of")) & (F.col("__row") == F.col("row"))).drop("__of", "__end", "__row")


def problems(episodes: DataFrame) -> DataFrame:
    """(episode, problem) of what a split may not mix: joints that are not real, and views, sizes or grippers that not most episodes have.

    ``episodes``: episode, joint_source, view_layout, n_tokens, embed_dim, n_joints, has_gripper.
    """
    shared = ("view_layout", "n_tokens", "embed_dim", "n_joints", "has_gripper")
    most = episodes.agg(*[F.mode(c, True).alias(f"__{c}") for c in shared])
    rows = episodes.crossJoin(F.broadcast(most))  # one row
    said = [F.when(F.coalesce(F.col("joint_source"), F.lit("")) != REAL, F.concat(F.lit("joints are "), F.coalesce("joint_source", F.lit("of no source"))))]
    said += [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.concat(F.lit(f"{c} "), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(", not "), F.coalesce(F.col(f"__{c}").cast("string"), F.lit("null")))) for c in shared]
    return rows.select("episode", F.explode(F.array_compact(F.array(*said))).alias("problem"))


def split(frames: DataFrame, logs: DataFrame, down_sample: int, val_ratio: float = 0.15, seed: int = 0) -> DataFrame:
    """:func:`joined` frames with ``split``: whole scenes are train or val."""
    kept = frames.select("episode").distinct().join(logs.select("episode").distinct(), "episode", "left_semi")
    sides = layout.scene_split(kept, val_ratio, seed)
    return joined(frames, logs, down_sample).join(sides.withColumnRenamed("episode", "__e"), F.col("episode") == F.col("__e")).drop("__e")


def drawn(rows: DataFrame, stratum: str, k: int, seed: int, key: list[str]) -> DataFrame:
    """``k`` rows of each stratum (all, if fewer): those whose ``key`` hashes lowest with the seed, so that reruns draw the same.

    Tasks keep their own ``k`` lowest of a stratum before rows are shuffled, so that no stratum is one task's.
    """
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(stratum).cast("string"), *[F.col(c).cast("string") for c in key]).cast("binary"))
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(place, *key)))
    return numbered.where(F.col("__n") <= k).drop("__n")
