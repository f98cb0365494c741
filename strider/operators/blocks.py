"""Clips cut into blocks of frames, with copies of the frames next to a border, so that a window over time needs no whole clip in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block; it has no effect on results.
BLOCK = 4096


def blocked(frames: DataFrame, reach: int, size: int = BLOCK) -> DataFrame:
    """``frames`` (clip, t, ...) with ``block`` and ``own``: each frame in its block, and copies (not ``own``) in a block within ``reach`` frames of it.

    ``t`` numbers the frames of a clip one by one. What a window over a block finds for its own
    frames is what a window over the clip finds, if it looks at most ``reach`` frames to either side.
    """
    if reach >= size:
        raise ValueError(f"a block of {size} frames cannot look {reach} frames aside")
    at = lambda shift: F.floor((F.col("t") + shift) / size)
    near = F.array_distinct(F.array(at(-reach), at(0), at(reach)))
    return frames.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == at(0))


def window(*by: str):
    """Over the frames of a block of a clip, in order."""
    return Window.partitionBy("clip", "block", *by).orderBy("t")
