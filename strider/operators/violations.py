"""Violation detectors: per-frame scores, thresholds calibrated on real clips, flags and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.functions import series as S
from strider.operators import blocks, order


def scores(kp: DataFrame, bones: list[tuple[int, int]], rest: float, gap: int = 2) -> DataFrame:
    """(clip, t, rigidity, teleport, jerk, collision): millimetres, derivatives per frame.

    jerk of frames t - 2 to t + 1 stands at frame t, from the third frame on; 0 where there is none.
    """
    w = blocks.window()
    n = len(bones) + 1
    apart = [(i, j) for i in range(n) for j in range(i + gap, n)]
    jerk = F.lead(F.array_max(S.norms(F.col("d3")))).over(w)
    rows = blocks.blocked(kp.select("clip", "t", "p"), 3).select("clip", "t", "block", "own", "p", S.difference("p", 1, w).alias("d1"), S.difference("p", 3, w).alias("d3"))
    found = rows.select("clip", "t", "own", "p", "d1", F.coalesce(jerk * 1000, F.lit(0.0)).alias("jerk")).where("own")
    return found.select(
        "clip", "t", (F.array_max(F.transform(S.bone_lengths(F.col("p"), bones), lambda x: F.abs(x - rest))) * 1000).alias("rigidity"),
        F.coalesce(F.array_max(S.norms(F.col("d1"))) * 1000, F.lit(0.0)).alias("teleport"), "jerk",
        (F.array_min(S.bone_lengths(F.col("p"), apart)) * 1000).alias("collision"),
    )


def thresholds(frames: DataFrame, score: str, pct: float = 95.0, floor: float = 0.0, higher_is_worse: bool = True) -> DataFrame:
    """The percentile of a score over all real frames, at least ``floor``; where lower is worse, that of 100 - pct, without a floor."""
    if not higher_is_worse:
        return order.percentile(frames, [], score, (100 - pct) / 100, "threshold")
    return order.percentile(frames, [], score, pct / 100, "threshold").select(F.greatest("threshold", F.lit(floor)).alias("threshold"))


def intervals(flags: DataFrame) -> DataFrame:
    """(clip, first, last) of each run of flagged frames in (clip, t, flag).

    A run starts and ends where the frame beside it has no flag; starts are numbered in sorted ranges,
    and an end has the number of the last start, so no clip is one task's.
    """
    edges = _edges(flags).where("start or end")
    numbered = order.running_sums(edges.withColumn("__one", F.col("start").cast("int")), ["clip"], ["t"], {"__k": "__one"})
    return numbered.groupBy("clip", (F.col("__k") + F.col("__one")).alias("__k")).agg(F.min("t").alias("first"), F.max("t").alias("last")).drop("__k")


def _edges(flags: DataFrame) -> DataFrame:
    """(clip, t, start, end) of the flagged frames: whether a run starts or ends there."""
    beside = lambda k: F.coalesce(F.when(F.lag("t", k).over(w) == F.col("t") - k, F.lag("flag", k).over(w)), F.lit(False))
    w = blocks.window()
    rows = blocks.blocked(flags.select("clip", "t", "flag"), 1).select("clip", "t", "flag", "own", (~beside(1)).alias("start"), (~beside(-1)).alias("end"))
    return rows.where("own and flag").select("clip", "t", "start", "end")


def report(frames: DataFrame, score: str, threshold: DataFrame, higher_is_worse: bool = True) -> DataFrame:
    """Per clip: threshold, share and number of flagged frames, median and 90th percentile of severity, number of runs.

    A severity above 1 is beyond the threshold in either direction.
    """
    worse = F.col(score) > F.col("threshold") if higher_is_worse else F.col(score) < F.col("threshold")
    rows = frames.crossJoin(F.broadcast(threshold)).withColumn("flag", worse)
    severity = F.col(score) / F.col("threshold") if higher_is_worse else F.col("threshold") / F.greatest(F.col(score), F.lit(1e-9))
    runs = _edges(rows).groupBy("clip").agg(F.count_if("start").alias("runs"))
    sums = rows.groupBy("clip").agg(F.round(F.first("threshold"), 2).alias("threshold"), F.round(F.avg(F.col("flag").cast("double")), 3).alias("fraction"), F.count_if("flag").alias("n_flagged"))
    found = order.percentiles(rows.select("clip", severity.alias("severity")), ["clip"], "severity", [0.5, 0.9]).groupBy(F.col("clip").alias("__clip"))
    middle = found.agg(F.round(F.max(F.when(F.col("p") < 0.7, F.col("q"))), 3).alias("severity_median"), F.round(F.max(F.when(F.col("p") > 0.7, F.col("q"))), 3).alias("severity_p90"))
    return sums.join(middle, F.col("clip").eqNullSafe(F.col("__clip")), "left").drop("__clip").join(runs, "clip", "left").fillna(0, ["runs"])


def bend_angles(kp: DataFrame, points: int) -> DataFrame:
    """(clip, t, joint, angle) between consecutive bones, in degrees."""
    bone = lambda j: [F.get("p", 3 * (j + 1) + c) - F.get("p", 3 * j + c) for c in range(3)]

    def angle(j: Column) -> Column:
        a, b = bone(j), bone(j + 1)
        dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
        size = F.sqrt(sum((x * x for x in a), F.lit(0.0))) * F.sqrt(sum((x * x for x in b), F.lit(0.0))) + 1e-6
        return F.degrees(F.acos(S.clamp(dot / size, F.lit(-1.0), F.lit(1.0))))

    return kp.select("clip", "t", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 3)), angle)).alias("joint", "angle"))


def bend_excess(angles: DataFrame) -> DataFrame:
    """(clip, t, bend): the most a frame leaves the 1 to 99 % range of a joint over all real frames, in degrees."""
    found = order.percentiles(angles, ["joint"], "angle", [0.01, 0.99])
    fit = found.groupBy("joint").agg(F.max(F.when(F.col("p") < 0.5, F.col("q"))).alias("lo"), F.max(F.when(F.col("p") > 0.5, F.col("q"))).alias("hi"))
    return angles.join(F.broadcast(fit), "joint").groupBy("clip", "t").agg(F.max(S.excess(F.col("angle"), F.col("lo"), F.col("hi"))).alias("bend"))


def joint_envelope(angles: DataFrame) -> DataFrame:
    """Per clip, the most and the mean by which frames leave the 1 to 99 % range of a joint over all real frames."""
    return bend_excess(angles).groupBy("clip").agg(F.max("bend").alias("worst"), F.avg("bend").alias("mean"))
