"""Trees of clips: which paths count, what their places say, what they lack, and splits that keep scenes together."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.operators import order

#: What the parts of a glob mean in a regular expression; a class in brackets stays, anything else is itself.
_GLOB = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
_TOKENS = re.compile(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]*\]|.", re.S)
#: The axes of a cell, in the order of its folders.
AXES = ("cache", "robot", "generator", "view", "horizon")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob over a path: ``*`` and ``?`` stay in a folder, ``**`` does not."""
    parts = [_GLOB.get(t) or (t if len(t) > 1 else re.escape(t)) for t in _TOKENS.findall(glob)]
    return f"^{''.join(parts)}$"


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a path below the root matches any of ``globs``."""
    return F.coalesce(*[F.when(path.rlike(glob_pattern(g)), True) for g in globs], F.lit(False)) if globs else F.lit(False)


def episodes(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` below cache/robot/generator/view/horizon[/iter]/episode_x with the axes, ``iter``, ``episode`` and ``file``; others go."""
    axes = "".join(rf"([^/]+)/" for _ in AXES)
    pattern = rf"^{axes}(?:(iter[^/]*)/)?(episode_[^/]+)/([^/]+)$"
    named = [*AXES, "iter", "episode", "file"]
    part = lambda i: F.regexp_extract(path, pattern, i)
    return files.where(F.col(path).rlike(pattern)).select(files["*"], *[F.nullif(part(i + 1), F.lit("")).alias(c) for i, c in enumerate(named)])


def problems(clips: DataFrame, generators: DataFrame, rel_tol: float = 0.01, by_robot: bool = False) -> DataFrame:
    """(place, problem) of episodes: an unknown generator, a missing file, a size, rate or number of frames that does not agree.

    ``clips``: cell, generator, episode, file (pred or gt), w, h, fps, n_frames. ``generators``: generator,
    width, height, fps (null if any), has_gt. ``by_robot``: clips have a robot, and so have generators
    (null: all robots), whose rates and sizes then are those of the robot.
    """
    side = lambda f: F.max(F.when(F.col("file") == f, F.struct("w", "h", "fps", "n_frames"))).alias(f)
    own = clips.groupBy("cell", "generator", *(["robot"] if by_robot else []), "episode").agg(side("pred"), side("gt"))
    if by_robot:
        asked = F.broadcast(generators.withColumnsRenamed({"generator": "__of", "robot": "__robot"}))
        both = own.join(asked, (F.col("generator") == F.col("__of")) & (F.col("__robot").isNull() | (F.col("robot") == F.col("__robot"))), "left")
    else:
        both = own.join(F.broadcast(generators), "generator", "left")
    size = lambda f: F.when((F.col(f"{f}.w") != F.col("width")) | (F.col(f"{f}.h") != F.col("height")), F.concat(F.lit(f"{f}: size "), F.concat_ws("x", f"{f}.w", f"{f}.h"), F.lit(" is not "), F.concat_ws("x", "width", "height")))
    off = F.abs(F.col("pred.fps") - F.col("fps")) > rel_tol * F.greatest(F.abs("pred.fps"), F.abs("fps"))
    known = [
        F.when(F.col("pred").isNull(), "pred: missing"), F.when(F.col("has_gt") & F.col("gt").isNull(), "gt: missing"), size("pred"), size("gt"),
        F.when(off, "pred: rate differs"), F.when(F.col("pred.n_frames") != F.col("gt.n_frames"), "frames differ"),
    ]
    said = F.when(F.col("has_gt").isNull(), F.array(F.lit("generator unknown"))).otherwise(F.array_compact(F.array(*known)))
    return both.select(F.concat_ws("/", "cell", "episode").alias("place"), F.explode(said).alias("problem"))


def parse_only(entries: list[str], values: dict[str, list[str]]) -> list[tuple[str, str]]:
    """``axis=value`` filters; raises for what is no axis or no value of it."""
    out = []
    for entry in entries:
        axis, sign, value = entry.partition("=")
        if not sign or value not in values.get(axis, ()):
            raise ValueError(f"{entry!r}: wanted AXIS=VALUE of {values}")
        out.append((axis, value))
    return out


def only(cells: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    for axis, value in filters:
        cells = cells.where(F.col(axis) == value)
    return cells


def scene(episode: Column) -> Column:
    """An episode's name without the number at its end; a name that is only a number is a scene of its own."""
    bare = F.regexp_replace(episode, r"[-_]?\d+$", "")
    return F.when(bare == "", episode).otherwise(bare)


def scene_split(rows: DataFrame, val_ratio: float = 0.15, seed: int = 0, episode: str = "episode") -> DataFrame:
    """``rows`` with ``split``: whole scenes are val, the smallest first (those of a size by a hash with the seed), while they fit ``val_ratio`` of all episodes; the smallest one in any case.

    Sizes of scenes are added up over sorted ranges, so neither scenes nor episodes meet in a task.
    """
    if not 0 < val_ratio < 1:
        raise ValueError(f"val_ratio {val_ratio} is not between 0 and 1")
    named = rows.withColumn("__scene", scene(F.col(episode)))
    sizes = named.groupBy("__scene").agg(F.count("*").alias("__n")).withColumn("__place", F.md5(F.concat(F.lit(f"{seed}:"), "__scene").cast("binary")))
    upto = order.running_sums(sizes, [], ["__n", "__place"], {"__before": "__n"})
    most = sizes.agg(F.round(F.sum("__n") * val_ratio).alias("__most"))
    val = upto.crossJoin(F.broadcast(most)).where((F.col("__before") + F.col("__n") <= F.col("__most")) | (F.col("__before") == 0))  # one row
    split = F.when(F.col("__val").isNotNull(), "val").otherwise("train")
    return named.join(val.select("__scene", F.lit(True).alias("__val")), "__scene", "left").withColumn("split", split).select(*rows.columns, "split")
