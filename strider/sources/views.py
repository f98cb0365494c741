"""Camera views packed into one frame, and clips with their time base, as tables: what fits, what does not, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A declared layout: the views it shows, how panels lie in a frame, and, where it shows some of them only, which.
LAYOUT = "layout string, n_views int, names array<string>, tokens_per_view int, packing string, n_panels int, panels array<int>"
# How panels lie, and the width by height that one of several panels may have.
PACKINGS = ("height", "width", "grid2x2")
ASPECTS = (0.2, 5.0)
#: A frame lasts so many seconds at most; more is a rate taken for a time.
MOST_DT = 10.0
#: What a record says of its clip, in order.
RECORD = ("path", "fps", "dt", "n_frames", "width", "height", "dt_source", "view_layout", "stride", "codec", "sha1")


def _first_problem(checks: list[tuple[Column, str | Column]]) -> Column:
    said = [F.when(bad, F.lit(text) if isinstance(text, str) else text) for bad, text in checks]
    return F.coalesce(*said)


def described(layouts: DataFrame) -> DataFrame:
    """``layouts`` (``LAYOUT``) with panel_count, panel_indices, is_subset, key and problem, which is null for a sound one.

    The key is the identity of a layout: names and tokens, and the packing where it is not a plain stack.
    """
    n, empty = F.col("n_views"), F.array().cast("array<int>")
    rows = layouts.withColumn("panel_count", F.coalesce("n_panels", n)).withColumn("__p", F.coalesce("panels", empty)).withColumn("__n", F.coalesce("names", F.array().cast("array<string>")))
    count, chosen = F.col("panel_count"), F.size("__p") > 0
    problem = _first_problem([
        (n.isNull() | (n < 1), "n_views is below 1"), ((F.size("__n") > 0) & (F.size("__n") != n), F.concat(F.size("__n").cast("string"), F.lit(" names for "), n.cast("string"), F.lit(" views"))),
        (F.col("tokens_per_view") < 1, "tokens_per_view is below 1"), (F.col("packing").isNull() | ~F.col("packing").isin(*PACKINGS), F.concat(F.lit("no packing "), F.coalesce("packing", F.lit("null")))),
        (F.col("n_panels") < 1, "n_panels is below 1"), ((F.col("packing") == "grid2x2") & (count != 4), "a grid has four panels"),
        (chosen & (F.size("__p") != n), "not one panel a view"), (F.size(F.array_distinct("__p")) != F.size("__p"), "panels repeat"),
        (F.exists("__p", lambda p: p.isNull() | (p < 0) | (p >= count)), "no such panel"), (~chosen & (count != n), "panels are not chosen"),
    ])
    every = F.when(count >= 1, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(empty)
    rows = rows.withColumn("panel_indices", F.when(chosen, F.col("__p")).otherwise(every)).withColumn("is_subset", chosen | (count != n))
    base = F.concat(n.cast("string"), F.lit("x"), F.coalesce(F.col("tokens_per_view").cast("string"), F.lit("?")), F.lit(":"), F.when(F.size("__n") > 0, F.array_join("__n", "+")).otherwise("unnamed"))
    long = F.concat(base, F.lit(":"), "packing", F.lit(":"), count.cast("string"), F.lit("p:"), F.array_join(F.transform("panel_indices", lambda p: p.cast("string")), ","))
    plain = (F.col("packing") == "height") & F.col("n_panels").isNull() & ~chosen
    return rows.withColumn("key", F.when(plain, base).otherwise(long)).withColumn("problem", problem).drop("__p", "__n")


def fitted(frames: DataFrame, layouts: DataFrame) -> DataFrame:
    """``frames`` (layout, width, height, ...) with layout_key, panel_height, panel_width, view_height and problem.

    Sizes are null where there is a problem: an unknown or unsound layout, a size that the panels do
    not divide, or several panels of a shape no camera has, which tells of a wrong packing.
    view_height is that of a plain stack. Other columns of ``frames`` stay.
    """
    known = F.broadcast(described(layouts).select(F.col("layout").alias("__l"), F.col("key").alias("layout_key"), *[F.col(c).alias(f"__{c}") for c in ("packing", "panel_count", "panel_indices", "names", "is_subset", "problem")]))  # a row a declared layout
    rows = frames.join(known, F.col("layout") == F.col("__l"), "left")
    w, h, n, how = F.col("width"), F.col("height"), F.col("__panel_count"), F.col("__packing")
    down, across = F.when(how == "height", n).when(how == "grid2x2", 2).otherwise(1), F.when(how == "width", n).when(how == "grid2x2", 2).otherwise(1)
    down, across = F.nullif(down, F.lit(0)), F.nullif(across, F.lit(0))
    rows = rows.withColumn("__h", F.floor(h / down).cast("int")).withColumn("__w", F.floor(w / across).cast("int"))
    shape = F.col("__w") / F.nullif(F.col("__h"), F.lit(0))
    problem = _first_problem([
        (F.col("__l").isNull(), F.concat(F.lit("no layout "), F.coalesce("layout", F.lit("null")))), (F.col("__problem").isNotNull(), F.col("__problem")),
        (w.isNull() | h.isNull() | (w < 1) | (h < 1), "no size"), (h % down != 0, F.concat(F.lit("height "), h.cast("string"), F.lit(" is not "), down.cast("string"), F.lit(" panels"))),
        (w % across != 0, F.concat(F.lit("width "), w.cast("string"), F.lit(" is not "), across.cast("string"), F.lit(" panels"))),
        ((n > 1) & (shape.isNull() | (shape < ASPECTS[0]) | (shape > ASPECTS[1])), F.concat(F.lit("no camera's shape: "), F.col("__w").cast("string"), F.lit("x"), F.col("__h").cast("string"))),
    ])
    rows = rows.drop("problem").withColumn("problem", problem)
    fine = lambda c: F.when(F.col("problem").isNull(), c)
    stack = (how == "height") & ~F.col("__is_subset")
    return rows.select(*[c for c in frames.columns if c != "problem"], "layout_key", fine(F.col("__h")).alias("panel_height"), fine(F.col("__w")).alias("panel_width"), fine(F.when(stack, F.col("__h"))).alias("view_height"), "problem",
        F.col("__packing").alias("_packing"), F.col("__panel_count").alias("_count"), F.col("__panel_indices").alias("_indices"), F.col("__names").alias("_names"))


def fits(frames: DataFrame, layouts: DataFrame) -> DataFrame:
    """:func:`fitted` without what only crops need."""
    return fitted(frames, layouts).drop("_packing", "_count", "_indices", "_names")


def crops(frames: DataFrame, layouts: DataFrame, every: bool = False) -> DataFrame:
    """``frames`` with view, name, panel, top, bottom, left, right: the box of each view that the layout shows; with ``every`` of each panel, view and name null where none shows it.

    Frames that do not fit their layout have no row here; :func:`fits` names them.
    """
    rows = fitted(frames, layouts).where("problem is null")
    keep = [c for c in frames.columns if c != "problem"]
    if every:
        at = F.array_position("_indices", F.col("panel")).cast("int")
        boxes = rows.withColumn("panel", F.explode(F.sequence(F.lit(0), F.col("_count") - 1))).withColumn("view", F.when(at > 0, at - 1))
    else:
        boxes = rows.select("*", F.posexplode("_indices").alias("view", "panel"))
    p, how = F.col("panel"), F.col("_packing")
    row = F.when(how == "height", p).when(how == "grid2x2", F.floor(p / 2).cast("int")).otherwise(0)
    column = F.when(how == "width", p).when(how == "grid2x2", p % 2).otherwise(0)
    top, left = row * F.col("panel_height"), column * F.col("panel_width")
    return boxes.select(*keep, "view", F.get("_names", F.col("view")).alias("name"), "panel", top.alias("top"), (top + F.col("panel_height")).alias("bottom"), left.alias("left"), (left + F.col("panel_width")).alias("right"))


def token_problems(features: DataFrame, layouts: DataFrame) -> DataFrame:
    """``features`` (layout, n_tokens, ...) with problem: tokens are views times tokens of a view, or, where these are not told, a multiple of the views."""
    known = F.broadcast(described(layouts).select(F.col("layout").alias("__l"), F.col("n_views").alias("__v"), F.col("tokens_per_view").alias("__t"), F.col("problem").alias("__problem")))  # a row a declared layout
    n, want = F.col("n_tokens"), F.col("__v") * F.col("__t")
    problem = _first_problem([
        (F.col("__l").isNull(), F.concat(F.lit("no layout "), F.coalesce("layout", F.lit("null")))), (F.col("__problem").isNotNull(), F.col("__problem")), (n.isNull(), "no tokens"),
        (want.isNull() & (n % F.nullif("__v", F.lit(0)) != 0), F.concat(n.cast("string"), F.lit(" tokens are no multiple of "), F.col("__v").cast("string"))), (n != want, F.concat(n.cast("string"), F.lit(" tokens, not "), want.cast("string"))),
    ])
    return features.drop("problem").join(known, F.col("layout") == F.col("__l"), "left").withColumn("problem", problem).drop("__l", "__v", "__t", "__problem")


def reader_problems(clips: DataFrame, layouts: DataFrame, reader: str) -> DataFrame:
    """``clips`` (layout, width, height, ...) with problem: what keeps a reader of layout ``reader`` from them, another number of views or a frame that does not fit."""
    rows = described(layouts)
    views = F.broadcast(rows.select(F.col("layout").alias("__l"), F.col("n_views").alias("__v")))
    wanted = F.broadcast(rows.where(F.col("layout") == reader).select(F.col("n_views").alias("__r")))
    met = fits(clips, layouts).join(views, F.col("layout") == F.col("__l"), "left").join(wanted, F.lit(True), "left")  # one row at most
    other = F.when(F.col("__r").isNull(), F.lit(f"no layout {reader}")).when(F.col("__v") != F.col("__r"), F.concat(F.lit("reader of "), F.col("__r").cast("string"), F.lit(" views, clip of "), F.col("__v").cast("string")))
    return met.withColumn("problem", F.coalesce(other, F.col("problem"))).drop("__l", "__v", "__r")


def dt_problem(dt: Column) -> Column:
    """Why a frame time is none: not finite, not positive, or so long that it must be a rate."""
    return F.when(dt.isNull() | F.isnan(dt) | (F.abs(dt) == float("inf")), "dt is not finite").when(dt <= 0, "dt is not positive").when(dt > MOST_DT, "dt is a rate?")


def specs(rows: DataFrame) -> DataFrame:
    """Clips (path, fps or dt or both, n_frames, ...) with fps, dt, stride, duration_s and problem.

    One of rate and frame time follows from the other; both must agree. stride, if not told, is 1.
    """
    for c in ("fps", "dt"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
    rows = rows if "stride" in rows.columns else rows.withColumn("stride", F.lit(1))
    other = lambda c: F.when(F.col(c) != 0, 1 / F.col(c))
    rows = rows.withColumns({"fps": F.coalesce("fps", other("dt")), "dt": F.coalesce("dt", other("fps"))})
    fps, dt = F.col("fps"), F.col("dt")
    problem = F.coalesce(
        F.when(fps.isNull() | F.isnan(fps) | (F.abs(fps) == float("inf")) | (fps <= 0), "fps is no rate"), dt_problem(dt), F.when(F.abs(dt * fps - 1) > 1e-6, "dt and fps disagree"),
        F.when(F.col("n_frames").isNull() | (F.col("n_frames") < 0), "no frames told"), F.when(F.col("stride") < 1, "stride is below 1"),
    )
    return rows.withColumn("problem", problem).withColumn("duration_s", F.when(F.col("problem").isNull(), F.col("n_frames") * dt))


def subsampled(clips: DataFrame, factor: int | Column) -> DataFrame:
    """:func:`specs` of every so many frames: rate, frame time, number of frames, stride and duration follow; a factor that is null keeps a clip."""
    if isinstance(factor, int) and factor < 1:
        raise ValueError(f"a factor of {factor} keeps no frames")
    k = F.coalesce(factor if isinstance(factor, Column) else F.lit(factor), F.lit(1))
    new = clips.withColumn("__k", k)
    k = F.col("__k")
    kept = F.nullif("__k", F.lit(0))
    bad = F.when(k < 1, F.lit("factor is below 1"))
    new = new.withColumns({"fps": F.col("fps") / kept, "dt": F.col("dt") * k, "n_frames": F.ceil(F.col("n_frames") / kept), "stride": F.col("stride") * k, "problem": F.coalesce("problem", bad)})
    return new.withColumn("duration_s", F.when(F.col("problem").isNull(), F.col("n_frames") * F.col("dt"))).drop("__k")


def records(clips: DataFrame, layouts: DataFrame) -> DataFrame:
    """The ``RECORD`` columns of sound clips (:func:`specs`, with width, height and layout); what is not told is null."""
    known = F.broadcast(described(layouts).select(F.col("layout").alias("__l"), F.col("key").alias("view_layout")))
    rows = clips.where("problem is null").drop("view_layout").join(known, F.col("layout") == F.col("__l"), "left")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in RECORD])
