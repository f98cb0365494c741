"""Trees of generated clips as they are shipped: several shapes of episodes, the iteration with most of them chosen, and where each file goes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.sources.layout import excluded, glob_pattern
from strider.sources.manifest import episode_name
from strider.sources.shared import stored

# Shapes of episodes, folders that are views and horizons, names of placed files and of files that declare a count.
SHAPES = ("episode_dir", "task_episode", "flat_or_dir")
VIEWS, HORIZONS = ("singleview", "single_view", "multiview"), ("makovian", "non_makovian")
PRED, GT, CARD = "pred.mp4", "gt.mp4", "cell_card.json"
DECLARED = (("info.json", ("total_episodes",)), ("all_summary.json", ("num_episodes", "n_episodes", "total_episodes")))

CELL = ("cache", "embodiment", "view", "generator", "horizon")
#: The axes of a placed cell, in the order of its folders, and the keys that its card needs.
PLACED = ("cache", "robot", "view", "generator", "horizon")
CARD_KEYS = (*PLACED, "embodiment")


@dataclass(frozen=True)
class Generator:
    """How a generator names its files, and what their clips are like.

    episode_dir: episode_x/pred and gt. task_episode: files like the glob pred, in a folder of their
    task or none. flat_or_dir: x with the end of the globs pred and gt, or episode_x/dir_pred and dir_gt.
    """

    name: str
    shape: str
    has_iter: bool
    has_gt: bool
    width: int
    height: int
    n_views: int
    fps_tolerant: bool = False
    fps: float | None = None
    fps_by_robot: tuple[tuple[str, float], ...] = ()
    pred: str = ""
    gt: str = ""
    dir_pred: str = ""
    dir_gt: str = ""

    def fps_of(self, robot: str | None) -> float | None:
        return self.fps if self.fps is not None else dict(self.fps_by_robot).get(robot)


#: Which keys of a mapping name the files, by shape: (key, field, whether it must be there).
_NAMES = {
    "episode_dir": (("pred_filename", "pred", True), ("gt_filename", "gt", False)), "task_episode": (("pred_glob", "pred", True),),
    "flat_or_dir": (("flat_pred_glob", "pred", True), ("flat_gt_glob", "gt", True), ("dir_pred_filename", "dir_pred", True), ("dir_gt_filename", "dir_gt", True)),
}


def _checked(name: str, entry: Any) -> Generator:
    def need(fine: bool, what: str) -> None:
        if not fine:
            raise ValueError(f"generators.{name}: {what}")

    need(isinstance(entry, Mapping), "not a mapping")
    shape = entry.get("shape")
    need(shape in SHAPES, f"shape {shape!r} is none of {', '.join(SHAPES)}")
    for key in ("width", "height", "n_views"):
        need(type(entry.get(key)) is int and entry[key] > 0, f"{key} is not a positive whole number")
    for key in ("has_iter_level", "has_ground_truth", "fps_tolerant"):
        need(isinstance(entry.get(key), bool), f"{key} is not true or false")
    fps, by_robot = entry.get("fps"), entry.get("fps_by_robot")
    need((fps is None) != (by_robot is None), "one of fps and fps_by_robot is needed")
    need(fps is None or (isinstance(fps, int | float) and fps > 0), "fps is not positive")
    need(by_robot is None or (isinstance(by_robot, Mapping) and len(by_robot) > 0), "fps_by_robot is empty")
    names = {}
    for key, part, must in _NAMES[shape]:
        need(isinstance(entry.get(key), str) or (not must and entry.get(key) is None), f"{key} is not a string")
        names[part] = entry.get(key) or ""
    rates = tuple((str(r), float(v)) for r, v in (by_robot or {}).items())
    flags = {"has_iter": entry["has_iter_level"], "has_gt": entry["has_ground_truth"], "fps_tolerant": entry["fps_tolerant"]}
    return Generator(name, shape, width=entry["width"], height=entry["height"], n_views=entry["n_views"], fps=None if fps is None else float(fps), fps_by_robot=rates, **flags, **names)


def parse_spec(raw: Any) -> tuple[list[Generator], list[str]]:
    """(generators, globs of what to leave out) of a mapping; raises for what is missing or of a wrong kind."""
    if not isinstance(raw, Mapping) or not isinstance(raw.get("generators"), Mapping) or not raw["generators"]:
        raise ValueError("generators: a mapping that is not empty is needed")
    globs = raw.get("exclude_globs", [])
    if isinstance(globs, str) or not all(isinstance(g, str) and g for g in globs):
        raise ValueError("exclude_globs: a list of globs is needed")
    return [_checked(n, e) for n, e in raw["generators"].items()], list(globs)


def parse_robots(raw: Any) -> list[tuple[str, str, str]]:
    """(robot, embodiment, generator) of a mapping of robots; of robots that claim the same pair the first counts."""
    if not isinstance(raw, Mapping) or not isinstance(raw.get("robots"), Mapping) or not raw["robots"]:
        raise ValueError("robots: a mapping that is not empty is needed")
    out: dict[tuple[str, str], str] = {}
    for robot, entry in raw["robots"].items():
        if not isinstance(entry, Mapping) or not {"embodiment", "generators"} <= set(entry):
            raise ValueError(f"robots.{robot}: embodiment and generators are needed")
        embodiment, generators = entry["embodiment"], entry["generators"]
        if not (isinstance(embodiment, str) and embodiment):
            raise ValueError(f"robots.{robot}.embodiment: a name is needed")
        if not (isinstance(generators, list) and generators and all(isinstance(g, str) and g for g in generators)):
            raise ValueError(f"robots.{robot}.generators: a list of names is needed")
        for g in generators:
            out.setdefault((embodiment, g), robot)
    return [(robot, e, g) for (e, g), robot in out.items()]


def generator_rows(spark: SparkSession, generators: list[Generator]) -> DataFrame:
    """A row for each generator: what :func:`found` matches files with."""
    rows = []
    for g in generators:
        d = asdict(g)
        ends = [x.lstrip("*") if g.shape == "flat_or_dir" else "" for x in (g.pred, g.gt)]
        rows.append((g.name, g.shape, g.has_iter, g.has_gt, glob_pattern(g.pred), g.pred.startswith("."), *ends, d["pred"], d["gt"], d["dir_pred"], d["dir_gt"]))
    kinds = "generator string, shape string, has_iter boolean, has_gt boolean, pred_re string, hidden boolean, pred_end string, gt_end string, pred string, gt string, dir_pred string, dir_gt string"
    return spark.createDataFrame(rows, kinds)


def rates(spark: SparkSession, generators: list[Generator]) -> DataFrame:
    """(generator, robot, width, height, fps, has_gt): what clips should be like; robot is null where the rate is of all, the rate null where any will do."""
    rows = []
    for g in generators:
        each = [(None, g.fps)] if g.fps is not None else list(g.fps_by_robot)
        rows += [(g.name, robot, g.width, g.height, None if g.fps_tolerant else fps, g.has_gt) for robot, fps in each]
    return spark.createDataFrame(rows, "generator string, robot string, width int, height int, fps double, has_gt boolean")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified) of all files below a folder, paths below it; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    from_here = F.lit(len("/" + root.split(":", 1)[-1].strip("/")) + 2)
    return files.select(F.substring(bare, from_here, F.length(bare)).alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each worked out once a row: filters on them are not moved before them, where each would work them out again."""
    return rows.select("*", F.inline(F.array(F.struct(*[x.alias(c) for c, x in columns.items()]))))


def _placed(files: DataFrame, root: str) -> DataFrame:
    """``files`` below root/cache/embodiment/output/view/generator/horizon with these and the ``rest`` of the path; a file beside the horizons has an empty one."""
    below = files.where(F.col("path").startswith(f"{root}/")).select("path")
    rows = _once(below, __p=F.split(F.substring("path", len(root) + 2, 1 << 30), "/"))
    part = lambda k: F.get("__p", F.lit(k))
    named = [F.length(part(k)) > 0 for k in (0, 1, 3, 4)]
    fine = (part(2) == "output") & named[0] & named[1] & named[2] & named[3]
    rest = lambda k: F.array_join(F.slice("__p", k + 1, F.greatest(F.size("__p") - k, F.lit(0))), "/")
    deep = (F.length(part(5)) > 0) & (F.length(rest(6)) > 0)
    horizon, left = F.when(deep, part(5)).otherwise(""), F.when(deep, rest(6)).otherwise(rest(5))
    cut = _once(rows.where(fine), cache=part(0), embodiment=part(1), view=part(3), generator=part(4), horizon=horizon, rest=left)
    return cut.where("rest <> ''").select("path", *CELL, "rest")


def _left_out(root: str, globs: list[str]) -> Column:
    """Whether a folder from the cache down to the iteration matches a glob."""
    out, here = F.lit(False), F.lit(root)
    for c in (*CELL, "iter"):
        here = F.concat(here, F.lit("/output/" if c == "view" else "/"), F.col(c))
        out = out | F.coalesce(excluded(here, globs), F.lit(False))
    return out


def _matches() -> Column:
    """(episode, role) that a file of ``inner`` path is of; none, one or several."""
    depth, folder, file = F.col("__depth"), F.col("__folder"), F.col("__file")
    like = F.rlike(file, F.col("pred_re")) & (F.col("hidden") | ~file.startswith("."))
    stem = F.regexp_replace(file, r"(?<=[^.])[.][^.]*$", "")
    is_ = lambda shape: F.col("shape") == shape
    at = lambda fits, episode, role: F.when(fits, F.struct(episode.alias("episode"), F.lit(role).alias("role")))
    before = lambda end: F.substring(file, F.lit(1), F.length(file) - F.length(end))
    own = folder.startswith("episode_")
    number = F.concat(F.lit("dir:"), F.substring(folder, F.lit(9), F.length(folder)))
    cases = [
        at(is_("episode_dir") & own & (file == F.col("pred")), folder, "pred"), at(is_("episode_dir") & own & (F.col("gt") != "") & (file == F.col("gt")), folder, "gt"),
        at(is_("task_episode") & (depth == 0) & like, stem, "pred"), at(is_("task_episode") & ~folder.startswith("_") & like, F.concat(folder, F.lit("/"), stem), "pred"),
        at(is_("flat_or_dir") & (depth == 0) & like, F.concat(F.lit("flat:"), before(F.col("pred_end"))), "pred"),
        at(is_("flat_or_dir") & (depth == 0) & F.endswith(file, F.col("gt_end")), F.concat(F.lit("flat:"), before(F.col("gt_end"))), "gt"),
        at(is_("flat_or_dir") & own & (file == F.col("dir_pred")), number, "pred"), at(is_("flat_or_dir") & own & (file == F.col("dir_gt")), number, "gt"),
    ]
    return F.array_compact(F.array(*cases))


def found(files: DataFrame, generators: list[Generator], robots: list[tuple[str, str, str]], root: str, exclude: list[str] | tuple = ()) -> DataFrame:
    """(cache, robot, embodiment, view, generator, horizon, iter, episode, pred_path, gt_path, whole, skipped) of a listing (path).

    A row is an episode that has any of its files, or, with no episode, a folder that has other files
    only. whole: it has a prediction, and its truth if the generator has any; skipped: that truth lacks. Folders that are no view,
    horizon, generator or iteration, that no robot claims or that a glob names have no row.
    """
    spark = files.sparkSession
    claims = spark.createDataFrame(robots, "robot string, embodiment string, generator string")
    rows = _placed(files, root).where(F.col("view").isin(*VIEWS) & F.col("horizon").isin(*HORIZONS))
    known = rows.join(F.broadcast(generator_rows(spark, generators)), "generator").join(F.broadcast(claims), ["embodiment", "generator"])
    turn = F.when(F.col("has_iter"), F.nullif(F.regexp_extract("rest", r"^(iter_\d[^/]*)/", 1), F.lit("")))
    inner = F.when(F.col("has_iter"), F.substring("rest", F.length("iter") + 2, F.length("rest"))).otherwise(F.col("rest"))
    placed = _once(known, iter=turn).where("not has_iter or iter is not null").where(~_left_out(root, list(exclude))).withColumn("inner", inner)
    parts = _once(placed, __q=F.split("inner", "/"))
    parts = parts.select("*", (F.size("__q") - 1).alias("__depth"), F.when(F.size("__q") == 2, F.get("__q", F.lit(0))).alias("__folder"), F.element_at("__q", -1).alias("__file"))
    each = parts.select("robot", *CELL, "iter", "has_gt", "path", F.inline_outer(_matches()))
    path = lambda role: F.max(F.when(F.col("role") == role, F.col("path"))).alias(f"{role}_path")
    # Flags of their own: who asks for no path, as the counts of cells do, has none gathered.
    any_ = lambda role: F.coalesce(F.bool_or(F.col("role") == role), F.lit(False)).alias(f"any_{role}")
    both = each.groupBy("episode", "robot", *CELL, "iter").agg(path("pred"), path("gt"), any_("pred"), any_("gt"), F.bool_or("has_gt").alias("has_gt"))
    whole = F.col("any_pred") & (~F.col("has_gt") | F.col("any_gt"))
    skipped = F.col("any_pred") & F.col("has_gt") & ~F.col("any_gt")
    return both.select(*PLACED, "embodiment", "iter", "episode", "pred_path", "gt_path", whole.alias("whole"), skipped.alias("skipped"))


def cells(rows: DataFrame) -> DataFrame:
    """(cache, robot, view, generator, horizon, embodiment, iter, n_episodes, n_skipped) of :func:`found` rows: of each cell the iteration with most whole episodes, of equals the last by name.

    n_skipped: predictions left out for want of their truth.
    """
    each = rows.groupBy(*PLACED, "embodiment", "iter").agg(F.count_if("whole").alias("n"), F.count_if("skipped").alias("skipped"))
    best = each.groupBy(*PLACED, "embodiment").agg(F.max(F.struct("n", "iter", "skipped")).alias("b"))
    return best.select(*PLACED, "embodiment", F.col("b.iter").alias("iter"), F.col("b.n").alias("n_episodes"), F.col("b.skipped").alias("n_skipped"))


def cell_dir(root: str, turn: str | None = "iter") -> Column:
    """The folder of a cell in the shipped tree."""
    parts = F.concat_ws("/", F.lit(root), "cache", "embodiment", F.lit("output"), "view", "generator", "horizon")
    return F.concat(parts, F.coalesce(F.concat(F.lit("/"), F.col(turn)), F.lit(""))) if turn else parts


def episodes(rows: DataFrame) -> DataFrame:
    """Whole episodes of the chosen iteration of each cell: (cache, robot, view, generator, horizon, embodiment, iter, episode, pred_path, gt_path)."""
    rows = stored(rows, "found")  # read twice, by the cells and here
    best = cells(rows).select(*[F.col(c).alias(f"__{c}") for c in (*PLACED, "embodiment", "iter")])
    same = F.lit(True)
    for c in (*PLACED, "embodiment", "iter"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.where("whole").join(best, same, "left_semi").drop("whole", "skipped")


def placing(rows: DataFrame) -> DataFrame:
    """(target, source) of :func:`episodes`: cache/robot/view/generator/horizon/episode/pred.mp4 and gt.mp4."""
    folder = F.concat_ws("/", *PLACED, episode_name(F.col("episode")))
    pair = lambda name, path: F.struct(F.concat(folder, F.lit(f"/{name}")).alias("target"), F.col(path).alias("source"))
    return rows.select(F.inline(F.array(pair(PRED, "pred_path"), pair(GT, "gt_path")))).where("source is not null")


def unplaced(plan: DataFrame, placed: DataFrame) -> DataFrame:
    """What of a plan ``placed`` (target, source) does not have yet: a rerun on its own result has no row."""
    return plan.join(placed, ["target", "source"], "left_anti")


def collisions(plan: DataFrame) -> DataFrame:
    """(target, n) of targets that several sources would go to, as their episodes are called alike once they are names of folders."""
    return plan.groupBy("target").agg(F.count("*").alias("n")).where("n > 1")


def problems(files: DataFrame, generators: list[Generator], robots: list[tuple[str, str, str]], root: str) -> DataFrame:
    """(place, problem) of a listing: folders of no known view, and generators that no robot of that embodiment claims."""
    spark = files.sparkSession
    known = F.broadcast(spark.createDataFrame([(g.name,) for g in generators], "generator string"))
    claims = F.broadcast(spark.createDataFrame(robots, "robot string, embodiment string, generator string"))
    view = F.concat_ws("/", "cache", "embodiment", F.lit("output"), "view")
    rows = _placed(files, root)
    odd = rows.where(~F.col("view").isin(*VIEWS)).select(view.alias("place"), F.lit("view unknown").alias("problem"))
    orphans = rows.where(F.col("view").isin(*VIEWS)).join(known, "generator").join(claims, ["embodiment", "generator"], "left_anti")
    return odd.unionByName(orphans.select(F.concat_ws("/", view, "generator").alias("place"), F.lit("no robot").alias("problem"))).distinct()


def declared(metadata: DataFrame, cell_rows: DataFrame, root: str) -> DataFrame:
    """``cell_rows`` with ``n_declared``: the count that a file (path, text) in its folder or the one above names.

    info.json goes before all_summary.json, the cell's own folder before the one above. The number is
    only told: it does not decide what counts.
    """
    names = [n for n, _ in DECLARED]
    name = F.element_at(F.split("path", "/"), -1)
    count = lambda keys: F.coalesce(*[F.when(F.get_json_object("text", f"$.{k}").rlike(r"^\d+$"), F.get_json_object("text", f"$.{k}").cast("long")) for k in keys])
    value = F.coalesce(*[F.when(name == n, count(keys)) for n, keys in DECLARED])
    told = metadata.where(name.isin(*names)).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.array_position(F.array(*map(F.lit, names)), name).alias("kind"), value.alias("value")).where("value is not null")
    own = cell_dir(root)
    dirs = cell_rows.select("*", F.posexplode(F.array(own, F.regexp_replace(own, "/[^/]*$", ""))).alias("level", "dir"))
    found_rows = dirs.join(told, "dir", "left").groupBy(*cell_rows.columns).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("kind") * 2 + F.col("level"))).alias("n_declared"))
    return found_rows


def cards(cell_rows: DataFrame, root: str) -> DataFrame:
    """(path, text): the card of each cell, JSON with its keys in order, at its place in the placed tree."""
    extra = ["n_declared"] if "n_declared" in cell_rows.columns else []
    body = F.struct(*PLACED, "embodiment", "iter", "n_episodes", "n_skipped", *extra, cell_dir(root).alias("source_path"))
    return cell_rows.select(F.concat_ws("/", *PLACED, F.lit(CARD)).alias("path"), F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))


def read_cards(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, problems) of card files (path, text): cells (cache, robot, view, generator, horizon, embodiment, iter), problems (place, problem) of cards that are no JSON or lack a key."""
    value = lambda k: F.get_json_object("text", f"$.{k}")
    readable = F.try_parse_json("text").isNotNull() & (F.get_json_object("text", "$").startswith("{"))
    missing = F.array_compact(F.array(*[F.when(value(k).isNull(), F.lit(k)) for k in CARD_KEYS]))
    rows = files.select("path", readable.alias("readable"), missing.alias("missing"), *[value(k).alias(k) for k in (*CARD_KEYS, "iter")])
    fine = F.col("readable") & (F.size("missing") == 0)
    said = F.when(F.col("readable"), F.concat(F.lit("missing: "), F.array_join("missing", ", "))).otherwise("unreadable")
    return rows.where(fine).select(*CARD_KEYS, "iter"), rows.where(~F.coalesce(fine, F.lit(False))).select(F.col("path").alias("place"), said.alias("problem"))
