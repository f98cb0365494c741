"""Robot description files (URDF) as a source: tables of links and joints, and what is wrong with a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.sources.shared import stored

# Kinds of joints that move, those that need limits, the axis of a joint that names none, and the speed limit of one that names none.
MOVING, LIMITED = ("revolute", "continuous", "prismatic"), ("revolute", "prismatic")
DEFAULT_AXIS, DEFAULT_SPEED = (0.0, 0.0, 1.0), 1000.0

_ORIGIN = "origin: struct<_xyz: string, _rpy: string>"
_SCHEMA = f"""_name string,
  link array<struct<_name: string,
    inertial: struct<{_ORIGIN}, mass: struct<_value: string>, inertia: struct<_ixx: string, _ixy: string, _ixz: string, _iyy: string, _iyz: string, _izz: string>>,
    collision: array<struct<{_ORIGIN}, geometry: struct<cylinder: struct<_radius: string, _length: string>, sphere: struct<_radius: string>>>>>>,
  joint array<struct<_name: string, _type: string, {_ORIGIN}, parent: struct<_link: string>, child: struct<_link: string>, axis: struct<_xyz: string>,
    limit: struct<_lower: string, _upper: string, _velocity: string, _effort: string>>>,
  _corrupt_record string"""


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, text) of each description file below a path or glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))


def parsed(files: DataFrame) -> DataFrame:
    """(path, sha256, robot, links, joints, readable) of files (path, text); the name of a robot that gives none is its path."""
    sha = F.col("sha256") if "sha256" in files.columns else F.sha2("text", 256)
    x = F.from_xml("text", _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = files.select("path", sha.alias("sha256"), x.alias("x"), F.coalesce(F.trim("text"), F.lit("")).alias("text"))
    readable = (F.col("text") != "") & F.col("x._corrupt_record").isNull() & F.col("x").isNotNull()
    items = lambda c: F.coalesce(F.col(f"x.{c}"), F.array())
    return rows.select("path", "sha256", F.coalesce("x._name", "path").alias("robot"), items("link").alias("links"), items("joint").alias("joints"), readable.alias("readable"))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _three(text: Column, default: tuple = (0.0, 0.0, 0.0)) -> Column:
    """Three numbers of a text; null where it is not that; the default where there is no text."""
    values = F.transform(F.split(F.trim(text), r"\s+"), lambda v: v.try_cast("double"))
    fine = (F.size(values) == 3) & F.forall(values, lambda v: v.isNotNull())
    return F.when(text.isNull(), F.array(*map(F.lit, default))).when(fine, values)


def links(robots: DataFrame) -> DataFrame:
    """(robot, at, link, mass, com, com_rpy, inertia, shapes) of :func:`parsed` files; at is the place in the file.

    mass, com and inertia (about the centre of mass, in the axes that com_rpy turns) are null unless
    all are given and the mass is positive. shapes: (kind, xyz, rpy, radius, length) of cylinders and spheres.
    """
    one = robots.select("robot", F.posexplode("links").alias("at", "l")).select("robot", "at", "l.*")
    i = F.col("inertial.inertia")
    tensor = F.array(*[_number(i[f"_i{c}"]) for c in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")])
    mass = _number(F.col("inertial.mass._value"))
    whole = (mass > 0) & i.isNotNull()
    origin = lambda o, c: _three(o[c])
    shape = lambda c: F.struct(
        F.when(c["geometry"]["cylinder"].isNotNull(), "cylinder").when(c["geometry"]["sphere"].isNotNull(), "sphere").alias("kind"),
        origin(c["origin"], "_xyz").alias("xyz"), origin(c["origin"], "_rpy").alias("rpy"),
        _number(F.coalesce(c["geometry"]["cylinder"]["_radius"], c["geometry"]["sphere"]["_radius"])).alias("radius"), _number(c["geometry"]["cylinder"]["_length"]).alias("length"),
    )
    return one.select(
        "robot", "at", F.col("_name").alias("link"), F.when(whole, mass).alias("mass"), F.when(whole, origin(F.col("inertial.origin"), "_xyz")).alias("com"),
        F.when(whole, origin(F.col("inertial.origin"), "_rpy")).alias("com_rpy"), F.when(whole, tensor).alias("inertia"),
        F.filter(F.transform(F.coalesce("collision", F.array()), shape), lambda s: s["kind"].isNotNull()).alias("shapes"),
    )


def joints(robots: DataFrame) -> DataFrame:
    """(robot, at, joint, kind, parent, child, xyz, rpy, axis, lower, upper, velocity, effort) of :func:`parsed` files.

    axis has unit length (the z axis where none is given). Limits are null where the file names none.
    """
    one = robots.select("robot", F.posexplode("joints").alias("at", "j")).select("robot", "at", "j.*")
    axis = _three(F.col("axis._xyz"), DEFAULT_AXIS)
    size = F.sqrt(F.aggregate(axis, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.when(size > 1e-12, F.transform(axis, lambda x: x / size)).otherwise(axis)
    limit = [_number(F.col(f"limit._{c}")).alias(c) for c in ("lower", "upper", "velocity", "effort")]
    return one.select(
        "robot", "at", F.col("_name").alias("joint"), F.col("_type").alias("kind"), F.col("parent._link").alias("parent"), F.col("child._link").alias("child"),
        _three(F.col("origin._xyz")).alias("xyz"), _three(F.col("origin._rpy")).alias("rpy"), unit.alias("axis"), *limit,
    )


def _placed(pairs: Column) -> Column:
    """Links reached from the roots along (parent, child), each with the moving joints above it: a round for each level, the rounds left then do nothing."""
    children, parents = F.transform(pairs, lambda j: j["child"]), F.transform(pairs, lambda j: j["parent"])
    roots = F.transform(F.array_except(parents, children), lambda x: F.struct(x.alias("link"), F.lit(0).alias("depth")))

    def grow(state: Column, _: Column) -> Column:
        known, last = state["known"], state["last"]
        names, ends = F.transform(known, lambda k: k["link"]), F.transform(last, lambda k: k["link"])
        new = F.filter(pairs, lambda j: F.array_contains(ends, j["parent"]) & ~F.array_contains(names, j["child"]))
        above = lambda j: F.aggregate(last, F.lit(0), lambda s, k: F.when(k["link"] == j["parent"], k["depth"]).otherwise(s))
        found = F.transform(new, lambda j: F.struct(j["child"].alias("link"), (above(j) + j["moves"]).alias("depth")))
        # A variable of a lambda has its value once: what is found is not worked out again for each of its uses.
        grown = F.get(F.transform(F.array(found), lambda f: F.struct(F.concat(known, f).alias("known"), f.alias("last"))), F.lit(0))
        return F.when(F.size(last) == 0, state).otherwise(grown)

    rounds = F.when(F.size(pairs) > 0, F.sequence(F.lit(1), F.size(pairs))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.struct(roots.alias("known"), roots.alias("last")), grow, lambda s: s["known"])


def _edges(joint_table: DataFrame) -> DataFrame:
    edge = F.struct("at", "parent", "child", F.col("kind").isin(*MOVING).cast("int").alias("moves"))
    return joint_table.where("parent is not null and child is not null").groupBy("robot").agg(F.array_sort(F.collect_list(edge)).alias("pairs"))


def depths(joint_table: DataFrame) -> DataFrame:
    """(robot, link, depth): the moving joints between a link and its root; links that no root reaches have no row."""
    return _edges(joint_table).select("robot", F.inline(_placed(F.col("pairs"))))


def problems(robots: DataFrame) -> DataFrame:
    """(robot, problem) of :func:`parsed` files; a sound file has no row.

    unreadable, no_links, duplicate_link:x, duplicate_joint:x, no_parent:j, no_child:j, unknown_link:x,
    two_parents:x, several_roots, no_root, unreachable:x, no_limit:j and empty_range:j of joints that need
    limits, not_a_number:x of an origin, axis, limit or inertia that is there but no number.
    """
    robots = stored(robots, "robots")  # each kind of problem reads the files, which are parsed once
    fine, link_table, joint_table = robots.where("readable"), links(robots.where("readable")), joints(robots.where("readable"))
    said = lambda df, problem: df.select("robot", problem.alias("problem"))
    of = lambda what, name: F.concat(F.lit(f"{what}:"), F.coalesce(F.col(name), F.lit("")))
    repeated = lambda df, name, what: said(df.groupBy("robot", name).count().where("count > 1"), of(what, name))
    names = link_table.select("robot", "link").distinct()
    ends = joint_table.select("robot", F.explode(F.array("parent", "child")).alias("link")).where("link is not null").distinct()
    roots = names.join(joint_table.select("robot", F.col("child").alias("link")).where("link is not null").distinct(), ["robot", "link"], "left_anti").groupBy("robot").count()
    whole = joint_table.where("parent is not null and child is not null").select("robot", F.explode(F.array("parent", "child")).alias("link")).distinct()
    reached = depths(joint_table).select("robot", "link").unionByName(names.join(whole, ["robot", "link"], "left_anti"))
    raw = fine.select("robot", F.explode("joints").alias("j")).select("robot", "j.*")
    bad_joint = F.lit(False)
    for text, number in (("origin._xyz", _three), ("origin._rpy", _three), ("axis._xyz", _three), *[(f"limit._{c}", _number) for c in ("lower", "upper", "velocity", "effort")]):
        bad_joint = bad_joint | (F.col(text).isNotNull() & number(F.col(text)).isNull())
    parts = [
        said(robots.where("not readable"), F.lit("unreadable")), said(fine.where("size(links) = 0"), F.lit("no_links")),
        repeated(link_table, "link", "duplicate_link"), repeated(joint_table, "joint", "duplicate_joint"),
        said(joint_table.where("parent is null"), of("no_parent", "joint")), said(joint_table.where("child is null"), of("no_child", "joint")),
        said(ends.join(names, ["robot", "link"], "left_anti"), of("unknown_link", "link")),
        repeated(joint_table.where("child is not null"), "child", "two_parents"),
        said(roots.where("count > 1"), F.lit("several_roots")),
        said(fine.where("size(links) > 0").join(roots, "robot", "left_anti"), F.lit("no_root")),
        said(names.join(reached, ["robot", "link"], "left_anti"), of("unreachable", "link")),
        said(joint_table.where(F.col("kind").isin(*LIMITED) & F.col("lower").isNull() & F.col("upper").isNull()), of("no_limit", "joint")),
        said(joint_table.where(F.col("kind").isin(*LIMITED) & (F.coalesce("lower", F.lit(0.0)) > F.coalesce("upper", F.lit(0.0)))), of("empty_range", "joint")),
        said(raw.where(bad_joint), F.concat(F.lit("not_a_number:"), F.coalesce("_name", F.lit("")))),
        said(link_table.where("mass is not null and (com is null or com_rpy is null or exists(inertia, v -> v is null))"), of("not_a_number", "link")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def joint_limits(joint_table: DataFrame, margin: float = 0.0) -> DataFrame:
    """(robot, joint, lower, upper, velocity, effort) of joints that need limits and name some: ``margin`` wider, a speed that is not named is ``DEFAULT_SPEED``, an effort that is not named stays null."""
    rows = joint_table.where(F.col("kind").isin(*LIMITED) & (F.col("lower").isNotNull() | F.col("upper").isNotNull()))
    bound = lambda c, m: (F.coalesce(c, F.lit(0.0)) + m).alias(c)
    return rows.select("robot", "joint", bound("lower", -margin), bound("upper", margin), F.coalesce("velocity", F.lit(DEFAULT_SPEED)).alias("velocity"), "effort")
