"""Manifests built from files: what sources discover, what a probe says of each file, its hash, and tables that say their version."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.sources.manifest import capped, pairing_report

# The columns of a manifest in order, and names under which one is looked for.
COLUMNS = ("method", "family", "episode", "role", "path", "n_frames", "fps", "w", "h", "dt", "pair_key", "fps_probed", "dt_source", "codec", "sha1", "view_layout")
NAMES = ("bench_manifest.parquet", "bench_manifest.json")
VERSION = 1
#: What a source says of a clip before anything is probed.
DISCOVERED = "method string, family string, episode string, role string, path string, pair_key string, fps_hint double, view_layout string"

_STREAM = "streams array<struct<codec_type: string, codec_name: string, width: int, height: int, nb_frames: string, nb_read_frames: string, r_frame_rate: string, avg_frame_rate: string>>"


def probes(records: DataFrame) -> DataFrame:
    """(path, n_frames, fps_probed, w, h, codec) of probe records (path, text), JSON with the streams of a file; the first video counts.

    A rate is a fraction; one with a zero is no rate. Nulls where a record does not tell.
    """
    video = F.get(F.filter(F.from_json("text", _STREAM)["streams"], lambda s: F.coalesce(s["codec_type"], F.lit("video")) == "video"), F.lit(0))
    rows = records.select("path", video.alias("s"))
    part = lambda k: F.split_part("s.r_frame_rate", F.lit("/"), F.lit(k)).try_cast("double")
    rate = F.when((part(1) > 0) & (F.coalesce(part(2), F.lit(1.0)) > 0), part(1) / F.coalesce(part(2), F.lit(1.0)))
    frames = F.coalesce(F.col("s.nb_read_frames").try_cast("long"), F.col("s.nb_frames").try_cast("long"))
    return rows.select("path", frames.alias("n_frames"), rate.alias("fps_probed"), F.col("s.width").alias("w"), F.col("s.height").alias("h"), F.col("s.codec_name").alias("codec"))


def timebase(probed: Column, table: Column, fps: float | None = None, dt: float | None = None, tolerance: float = 0.01) -> Column:
    """(fps, dt_source, problem): the rate that is given for all (fps or dt), else of the table, else the probed one.

    One that is given must agree with the probed rate within ``tolerance``; it is never trusted unseen.
    """
    if fps is not None and dt is not None:
        raise ValueError("fps and dt exclude each other")
    told = F.lit(fps if fps is not None else 1 / dt if dt is not None else None).cast("double")
    given, source = (told, F.lit("fps_arg" if fps is not None else "dt_arg")) if fps is not None or dt is not None else (table, F.when(table.isNotNull(), "table").otherwise("ffprobe"))
    off = F.abs(given - probed) / probed > tolerance
    problem = F.when(probed.isNull(), F.when(given.isNull(), "no rate").otherwise("rate given but none probed")).when(off, F.concat(source, F.lit(" says "), F.format_number(given, 3), F.lit(", probed "), F.format_number(probed, 3)))
    return F.struct(F.when(problem.isNull(), F.coalesce(given, probed)).alias("fps"), source.alias("dt_source"), problem.alias("problem"))


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha1) of the bytes of each file below a path or glob."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha1("content").alias("sha1"))


def _judged(discovered: DataFrame, probed: DataFrame, hashed: DataFrame | None, **rate) -> DataFrame:
    rows = discovered.join(probed, "path", "left")
    rows = rows.join(hashed, "path", "left") if hashed is not None else rows.withColumn("sha1", F.lit(None).cast("string"))
    usable = F.when(F.col("n_frames").isNull() | F.col("w").isNull() | F.col("h").isNull(), "not probed").when((F.col("n_frames") <= 0) | (F.col("w") <= 0) | (F.col("h") <= 0), "unusable stream")
    base = timebase(F.col("fps_probed"), F.col("fps_hint"), **rate)
    rows = rows.withColumn("base", base)
    return rows.withColumn("problem", F.coalesce(usable, F.col("base.problem")))


def build(discovered: DataFrame, probed: DataFrame, hashed: DataFrame | None = None, cap: int | None = None, **rate) -> DataFrame:
    """The manifest (``COLUMNS``) of discovered clips that are probed and whose rates agree; at most ``cap`` of a family, by path.

    ``rate``: fps, dt and tolerance of :func:`timebase`. Clips that fall out are those of :func:`skipped`.
    """
    rows = _judged(discovered, probed, hashed, **rate).where("problem is null")
    rows = rows.select("*", F.col("base.fps").alias("fps"), (1 / F.col("base.fps")).alias("dt"), F.col("base.dt_source").alias("dt_source")).select(*COLUMNS)
    return rows if cap is None else capped(rows, cap)


def skipped(discovered: DataFrame, probed: DataFrame, **rate) -> DataFrame:
    """(pair_key, path, problem) of discovered clips that a manifest leaves out."""
    return _judged(discovered, probed, None, **rate).where("problem is not null").select("pair_key", "path", "problem")


def pairing_summary(rows: DataFrame) -> DataFrame:
    """One row (n_rows, n_families, n_pairs, n_mismatches, ok) of a manifest."""
    pairs = pairing_report(rows).agg(F.count("*").alias("n_pairs"), F.count_if(~(F.col("same_codec") & F.col("same_dt") & F.col("same_size"))).alias("n_mismatches"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("family").alias("n_families")).crossJoin(pairs).withColumn("ok", F.col("n_mismatches") == 0)  # one row each


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save(rows: DataFrame, folder: str, form: str = "parquet", report: DataFrame | None = None) -> str:
    """Write a manifest below ``folder`` as parquet or json with a header of its version and columns, and ``report`` as JSON lines; its path."""
    if form not in ("parquet", "json"):
        raise ValueError(f"form {form!r} is neither parquet nor json")
    path = f"{folder.rstrip('/')}/bench_manifest.{form}"
    whole = rows.select(*COLUMNS)
    (whole.write.mode("overwrite").parquet if form == "parquet" else whole.write.mode("overwrite").option("ignoreNullFields", "false").json)(f"{path}/rows")
    header = json.dumps({"version": VERSION, "form": form, "columns": list(COLUMNS)})
    rows.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    if report is not None:
        report.write.mode("overwrite").json(f"{folder.rstrip('/')}/pairing_report.json")
    return path


def load(spark: SparkSession, path: str) -> DataFrame:
    """A manifest that :func:`save` wrote, or a bare parquet or JSON file with its columns; raises for another version or for missing columns."""
    fs, at = _fs(spark, f"{path}/header")
    form, rows = "parquet" if path.rstrip("/").endswith(".parquet") else "json", path
    if fs.exists(at):
        header = json.loads(spark.read.text(f"{path}/header").first()["value"])
        if header.get("version") != VERSION:
            raise ValueError(f"{path} has version {header.get('version')}, not {VERSION}")
        form, rows = header["form"], f"{path}/rows"
    kinds = "method string, family string, episode string, role string, path string, n_frames long, fps double, w int, h int, dt double, pair_key string, fps_probed double, dt_source string, codec string, sha1 string, view_layout string"
    if form == "json":
        return spark.read.option("multiLine", rows == path).schema(kinds).json(rows)
    found = spark.read.parquet(rows)
    if missing := [c for c in COLUMNS if c not in found.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found.select(*COLUMNS)


def autodetect(spark: SparkSession, folder: str, required: bool = True) -> str | None:
    """The manifest in a folder: one under its usual names, else the first by name that says manifest; raises, or None, where there is none."""
    fs, at = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    for name in (*NAMES, *names):
        if name in names and "manifest" in name:
            return f"{folder.rstrip('/')}/{name}"
    if required:
        raise FileNotFoundError(f"no manifest in {folder}")
    return None
