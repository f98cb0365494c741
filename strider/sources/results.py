"""The store of results: JSON lines of scored clips, appended by runs and read as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATUSES = ("ok", "skipped", "failed")
#: One line of the store.
SCHEMA = (
    "schema_version int, status string, "
    "clip struct<path:string,episode:string,role:string,method:string,fps_probed:double,dt:double,n_frames:int,width:int,height:int,codec:string>, "
    "run struct<robot:string,reader_id:string,limit_semantics:string,suite_id:string,suite_name:string>, "
    "coverage struct<n_frames_scored:int,gate_coverage:double>, metrics map<string,double>, metrics_unavailable map<string,string>"
)
#: What tells results apart: the same clip may be scored by other readers and suites.
KEY = ("path", "suite_id", "reader_id")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a store; a folder that is not there yet has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(SCHEMA).json(path) if there else spark.createDataFrame([], SCHEMA)


def conformed(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns and fields of ``SCHEMA``, null where they lack one; others are left out."""
    def field(at: str, f: T.StructField, given: T.StructType | None):
        have = given is not None and f.name in given.fieldNames()
        if isinstance(f.dataType, T.StructType):
            inner = given[f.name].dataType if have else None
            made = F.struct(*[field(f"{at}{f.name}.", g, inner) for g in f.dataType.fields])
            return (F.when(F.col(at + f.name).isNotNull(), made) if have else F.lit(None).cast(f.dataType)).alias(f.name)
        return (F.col(at + f.name) if have else F.lit(None)).cast(f.dataType).alias(f.name)

    wanted = T.StructType.fromDDL(SCHEMA)
    return rows.select(*[field("", f, rows.schema) for f in wanted.fields])


def append_results(rows: DataFrame, path: str) -> None:
    """Add lines to a store, as files of their own that are committed together."""
    conformed(rows).write.mode("append").json(path)


def truncate(spark: SparkSession, path: str) -> None:
    """Leave a store without lines."""
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").json(path)


def flatten(results: DataFrame) -> DataFrame:
    """``results`` without nesting: a column ``block_field`` for each field of a block; maps stay."""
    out = []
    for f in results.schema.fields:
        nested = getattr(f.dataType, "fields", None)
        out += [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") for g in nested] if nested else [F.col(f.name)]
    return results.select(*out)


def keys(results: DataFrame) -> DataFrame:
    """(path, suite_id, reader_id) of each line once."""
    return results.select(F.col("clip.path").alias("path"), F.col("run.suite_id").alias("suite_id"), F.col("run.reader_id").alias("reader_id")).distinct()


def metric_rows(results: DataFrame) -> DataFrame:
    """(path, suite_id, reader_id, status, metric, value, reason): each metric of each line, with a value or the reason for none."""
    names = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    each = F.explode(F.array_union(names("metrics"), names("metrics_unavailable"))).alias("metric")
    value = F.col("metrics")[F.col("metric")]
    return results.select("clip", "run", "status", "metrics", "metrics_unavailable", each).select(
        F.col("clip.path").alias("path"), F.col("run.suite_id").alias("suite_id"), F.col("run.reader_id").alias("reader_id"), "status", "metric", value.alias("value"),
        F.when(value.isNull(), F.col("metrics_unavailable")[F.col("metric")]).alias("reason"),
    )


def unscored(manifest: DataFrame, results: DataFrame, suite_id: str, reader_id: str) -> DataFrame:
    """Rows of ``manifest`` whose path this suite and reader have not scored: what a resumed run still does."""
    done = keys(results).where((F.col("suite_id") == suite_id) & (F.col("reader_id") == reader_id)).select("path")
    return manifest.join(done, "path", "left_anti")


def failed(clips: DataFrame, run: dict[str, str], metrics: list[str], error: str) -> DataFrame:
    """A line for each of ``clips`` (columns of the clip block) that failed before it was scored: all metrics of the suite without a value, the error their reason."""
    block = F.struct(*[F.col(c) for c in clips.columns])
    names = F.array(*map(F.lit, metrics))
    return clips.select(
        F.lit(1).alias("schema_version"), F.lit("failed").alias("status"), block.alias("clip"), F.struct(*[F.lit(v).alias(k) for k, v in run.items()]).alias("run"),
        F.struct(F.lit(0).alias("n_frames_scored"), F.lit(0.0).alias("gate_coverage")).alias("coverage"),
        F.map_from_arrays(names, F.array_repeat(F.lit(None).cast("double"), len(metrics))).alias("metrics"), F.map_from_arrays(names, F.array_repeat(F.lit(error), len(metrics))).alias("metrics_unavailable"),
    )


def key_sets(results: DataFrame) -> DataFrame:
    """(suite_id, metrics, n): the sets of metric names that the lines of a suite have, joined by commas."""
    named = F.array_join(F.array_sort(F.map_keys(F.coalesce("metrics", F.create_map().cast("map<string,double>")))), ",")
    return results.groupBy(F.col("run.suite_id").alias("suite_id"), named.alias("metrics")).agg(F.count("*").alias("n"))


def assert_uniform(results: DataFrame) -> None:
    """Raises if lines of one suite have different metrics."""
    bad = key_sets(results).groupBy("suite_id").agg(F.sort_array(F.collect_list("metrics")).alias("sets")).where(F.size("sets") > 1).head(1)
    if bad:
        raise ValueError(f"lines of suite {bad[0]['suite_id']!r} have different metrics: {bad[0]['sets']}")


def scores(manifest: DataFrame, results: DataFrame) -> DataFrame:
    """(manifest columns, metric, value, reason, suite_id): manifest and results joined by path; identities as strings."""
    own = manifest.select(*[F.col(c).cast("string").alias(c) if c in ("method", "episode", "role", "family") else F.col(c) for c in manifest.columns])
    return own.join(metric_rows(results).select("path", "suite_id", "metric", "value", "reason"), "path")
