"""Tables that are handed on: a row for each clip, grouped by where it lies, worst first, and a summary of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.operators import order
from strider.operators.stats import oriented

# The parts of a path that name a group, and what stands for them where a path has no such parts.
GROUP_PATTERN = "video_gen_physics/([^/]+)/([^/]+)/(?:input|output)/([^/]+)/([^/]+)/([^/]+)/"
UNMATCHED = "_unmatched"
#: The block of a clip, in order.
CLIP_COLUMNS = ("episode", "path", "role", "fps_probed", "dt", "n_frames", "width", "height", "codec")
RUN_COLUMNS = ("robot", "reader_id", "suite_id", "suite_name", "limit_semantics")


def group_of(path: Column) -> Column:
    """cache/embodiment/view/generator/horizon of a path, or its first two parts below ``UNMATCHED``."""
    parts = [F.regexp_extract(path, GROUP_PATTERN, i) for i in range(1, 6)]
    first = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, 2)
    return F.when(path.rlike(GROUP_PATTERN), F.concat_ws("/", *parts)).otherwise(F.array_join(F.concat(F.array(F.lit(UNMATCHED)), first), "/"))


def below(path: Column, root: str) -> Column:
    """A path as seen from ``root``; unchanged if it lies elsewhere."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path)


def clip_rows(results: DataFrame, manifest: DataFrame, root: str, unscored_reason: str | None = None) -> DataFrame:
    """A row for each result that has a path: group, clip and run columns, metrics, status and failure_reason.

    What a result does not say of its clip the manifest does. With ``unscored_reason`` the rows of
    the manifest that no result has follow, as skipped.
    """
    known = manifest.select(F.col("path").alias("__path"), *[F.col(c).alias(f"__{c}") for c in manifest.columns if c in CLIP_COLUMNS and c != "path"])
    own = lambda c: F.coalesce(F.col(f"clip.{c}"), F.col(f"__{c}")) if f"__{c}" in known.columns else F.col(f"clip.{c}")
    met = results.where("clip.path is not null").join(known, F.col("clip.path") == F.col("__path"), "left")
    why = F.when(F.col("status") == "failed", F.coalesce(F.array_min(F.map_values("metrics_unavailable")), F.lit(""))).otherwise("")
    rel = below(F.col("clip.path"), root)
    rows = met.select(
        group_of(rel).alias("group"), *[rel.alias("path") if c == "path" else own(c).alias(c) for c in CLIP_COLUMNS], *[F.coalesce(F.col(f"run.{c}"), F.lit("")).alias(c) for c in RUN_COLUMNS],
        "metrics", "metrics_unavailable", F.coalesce("status", F.lit("unknown")).alias("status"), why.alias("failure_reason"),
    )
    if unscored_reason is None:
        return rows
    rest = manifest.where("path is not null").join(results.select(F.col("clip.path").alias("path")).distinct(), "path", "left_anti")
    rel = below(F.col("path"), root)
    kinds = dict(rows.dtypes)
    field = lambda c: rel.alias(c) if c == "path" else (F.col(c) if c in manifest.columns else F.lit(None)).cast(kinds[c]).alias(c)
    return rows.unionByName(rest.select(
        group_of(rel).alias("group"), *map(field, CLIP_COLUMNS), *[F.lit("").alias(c) for c in RUN_COLUMNS], *[F.create_map().cast(kinds[c]).alias(c) for c in ("metrics", "metrics_unavailable")],
        F.lit("skipped").alias("status"), F.lit(unscored_reason).alias("failure_reason"),
    ))


def worst_first(rows: DataFrame, metric: str, direction: str) -> DataFrame:
    """``rows`` with ``place``, from 0 on, in their group: worst by a metric first, those without a value last, ties by path.

    Places are running sums over sorted ranges, so a group of any size is no task.
    """
    bad = oriented(F.col("metrics")[metric], F.lit(direction))
    keyed = rows.withColumn("__none", bad.isNull()).withColumn("__good", -F.coalesce(bad, F.lit(0.0))).withColumn("__one", F.lit(1))
    return order.running_sums(keyed, ["group"], ["__none", "__good", "path"], {"place": "__one"}).drop("__none", "__good", "__one")


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per group: counts by status, the run if it is one, the rate if it is one, and the median of each metric over its values."""
    same = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    value = lambda m: F.col("metrics")[m]
    return rows.groupBy("group").agg(
        F.count("*").alias("n_clips"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "failed", "skipped")],
        *[F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), "|").alias(c) for c in ("robot", "reader_id", "suite_id")],
        same("fps_probed").alias("fps"), *[F.median(F.when(~F.isnan(value(m)), value(m))).alias(f"median_{m}") for m in metrics],
    )


def rates_differ(summaries: DataFrame) -> bool:
    """Whether groups have different rates, so that metrics that scale with the rate do not compare."""
    return summaries.agg(F.count_distinct("fps")).first()[0] > 1


def said(value: Column) -> Column:
    """A number with five digits, empty for null and NaN: a missing value is never 0."""
    return F.when(value.isNull() | F.isnan(value), "").otherwise(F.format_number(value, 5))


def write_clips(rows: DataFrame, metrics: list[str], uri: str, sort_by: str, direction: str) -> None:
    """CSV files of the rows, a folder for each group, worst first in each file; groups of any size are dealt to several."""
    flat = rows.select(*[c for c in rows.columns if not c.startswith("metrics")], *[F.col("metrics")[m].alias(m) for m in metrics])
    bad = oriented(F.col(sort_by), F.lit(direction))
    flat.repartitionByRange("group", bad).sortWithinPartitions("group", bad.desc_nulls_last(), "path").write.partitionBy("group").option("header", True).mode("overwrite").csv(uri)


def write_summary(summaries: DataFrame, uri: str) -> None:
    """One CSV file: a row per group."""
    summaries.coalesce(1).sortWithinPartitions("group").write.option("header", True).mode("overwrite").csv(uri)
