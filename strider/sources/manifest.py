"""Manifests of clips: probing order, caps, pairing checks, resume and path groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capped(rows: DataFrame, cap: int, family: str = "family", order: str = "path") -> DataFrame:
    """At most ``cap`` accepted rows of each family, in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(family).orderBy(order))).where(F.col("__n") <= cap).drop("__n")


def unscored(manifest: DataFrame, results: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the manifest that no result has: what a resumed run still scores."""
    return manifest.join(results, key, "left_anti")


def pairing_report(rows: DataFrame, rel_tol: float = 0.01) -> DataFrame:
    """Per pair_key, the first gt and pred by path: whether size, codec and frame time agree."""
    first = lambda r: F.min_by(F.struct("codec", "dt", "w"), F.when(F.col("role") == r, F.col("path"))).alias(r)
    both = rows.groupBy("pair_key").agg(first("gt"), first("pred"), F.count_if(F.col("role") == "gt").alias("n_gt"), F.count_if(F.col("role") == "pred").alias("n_pred")).where("n_gt > 0 and n_pred > 0")
    near = F.abs(F.col("gt.dt") - F.col("pred.dt")) <= rel_tol * F.greatest(F.abs("gt.dt"), F.abs("pred.dt"))
    return both.select("pair_key", (F.col("gt.codec") == F.col("pred.codec")).alias("same_codec"), near.alias("same_dt"), (F.col("gt.w") == F.col("pred.w")).alias("same_size"))


def clip_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the identity, its parts set apart by U+241F, null as empty."""
    return F.substring(F.sha1(F.concat_ws("␟", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, 16)


def episode_name(raw: Column) -> Column:
    clean = F.replace(F.replace(raw, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))
    return F.when(clean.startswith("episode_"), clean).otherwise(F.concat(F.lit("episode_"), clean))


def cells(axes: list[DataFrame], excluded: list[dict[str, str]]) -> DataFrame:
    """The product of the axes with ``na``: whether a rule, matched on the axes it names, excludes the cell."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(a)
    na = F.lit(False)
    for rule in excluded:
        fits = F.lit(True)
        for k, v in rule.items():
            fits = fits & (F.col(k) == v)
        na = na | fits
    return out.withColumn("na", F.coalesce(na, F.lit(False)))
