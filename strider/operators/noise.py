"""Noise floors: clips are measured again after a change that means nothing, and what that alone moves is the floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.operators import order
from strider.sources.shared import stored

# The metrics of a floor, and from which setting on and by how many an episode's own is chosen.
METRICS = ("mean_jerk_mps3", "mean_accel_mps2", "mean_speed_mps")
BASE, SPAN = 23, 12


def setting(episode: Column, base: int = BASE, span: int = SPAN) -> Column:
    """The setting of the second measurement: ``base`` and the first number in an episode's name modulo ``span``; ``base`` without a number."""
    number = F.regexp_extract(F.coalesce(episode.cast("string"), F.lit("")), "([0-9]+)", 1).try_cast("decimal(38,0)")
    return (F.lit(base) + F.coalesce(number % span, F.lit(0))).cast("int")


def unmeasured(clips: DataFrame, done: DataFrame, base: int = BASE, span: int = SPAN) -> DataFrame:
    """The clips (episode, path, ...) with ``setting`` that have no second measurement (path, setting) yet."""
    wanted = clips.withColumn("setting", setting(F.col("episode"), base, span))
    return wanted.join(done.select("path", "setting").distinct(), ["path", "setting"], "left_anti")


def pairs(first: DataFrame, again: DataFrame, metrics: tuple[str, ...] = METRICS, base: int = BASE, span: int = SPAN) -> DataFrame:
    """(path, episode, setting, metric, first, again, delta) for each clip of ``first`` and each metric.

    ``first``: (path, episode, values), a map by metric; ``again``: (path, setting, values). A value
    that one of them lacks is null, and so is the delta; a delta that is not finite is null. Of a
    clip measured twice at one setting the smallest value counts.
    """
    told = F.explode(F.array(*map(F.lit, metrics))).alias("metric")
    own = first.select("path", "episode", setting(F.col("episode"), base, span).alias("setting"), "values", told).select("path", "episode", "setting", "metric", F.col("values")[F.col("metric")].cast("double").alias("first"))
    second = again.select(F.col("path").alias("__p"), F.col("setting").alias("__s"), F.explode("values").alias("__m", "v")).groupBy("__p", "__s", "__m").agg(F.min(F.col("v").cast("double")).alias("again"))
    met = own.join(second, (F.col("path") == F.col("__p")) & (F.col("setting") == F.col("__s")) & (F.col("metric") == F.col("__m")), "left")
    delta = F.col("again") - F.col("first")
    return met.select("path", "episode", "setting", "metric", "first", "again", F.when(~F.isnan(delta) & (F.abs(delta) < float("inf")), delta).alias("delta"))


def floors(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, n, null_mean, null_median, null_std, null_p95, null_abs_median) of the deltas of :func:`pairs`; a group without any has n 0 and nulls.

    null_p95 is the 95th percentile of their sizes. Percentiles are exact and no group is one task's.
    """
    by = by or ["metric"]
    rows = stored(rows.select(*by, "delta"), "deltas")  # sums, brackets and what lies in them read it
    sums = rows.groupBy(*by).agg(F.count("delta").alias("n"), F.avg("delta").alias("null_mean"), F.stddev_pop("delta").alias("null_std"))
    middle = order.percentile(rows, by, "delta", 0.5, "null_median")
    sized = order.percentiles(rows.withColumn("size", F.abs("delta")), by, "size", [0.5, 0.95])
    sizes = sized.groupBy(*by).agg(F.max(F.when(F.col("p") > 0.9, F.col("q"))).alias("null_p95"), F.max(F.when(F.col("p") < 0.9, F.col("q"))).alias("null_abs_median"))
    met = sums
    for part in (middle, sizes):
        met = met.join(part, by, "left")
    return met.select(*by, "n", "null_mean", "null_median", "null_std", "null_p95", "null_abs_median")


def units(delta: Column, floor: Column) -> Column:
    """A delta in floors; null where the floor is zero, not finite or not known."""
    return F.when((floor != 0) & ~F.isnan(floor) & (F.abs(floor) < float("inf")), F.abs(delta) / floor)


def below(delta: Column, floor: Column) -> Column:
    """Whether a delta is not told from noise: less than one floor, or the floor is not known."""
    u = units(delta, floor)
    return ~F.coalesce((u >= 1) & ~F.isnan(u) & (u < float("inf")), F.lit(False))


def judged(taxes: DataFrame, floor: DataFrame) -> DataFrame:
    """``taxes`` (metric, tax, ...) with noise_floor, noise_units and below_floor, from :func:`floors` by metric."""
    known = F.broadcast(floor.select("metric", F.col("null_p95").alias("noise_floor")))  # a row a metric
    met = taxes.join(known, "metric", "left")
    return met.withColumn("noise_units", units(F.col("tax"), F.col("noise_floor"))).withColumn("below_floor", below(F.col("tax"), F.col("noise_floor")))
