"""The reference of real motion: baselines, quantiles and feature Gaussians, and how far clips are from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.operators import order

#: Quantiles of a profile.
QUANTILES = 100
#: How far above its baseline a term may be, as a multiple of it and for shares, until it counts in full.
TOLERANCE, SHARE_TOLERANCE = 3.0, 0.1
# Least floors of terms in millimetres and of all others.
FLOOR_MM, FLOOR = 0.5, 1e-3


def baselines(terms: DataFrame) -> DataFrame:
    """(metric, base, floor) of long rows (clip, metric, value): the median, and the median absolute deviation or more."""
    fine = terms.where(F.col("value").isNotNull() & ~F.isnan("value"))
    base = fine.groupBy("metric").agg(F.median("value").alias("base"))
    off = fine.join(F.broadcast(base), "metric").groupBy("metric").agg(F.first("base").alias("base"), F.median(F.abs(F.col("value") - F.col("base"))).alias("mad"))
    least = F.when(F.col("metric").endswith("_mm"), FLOOR_MM).otherwise(FLOOR)
    return off.select("metric", "base", F.greatest("mad", least).alias("floor"))


def term_score(metric: Column, value: Column, base: Column, floor: Column) -> Column:
    """0 at the baseline or below, 1 at the tolerance or above; null for no value."""
    scale = F.greatest(base, floor) * (TOLERANCE - 1)
    x = F.when(metric.endswith("_frac"), (value - base) / SHARE_TOLERANCE).otherwise((value - base) / F.when(scale > 0, scale).otherwise(1e-12))
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def invariance(terms: DataFrame, reference: DataFrame, policy: str = "strict") -> DataFrame:
    """(clip, n_terms, n_missing, score): the mean term score of each clip against :func:`baselines`.

    A term of the reference that a clip lacks leaves it without a score (``strict``), or is left out
    of the mean (``available``).
    """
    if policy not in ("strict", "available"):
        raise ValueError(f"no policy: {policy}")
    clips = terms.select("clip").distinct()
    wanted = clips.crossJoin(F.broadcast(reference))  # the reference has a row per registered metric
    fine = terms.where(F.col("value").isNotNull() & ~F.isnan("value"))
    rows = wanted.join(fine, ["clip", "metric"], "left").withColumn("s", term_score(F.col("metric"), F.col("value"), F.col("base"), F.col("floor")))
    sums = rows.groupBy("clip").agg(F.count("s").alias("n_terms"), F.count_if(F.col("s").isNull()).alias("n_missing"), F.avg("s").alias("score"))
    return sums if policy == "available" else sums.withColumn("score", F.when(F.col("n_missing") == 0, F.col("score")))


def quantiles(samples: DataFrame, by: list[str], n: int = QUANTILES) -> DataFrame:
    """(by, profile): ``n`` evenly spaced quantiles of ``value``, over all samples."""
    return order.profiles(samples, by, "value", n)


def profile_distance(a: Column, b: Column) -> Column:
    """The first Wasserstein distance of two profiles: the mean difference of their quantiles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def wasserstein(samples: DataFrame, reference: DataFrame, n: int = QUANTILES) -> DataFrame:
    """(clip, quantity, w1) of (clip, quantity, value) against (quantity, profile)."""
    own = quantiles(samples, ["clip", "quantity"], n)
    ref = F.broadcast(reference.select("quantity", F.col("profile").alias("__ref")))  # a row per quantity
    return own.join(ref, "quantity").select("clip", "quantity", profile_distance(F.col("profile"), F.col("__ref")).alias("w1"))


@dataclass(frozen=True)
class Gaussian:
    """Mean and covariance of features, and the number of clips they are of."""

    mean: np.ndarray
    cov: np.ndarray
    n: int


def features(samples: DataFrame) -> DataFrame:
    """(clip, quantity, mean, std): of each quantity its mean and population deviation."""
    return samples.groupBy("clip", "quantity").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def feature_gaussian(samples: DataFrame, quantities: list[str], single: str = "zeros") -> Gaussian:
    """Mean and covariance of (mean, std per quantity) over clips; of one clip the covariance is zeros or ``identity``.

    Sums run in Spark; a row of 2 * len(quantities) moments squared comes to the driver.
    """
    pick = [F.max(F.when(F.col("quantity") == q, F.col(c))).alias(f"{q}:{c}") for q in quantities for c in ("mean", "std")]
    wide = features(samples).groupBy("clip").agg(*pick)
    cols = [f"`{q}:{c}`" for q in quantities for c in ("mean", "std")]
    d = len(cols)
    row = wide.agg(F.count("*").alias("n"), *[F.avg(c) for c in cols], *[F.covar_samp(a, b) for i, a in enumerate(cols) for b in cols[i:]]).first()
    mean, cov = np.array([np.nan if x is None else x for x in row[1 : d + 1]], float), np.zeros((d, d))
    if row["n"] > 1:
        cov[np.triu_indices(d)] = row[d + 1 :]
        cov = cov + np.triu(cov, 1).T
    elif single == "identity":
        cov = np.eye(d)
    return Gaussian(mean, cov, row["n"])


def frechet(a: Gaussian, b: Gaussian, symmetrise: bool = False) -> float:
    """The squared Fréchet distance of two Gaussians; ``symmetrise`` takes the root of the symmetric part of the product."""
    product = a.cov @ b.cov
    roots = np.linalg.eigvalsh((product + product.T) / 2) if symmetrise else np.linalg.eigvals(product).real
    cross = np.sqrt(np.maximum(roots, 0)).sum()
    return float(((a.mean - b.mean) ** 2).sum() + np.trace(a.cov) + np.trace(b.cov) - 2 * cross)


def same_rate(dt: float, reference_dt: float, allow_mismatch: bool = False) -> bool:
    """Whether two frame times agree to a millionth; raises if not, unless allowed."""
    same = abs(dt - reference_dt) <= 1e-6 * abs(reference_dt)
    if not same and not allow_mismatch:
        raise ValueError(f"frame time {dt} does not match the reference's {reference_dt}")
    return same
