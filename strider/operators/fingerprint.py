"""The stored reference of real motion: a table with a version that is built from terms and samples, saved, loaded, and refused across rates or suites."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators import reference
from strider.operators.reference import Gaussian
from strider.operators.suites import Suite

#: The form that is written; the older one has no number and no frame time.
SCHEMA, OLDER = 2, "legacy:v1"
_OLD_KEYS = ("inv_baseline", "quantiles", "feat_mu", "feat_cov", "quantity_keys", "n_q")
_ROWS = "kind string, key string, i int, j int, value double, text string"


@dataclass(frozen=True)
class Reference:
    """dt, identity of the suite, (base, floor) of each term, quantiles of each quantity, and the Gaussian of clips' features.

    Its size follows the suite, not the clips, so it is held whole.
    """

    dt: float
    suite_id: str
    terms: dict[str, tuple[float, float]]
    quantiles: dict[str, tuple[float, ...]]
    gaussian: Gaussian
    quantity_keys: tuple[str, ...]
    schema: int = SCHEMA
    single: str = field(default="identity", compare=False)

    def table(self, spark: SparkSession) -> DataFrame:
        """(metric, base, floor), as :func:`strider.operators.reference.invariance` takes it."""
        return spark.createDataFrame([(k, b, f) for k, (b, f) in self.terms.items()], "metric string, base double, floor double")

    def profiles(self, spark: SparkSession) -> DataFrame:
        """(quantity, profile), as :func:`strider.operators.reference.wasserstein` takes it."""
        return spark.createDataFrame([(k, list(q)) for k, q in self.quantiles.items()], "quantity string, profile array<double>")


def build(terms: DataFrame, samples: DataFrame, suite: Suite, dt: float, n: int = reference.QUANTILES) -> Reference:
    """The reference of real clips: terms (clip, metric, value) of the suite's invariant metrics, samples (clip, quantity, value).

    Raises for a term that no clip has a value for.
    """
    found = {r.metric: (r.base, r.floor) for r in reference.baselines(terms.where(F.col("metric").isin(*suite.invariant))).collect()}
    if missing := [k for k in suite.invariant if k not in found]:
        raise ValueError(f"no clip has a value for {', '.join(missing)}")
    profiles = {r.quantity: tuple(r.profile) for r in reference.quantiles(samples, ["quantity"], n).collect()}
    keys = tuple(sorted(profiles))
    gaussian = reference.feature_gaussian(samples, list(keys), "identity") if keys else Gaussian(np.zeros(0), np.zeros((0, 0)), 0)
    return Reference(_checked(dt), suite.suite_id, {k: found[k] for k in suite.invariant}, profiles, gaussian, keys)


def _checked(dt: float) -> float:
    if not 0 < dt < float("inf"):
        raise ValueError(f"frame time {dt} is not positive")
    return float(dt)


def rows(spark: SparkSession, ref: Reference) -> DataFrame:
    """The table of a reference: one row a number (kind, key, i, j, value) or a text."""
    out = [("dt", "", 0, 0, ref.dt, None), ("schema", "", 0, 0, float(ref.schema), None), ("n", "", 0, 0, float(ref.gaussian.n), None), ("suite_id", "", 0, 0, None, ref.suite_id)]
    out += [(kind, k, at, 0, pair[part], None) for at, (k, pair) in enumerate(ref.terms.items()) for part, kind in enumerate(("base", "floor"))]
    out += [("quantile", k, i, 0, v, None) for k, q in ref.quantiles.items() for i, v in enumerate(q)]
    out += [("quantity", k, i, 0, None, None) for i, k in enumerate(ref.quantity_keys)]
    out += [("mean", "", i, 0, float(v), None) for i, v in enumerate(ref.gaussian.mean)]
    out += [("cov", "", i, j, float(v), None) for i, row in enumerate(ref.gaussian.cov) for j, v in enumerate(row)]
    return spark.createDataFrame(out, _ROWS)


def save(spark: SparkSession, ref: Reference, path: str) -> None:
    rows(spark, ref).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, dt: float | None = None) -> Reference:
    """A reference that :func:`save` wrote, or one of the older form, a JSON file without a version.

    The older form does not tell its frame time, so ``dt`` must; of the other a ``dt`` is only compared.
    """
    if path.endswith(".json"):
        return from_older(json.loads(spark.read.text(path, wholetext=True).first()["value"]), dt)
    found = spark.read.schema(_ROWS).parquet(path).collect()
    kinds: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.kind, r.i, r.j)):
        kinds.setdefault(r.kind, []).append(r)
    one = lambda kind: kinds[kind][0]
    if "schema" not in kinds or one("schema").value != SCHEMA:
        raise ValueError(f"{path} has the form {one('schema').value:g}, not {SCHEMA}" if "schema" in kinds else f"{path} is no reference")
    own = one("dt").value
    if dt is not None and abs(_checked(dt) - own) > 1e-6 * own:
        raise ValueError(f"dt {dt} is not the one of {path}, {own}")
    floors = {r.key: r.value for r in kinds.get("floor", [])}
    profiles: dict[str, list[float]] = {}
    for r in kinds.get("quantile", []):
        profiles.setdefault(r.key, []).append(r.value)
    mean = np.array([r.value for r in kinds.get("mean", [])], float)
    cov = np.array([r.value for r in kinds.get("cov", [])], float).reshape(len(mean), len(mean))
    terms = {r.key: (r.value, floors[r.key]) for r in kinds.get("base", [])}
    return Reference(own, one("suite_id").text, terms, {k: tuple(v) for k, v in profiles.items()}, Gaussian(mean, cov, int(one("n").value)), tuple(r.key for r in kinds.get("quantity", [])))


def from_older(raw: dict, dt: float | None) -> Reference:
    """A reference of the older form: no suite is pinned, and floors are the least ones of the units."""
    if missing := sorted(set(_OLD_KEYS) - set(raw)):
        raise ValueError(f"no reference: {', '.join(missing)} missing")
    if dt is None:
        raise ValueError("a reference of the older form tells no frame time; give the one it was built at")
    floor = lambda k: reference.FLOOR_MM if k.endswith("_mm") else reference.FLOOR
    terms = {k: (float(v), floor(k)) for k, v in sorted(raw["inv_baseline"].items())}
    gaussian = Gaussian(np.array(raw["feat_mu"], float), np.array(raw["feat_cov"], float), 0)
    return Reference(_checked(dt), OLDER, terms, {k: tuple(map(float, v)) for k, v in raw["quantiles"].items()}, gaussian, tuple(raw["quantity_keys"]), 1)


def scores(terms: DataFrame, ref: Reference, dt: float | None = None, policy: str = "strict", allow_rate_mismatch: bool = False) -> DataFrame:
    """(clip, n_terms, n_missing, score, suite_id, rate_mismatch): the invariance score against a stored reference.

    Raises where clips of another frame time are scored, unless that is allowed; it is told then.
    """
    off = dt is not None and not reference.same_rate(_checked(dt), ref.dt, allow_rate_mismatch)
    own = reference.invariance(terms.select("clip", "metric", "value"), ref.table(terms.sparkSession), policy)
    return own.withColumn("suite_id", F.lit(ref.suite_id)).withColumn("rate_mismatch", F.lit(off))


def older_scores(terms: DataFrame, ref: Reference) -> DataFrame:
    """(clip, n_terms, score) as older results have it: whatever terms a clip shares with the reference, without floors."""
    base = F.broadcast(ref.table(terms.sparkSession).select(F.col("metric").alias("of"), "base"))
    met = terms.where(F.col("value").isNotNull() & ~F.isnan("value")).join(base, F.col("metric") == F.col("of"))
    x = F.when(F.col("metric").endswith("_frac"), (F.col("value") - F.col("base")) / reference.SHARE_TOLERANCE).otherwise((F.col("value") - F.col("base")) / (F.col("base") * (reference.TOLERANCE - 1) + 1e-8))
    sums = met.select("clip", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("s")).groupBy("clip").agg(F.count("*").alias("n_terms"), F.avg("s").alias("score"))
    clips = terms.select("clip").distinct().withColumnRenamed("clip", "of")
    return clips.join(sums, F.col("of").eqNullSafe(F.col("clip")), "left").select(F.col("of").alias("clip"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.coalesce("score", F.lit(0.0)).alias("score"))


def assert_comparable(a: DataFrame, b: DataFrame) -> None:
    """Raise unless all scores of both tables come from one set of terms."""
    ids = sorted({r.suite_id for r in a.select("suite_id").unionByName(b.select("suite_id")).distinct().limit(3).collect()})
    if len(ids) > 1:
        raise ValueError(f"scores of {' and '.join(ids)} are of different terms")


def distances(samples: DataFrame, ref: Reference, dt: float | None = None, allow_rate_mismatch: bool = False) -> DataFrame:
    """(clip, quantity, w1) against the stored quantiles; rates as in :func:`scores`."""
    if dt is not None:
        reference.same_rate(_checked(dt), ref.dt, allow_rate_mismatch)
    n = len(next(iter(ref.quantiles.values()), ()))
    return reference.wasserstein(samples, ref.profiles(samples.sparkSession), n)


def kinematic_distance(samples: DataFrame, ref: Reference, symmetrise: bool = False, dt: float | None = None, allow_rate_mismatch: bool = False) -> float:
    """The Fréchet distance of all clips' features from the stored Gaussian; rates as in :func:`scores`."""
    if dt is not None:
        reference.same_rate(_checked(dt), ref.dt, allow_rate_mismatch)
    return reference.frechet(reference.feature_gaussian(samples, list(ref.quantity_keys)), ref.gaussian, symmetrise)
