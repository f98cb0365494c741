"""Configuration as tables of rules: what holds for a cell is what the most specific rule that fits it says."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VARIABLE = re.compile(r"\$\{(\w+)\}")


def expand_env(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """``value`` with each ${NAME} in its strings replaced, at any depth; raises for a name that is not set."""
    env = os.environ if env is None else env

    def named(m: re.Match) -> str:
        if m.group(1) not in env:
            raise KeyError(f"{m.group(1)} is not set, but the configuration names it")
        return env[m.group(1)]

    if isinstance(value, str):
        return _VARIABLE.sub(named, value)
    if isinstance(value, Mapping):
        return {k: expand_env(v, env) for k, v in value.items()}
    return [expand_env(v, env) for v in value] if isinstance(value, list) else value


def rules(raw: Any, keys: Sequence[str], kind: type | tuple[type, ...], name: str, fallback: str | None = None) -> list[tuple]:
    """Rows (a value or None for each of ``keys``, the value) of a setting: one value for all, or a mapping by the first key, and so on.

    ``fallback``: the name under which a level says what holds for all others. Raises for a value of
    another kind, with the place where it is; a list is never a value.
    """
    if raw is None:
        return []
    if not isinstance(raw, Mapping):
        if isinstance(raw, bool) or not isinstance(raw, kind) or raw == "" or (isinstance(raw, int | float) and raw <= 0):
            raise ValueError(f"{name}: {raw!r} is no value")
        return [(*[None] * len(keys), raw)]
    if not keys:
        raise ValueError(f"{name}: no further level is known")
    if not raw:
        raise ValueError(f"{name}: empty")
    out = []
    for key, inner in raw.items():
        if inner is None:
            raise ValueError(f"{name}.{key}: no value")
        here = None if key == fallback else str(key)
        out += [(here, *row) for row in rules(inner, keys[1:], kind, f"{name}.{key}", fallback)]
    return out


def rule_table(spark: SparkSession, rows: list[tuple], keys: Sequence[str], kind: str) -> DataFrame:
    """(keys, value) of :func:`rules`; a null key fits all."""
    return spark.createDataFrame([(*r[:-1], float(r[-1]) if kind == "double" else r[-1]) for r in rows], ", ".join([*[f"{k} string" for k in keys], f"value {kind}"]))


def resolved(cells: DataFrame, rule_rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``cells`` with ``name``: the value of the rule that fits a cell on most keys, an earlier key before a later one; null if none fits.

    Rules are a configuration's, few, and are broadcast; cells are not shuffled for them but to take the best.
    """
    ruled = F.broadcast(rule_rows.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("value").alias("__value")))
    fits = F.lit(True)
    for k in keys:
        fits = fits & (F.col(f"__{k}").isNull() | (F.col(k) == F.col(f"__{k}")))
    weight = sum((F.when(F.col(f"__{k}").isNotNull(), (1 << 20) + (1 << (len(keys) - i))).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    met = cells.join(ruled, fits, "left")
    best = met.groupBy(*[F.col(f"`{c}`") for c in cells.columns]).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), weight)).alias(name))
    return best


def unresolved(cells: DataFrame, name: str, na: str = "na") -> DataFrame:
    """The cells that need a value and have none: what a configuration still has to say."""
    return cells.where(F.col(name).isNull() & ~F.col(na))


def embodiments(cells: DataFrame, claims: DataFrame) -> DataFrame:
    """``cells`` (robot, generator, ...) with ``embodiment``, and ``claimed``: whether the robot claims the generator."""
    by_robot = F.broadcast(claims.groupBy("robot").agg(F.min("embodiment").alias("embodiment"), F.collect_set("generator").alias("__generators")))
    met = cells.join(by_robot, "robot", "left")
    return met.withColumn("claimed", F.coalesce(F.array_contains("__generators", F.col("generator")), F.lit(False))).drop("__generators")
