"""Order statistics of groups of any size: exact percentiles and running sums without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.sources.shared import stored

#: Of the sketch that brackets a percentile: its rank is off by less than a part in so many.
ACCURACY = 10_000


def percentiles(rows: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """(by, p, n, q): the percentile ``p`` of each group, between the two values next to it in proportion; null and NaN do not count.

    A mergeable sketch brackets each percentile; what lies below the bracket is counted, and only the
    distinct values inside, some thousandths of the group, are put in order with their counts.
    """
    x = F.col(value).cast("double")
    fine = rows.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("__x"))
    reach = 2 / ACCURACY
    edges = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-reach, reach)})
    at = {e: i for i, e in enumerate(edges)}
    sketch = fine.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("__x", F.array(*map(F.lit, edges)), ACCURACY).alias("e"))
    # The sketch takes the rank p n, off by n / ACCURACY at most; p (n - 1) lies between its edges once
    # these are two ranks wider than that. A smaller group is put in order whole.
    few, inf = F.col("n") < 2 * ACCURACY, float("inf")
    edge = lambda p, d: F.when(few, F.lit(inf if d > 0 else -inf)).otherwise(F.col("e")[at[min(1.0, max(0.0, p + d))]])
    wanted = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), edge(p, -reach).alias("lo"), edge(p, reach).alias("hi")) for p in probs]))
    brackets = stored(sketch.select(*[F.col(c).alias(f"__{c}") for c in by], "n", wanted.alias("w")).select(*[f"__{c}" for c in by], "n", "w.*"), "brackets")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = fine.join(F.broadcast(brackets) if not by else brackets, same)
    keys = [*[f"__{c}" for c in by], "p", "n"]
    parts = met.groupBy(*keys, F.when(F.col("__x") < F.col("lo"), None).when(F.col("__x") > F.col("hi"), float("inf")).otherwise(F.col("__x")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    rank = F.col("p") * (F.col("n") - 1)
    first = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    both = parts.withColumn("upto", upto).groupBy(*keys).agg(first(F.floor(rank)).alias("a"), first(F.ceil(rank)).alias("b"))
    q = F.col("a") + (F.col("b") - F.col("a")) * (rank - F.floor(rank))
    return both.select(*[F.col(f"__{c}").alias(c) for c in by], "p", "n", q.alias("q"))


def percentile(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """(by, ``name``): one percentile of each group; without groups one row, null if there is no value."""
    found = percentiles(rows, by, value, [p]).select(*by, F.col("q").alias(name))
    return found if by else found.agg(F.max(name).alias(name))


def profiles(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """(by, profile): ``n`` evenly spaced percentiles of each group; null and NaN do not count.

    Values are ranked in sorted ranges once, however many percentiles are asked for, and each percentile
    meets the two ranks next to it.
    """
    x = F.col(value).cast("double")
    fine = rows.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("__x"), F.lit(1).alias("__one"))
    ranked = running_sums(fine, by, ["__x"], {"__k": "__one"}).drop("__one")
    rank = F.col("__i") * (F.col("__size") - 1) / (n - 1)
    sizes = fine.groupBy(*by).agg(F.count("*").alias("__size")).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    side = lambda name, k: F.struct(F.lit(name).alias("side"), k.cast("long").alias("k"))
    wanted = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], "__i", (rank - F.floor(rank)).alias("__f"), F.explode(F.array(side("a", F.floor(rank)), side("b", F.ceil(rank)))).alias("__w"))
    same = F.col("__k") == F.col("__w.k")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    at = lambda s: F.max(F.when(F.col("__w.side") == s, F.col("__x")))
    met = ranked.join(wanted, same).groupBy(*by, "__i", "__f").agg(at("a").alias("a"), at("b").alias("b"))
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("__f"))
    return met.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", q.alias("q")))), lambda e: e["q"]).alias("profile"))


def running_sums(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with, for each ``{name: column}``, the sum of the column over the rows of its group before it in ``order``.

    Rows are sorted in ranges; a range adds what the ranges before it hold of the group, one row
    for each range and group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("__part", F.shiftrightunsigned("__at", 33))
    totals = placed.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__of"), *[F.coalesce(F.sum(f"__{k}").over(ahead), F.lit(0)).alias(f"__{k}") for k in sums])
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    here = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    met = placed.join(offsets, same)
    return met.select(*rows.columns, *[(F.col(f"__{k}") + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(k) for k, c in sums.items()])
