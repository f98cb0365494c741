"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.tables import drop_written, written

MAX_ROUNDS = 60
#: Parts that the neighbours of a hub are dealt to where they meet what is known of it.
SALTS = 16
#: Neighbours from which a node is a hub.
HUB = 1000


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(rows: DataFrame, key: str, value: str, n: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, value) with ``m``, the least value of each key; and the table of the latter.

    Rows of a hub are dealt to ``SALTS`` parts, its least value goes to each: no task gets all of
    them. The least values are summed up before the shuffle.
    """
    least = written(rows.groupBy(key).agg(F.min(value).alias("m"), F.count("*").alias("n")), "least", n)
    hubs = least.where(F.col("n") >= HUB)
    if n < HUB or not hubs.head(1):
        return rows.join(least.drop("n"), key), least
    salt = F.pmod(F.xxhash64(F.col(value), F.lit(5)), F.lit(SALTS)).cast("int")
    spread = least.withColumn("salt", F.explode(F.when(F.col("n") >= HUB, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    # Rows of other nodes look for part 0; which nodes are hubs is told by a row for each part of them.
    parts = hubs.select(F.col(key).alias("hub"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = rows.withColumn("salt", salt).join(parts, (F.col(key) == F.col("hub")) & (F.col("salt") == F.col("part")), "left")
    dealt = dealt.select(key, value, F.when(F.col("hub").isNull(), 0).otherwise(F.col("salt")).alias("salt"))
    return dealt.join(spread.drop("n"), [key, "salt"]).drop("salt"), least


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node of ``edges``; component is the smallest node reachable.

    Each round points the larger neighbours of a node to its smallest neighbour (large star), then
    the smaller ones (small star). The number of rounds grows with the logarithm of the longest
    chain; no round makes more edges than it read, whatever a node's degree. Rounds are tables in
    the shared folder, so a lost executor costs one round at most. Self-loops, repeated edges and
    edges with a null end are ignored; no edges give no rows.
    """
    s, d = F.col(src).cast("long"), F.col(dst).cast("long")
    now = written(
        edges.where(s != d).select(F.greatest(s, d).alias("a"), F.least(s, d).alias("b")).distinct(), "edges"
    )
    seen = _signature(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        met, one = _with_least(both, "u", "v", 2 * seen[0])
        large = written(met.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct(), "large", seen[0])
        pairs, two = _with_least(large, "a", "b", seen[0])
        small = pairs.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()
        then = written(small, "edges", seen[0])
        drop_written(now, large, one, two)
        now, before, seen = then, seen, _signature(then)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
