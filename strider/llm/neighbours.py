"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.tables import if_small, written

#: Pivots of a block, taken from its rows; nearest pivots that stand for a vector; the share of a block that is reranked,
#: and the least number.
PIVOTS, NEAREST, SHARE, LEAST_RERANKED = 384, 96, 0.3, 512
#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 8192, 2048


def _fine(e: Column) -> Column:
    return (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(row, vec_id, vec, dim) of the rows that take part: row tells rows of one vec_id apart, dim is the length."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & _fine(F.col("vec")))
    return written(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vectors")


def permutations(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """The numbers of the ``nearest`` pivots of each row, by inner product, nearest first."""
    score = x @ pivots.T
    top = np.argpartition(-score, nearest - 1, axis=1)[:, :nearest]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


def inverted_file(lists: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the rows whose list has it, and how far from its end."""
    n, nearest = lists.shape
    flat, weight = lists.ravel(), np.tile(np.arange(nearest, 0, -1, dtype=np.int32), n)
    order = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[order], np.arange(pivots + 1))
    row = order // nearest
    return [(row[a:b], weight[order[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]


def footrule_gain(own: np.ndarray, posts: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """What common pivots take off the footrule distance of a query's list to each row's, halved.

    Lists without common pivots are farthest apart; a pivot at places i and j of two lists of length
    L takes off 2 * min(L - i, L - j). The larger the gain, the smaller the distance.
    """
    gain, nearest = np.zeros(rows, np.int32), len(own)
    for place, p in enumerate(own):
        at, weight = posts[p]
        gain[at] += np.minimum(weight, nearest - place)
    return gain


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS,
    nearest: int = NEAREST, share: float = SHARE, candidates: int = CANDIDATES, queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` other rows of largest inner product found.

    Rows are dealt by hash to blocks of about ``candidates``, queries to sets of about ``queries``; a
    task indexes a block in an inverted file of the nearest pivots of its rows, ranks them for each
    query of a set by footrule distance, and scores the nearest ``share`` (and ``LEAST_RERANKED`` at
    least) by the inner product in double precision. The pivots of a block are its ``pivots`` rows
    whose ids hash lowest, so nothing comes to the driver but a count for each length of vectors.
    The best of the blocks are merged, ties by smaller vec_id. Each row is indexed; queries against
    rows are the product the search asks for, made in blocks. ``is_query`` is a condition on
    ``vec_id``. Vectors meet those of their own length. Rows that repeat a vec_id are rows of their
    own, as queries as well. Vectors that are null, empty, zero or hold null or non-finite
    components take no part; no rows or queries give no rows.
    """
    rows = usable(vectors, vec_id, embedding)
    # By id and vector, so that answers do not depend on how the table is cut; rows of an id that many have are told apart.
    many = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where(F.col("n") > candidates // 8).select("vec_id", F.lit(True).alias("many"))
    rows = rows.join(if_small(written(many, "many")), "vec_id", "left").withColumn("deal", F.xxhash64("vec_id", "vec", F.when(F.col("many"), F.col("row")))).drop("many")
    asked = rows.where(is_query)
    place = lambda n, seed: F.pmod(F.xxhash64("deal", F.lit(seed)), n).cast("int")
    parts = lambda n, size: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    sizes = rows.groupBy("dim").agg(parts(F.count("*"), candidates).alias("blocks"), parts(F.count_if(is_query), queries).alias("sets"))
    sizes = if_small(written(sizes, "sizes"))
    own = rows.join(sizes, "dim").select("row", "vec_id", "vec", "dim", F.lit(False).alias("asks"), place(F.col("blocks"), 3).alias("block"), F.explode(F.sequence(F.lit(0), F.col("sets") - 1)).alias("set"))
    ask = asked.join(sizes, "dim").select("row", "vec_id", "vec", "dim", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), place(F.col("sets"), 5).alias("set"))

    def search(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        own, asks = g[~g["asks"]].sort_values(["vec_id", "row"]), g[g["asks"]]
        if len(own) and len(asks):
            x, q = np.stack(own["vec"]).astype(float), np.stack(asks["vec"]).astype(float)
            ids, numbers = own["vec_id"].to_numpy(), own["row"].to_numpy()
            chosen = np.lexsort((ids, pd.util.hash_array(ids)))[:pivots]
            p, length = x[chosen], min(nearest, len(chosen))
            posts = inverted_file(permutations(x, p, length), len(p))
            most = min(len(x), max(math.ceil(share * len(x)), LEAST_RERANKED, k + 1))
            for row, key, v, lists in zip(asks["row"], asks["vec_id"], q, permutations(q, p, length), strict=True):
                near = np.argpartition(-footrule_gain(lists, posts, len(x)), most - 1)[:most]
                near = near[numbers[near] != row]
                score = x[near] @ v
                best = np.lexsort((ids[near], -score))[:k]
                out.append(pd.DataFrame({"query": row, "query_id": key, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []})

    found = own.unionByName(ask).groupBy("dim", "block", "set").applyInPandas(search, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
