"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.components import connected_components
from strider.llm.tables import drop_written, if_small, written

LEAST = 0.98
#: Fewest passes, random hash bits joined to a sort key in each, and rows of a block: a row meets at least so many on either side.
PASSES, BITS, BLOCK = 8, 48, 512
#: Rows of a part of a component whose links are counted, and rows of two parts compared at a time.
PART, AT_ONCE = 4096, 512
#: Most probability that all passes miss a pair at exactly the least cosine among spread-out vectors.
MISS = 0.001


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, embedding, label) of all rows, the embedding null where the row links with nothing: its label is null, or its vector is null, zero, or holds null or non-finite components."""
    e = F.col("embedding")
    fine = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    return rows.withColumn("embedding", F.when(fine, e))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sorted_passes(reps: DataFrame, passes: int, bits: int, seed: int = 7) -> DataFrame:
    """(pass, label, dim, key, node, vec) for each pass: key joins the signs of ``bits`` random projections of the vector."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in b.groupby(b["vec"].map(len)):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).standard_normal((dim, passes * bits))
                sign = _unit(part["vec"]) @ planes[dim] > 0
                for p in range(passes):
                    key = sign[:, p * bits : (p + 1) * bits] @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                    yield pd.DataFrame({"pass": p, "label": part["label"], "dim": dim, "key": key, "node": part["node"], "vec": part["vec"]})

    return reps.select("label", "node", "vec").mapInPandas(of, "pass int, label string, dim int, key long, node long, vec array<double>")


def passes_for(rows: int, least: float = LEAST, block: int = BLOCK, miss: float = MISS) -> int:
    """Passes after which a pair at a cosine of ``least`` among ``rows`` of its label is missed with a probability of ``miss`` at most.

    A sign bit of it differs with p = acos(least) / pi, and it meets in a pass if about
    log2(rows / (1.5 * block)) leading bits agree.
    """
    meet = (1 - math.acos(least) / math.pi) ** max(0.0, math.log2(max(rows, 1) / (1.5 * block)))
    return PASSES if meet >= 1 else max(PASSES, math.ceil(math.log(miss) / math.log1p(-meet)))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (i, j) of ``n`` rows are enough to join all that they join."""
    parent, keep = list(range(n)), []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[b] = a
            keep.append(k)
    return np.array(keep, np.int64)


def _spanning(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """(a, b): of each pass, label and length of a block and the next, pairs that join all that links join there; no pair of the next block alone."""
    out = []
    for _, g in rows.groupby(["pass", "label", "dim"], sort=False):
        g = g.sort_values("side", kind="stable")
        own, x, node = int((g["side"] == 0).sum()), _unit(g["vec"]), g["node"].to_numpy()
        i, j = np.nonzero(np.triu(x[:own] @ x.T >= least, 1))
        keep = _forest(i, j, len(g))
        out.append(pd.DataFrame({"a": np.minimum(node[i[keep]], node[j[keep]]), "b": np.maximum(node[i[keep]], node[j[keep]])}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})


def spanning_pairs(reps: DataFrame, least: float = LEAST, passes: int = PASSES, bits: int = BITS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of ``reps`` (label, node, vec) of a cosine of ``least`` or more that join all that the passes find; and (node, block) for each pass.

    Each pass sorts by label and key in ranges and numbers the rows from counts per range; blocks of
    ``block`` rows are compared with themselves and the next. A block gives fewer pairs than it and
    the next have rows, however dense the links are.
    """
    spark = reps.sparkSession
    order = ["pass", "label", "dim", "key", "node"]
    keyed = sorted_passes(reps, passes, bits)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "passes")
    part, row = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("p")).count()  # a row for each task of the sort
    before = F.coalesce(F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = if_small(written(sizes.select("p", before.alias("before")), "offsets"))
    rows = placed.withColumn("p", part).join(first, "p").withColumn("block", F.floor((F.col("before") + row) / block)).select("block", "pass", "label", "dim", "node", "vec")
    twice = rows.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("of", F.col("block") - F.col("side")).where("of >= 0")
    out = written(twice.groupBy("of").applyInPandas(lambda g: _spanning(g, least), "a long, b long").distinct(), "pairs")
    places = written(rows.select("node", "block"), "places")
    drop_written(placed)
    return out, places


def joined_groups(reps: DataFrame, pairs: DataFrame, places: DataFrame, least: float = LEAST, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(node, component) of linked nodes: of ``pairs``, and of rows among those of a group that windows cut.

    A group of more rows than a block may link with a row that met none of its few partners in a
    window. Each row that shares a block with members of such a group in any pass, but is not one of
    them, is compared with all its members, part by part, until that joins nothing more. A row gives
    one pair for each part that it links with.
    """
    while True:
        found = written(connected_components(pairs, "a", "b"), "components")
        large = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > block)
        large = written(large.select("component", F.ceil(F.col("n") / part).cast("int").alias("parts")), "large")
        if not large.head(1):
            return found
        inside = places.join(if_small(found), "node", "left")
        here = inside.join(if_small(large), "component").select("block", F.col("component").alias("of")).distinct()
        beside = inside.join(if_small(written(here, "here")), "block").where("component is null or component <> of").select("node", "of").distinct()
        beside = beside.join(if_small(large.withColumnRenamed("component", "of")), "of").join(reps.select("node", "label", "vec"), "node")
        members = found.join(if_small(large), "component").join(reps.select("node", "label", "vec"), "node")
        place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        one = members.select(F.col("component").alias("of"), place(F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), F.lit(True).alias("member"), "node", "label", "vec")
        two = beside.select("of", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), place(F.col("parts")).alias("other"), F.lit(False).alias("member"), "node", "label", "vec")

        def of(g: pd.DataFrame) -> pd.DataFrame:
            out = []
            for _, d in g.groupby([g["vec"].map(len), "label"]):
                x, y = d[~d["member"]], d[d["member"]]
                for at in range(0, len(x) if len(y) else 0, AT_ONCE):
                    hit = _unit(x["vec"].iloc[at : at + AT_ONCE]) @ _unit(y["vec"]).T >= least
                    i = np.flatnonzero(hit.any(axis=1))
                    a, b = x["node"].to_numpy()[at + i], y["node"].to_numpy()[hit[i].argmax(axis=1)]
                    out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}))
            return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

        more = written(one.unionByName(two).groupBy("of", "part", "other").applyInPandas(of, "a long, b long"), "pairs")
        if not more.head(1):
            return found
        pairs = pairs.unionByName(more)


def _links(x: pd.DataFrame, y: pd.DataFrame | None, least: float) -> list[tuple]:
    """(node, m): for rows of one component of ``x`` how many rows of ``y``, or of ``x`` itself, each links with, and the same for ``y``; copies count."""
    u, nu = _unit(x["vec"]), x["n"].to_numpy()
    v, nv = (u, nu) if y is None else (_unit(y["vec"]), y["n"].to_numpy())
    mine, theirs = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
    for at in range(0, len(u), AT_ONCE):
        hit = u[at : at + AT_ONCE] @ v.T >= least
        if y is None:
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
        mine[at : at + AT_ONCE] = hit @ nv
        theirs += nu[at : at + AT_ONCE] @ hit
    out = list(zip(x["node"], mine.tolist(), strict=True))
    return out if y is None else out + list(zip(y["node"], theirs.tolist(), strict=True))


def link_counts(members: DataFrame, least: float = LEAST, part: int = PART) -> DataFrame:
    """(node, m): of each of ``members`` (component, node, n, vec) how many rows of other nodes of its component it links with.

    All links of a row are in its component. One of more than ``part`` nodes is dealt to parts of
    about that size by hash; each two of them are compared in a task of their own, as the count of
    links of a large group asks for its pairs, and only counts leave a task. Small components share tasks.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    large = if_small(written(sizes.where("parts > 1"), "large"))
    dealt = members.join(large, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    bundle = F.when(F.col("parts") > 1, F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks)))
    sent = dealt.withColumn("pair", F.explode(pairs)).select(bundle.alias("bundle"), "pair.i", "pair.j", "component", "own", "node", "n", "vec")

    def of(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, c in g.groupby(["component", "i", "j"], sort=False):
            i, j = int(c["i"].iloc[0]), int(c["j"].iloc[0])
            for _, d in c.groupby(c["vec"].map(len)):
                x, y = d[d["own"] == i], None if i == j else d[d["own"] == j]
                if len(x) and (y is None or len(y)):
                    out += _links(x, y, least)
        return pd.DataFrame(out, columns=["node", "m"]).astype("int64")

    return sent.groupBy("bundle", "i", "j").applyInPandas(of, "node long, m long").groupBy("node").agg(F.sum("m").alias("m"))


def embedding_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST,
    passes: int | None = None, bits: int = BITS, block: int = BLOCK, part: int = PART,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors``.

    Only vectors of equal, non-null labels are compared. Copies are one class, whose members link
    with each other and with all of a linked class without being paired; n_links counts rows. The
    passes find what is joined; the links inside a component are then counted in full, so counts
    miss nothing that windows cut. Rows that link with nothing (a null label; a vector that is null,
    empty, zero or holds null or non-finite components) are their own component. Rows that repeat an
    id count each. Rows without an id link as any other; they name no component and are not kept, and a
    component of such rows alone has no id. An empty table gives no rows. ``passes`` follows from the classes
    of the largest label unless given.
    """
    rows = usable(vectors, vec_id, embedding, label)
    sums = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    reps = written(sums.select("label", F.col("embedding").alias("vec"), "least", "n", F.monotonically_increasing_id().alias("node")), "classes")
    if passes is None:
        largest = reps.groupBy("label", F.size("vec")).count().agg(F.max("count")).first()[0]
        passes = passes_for(largest or 0, least, block)
    pairs, places = spanning_pairs(reps, least, passes, bits, block)
    found = joined_groups(reps, pairs, places, least, block, part)
    ids = found.join(reps.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    members = reps.join(if_small(found), "node")
    linked = if_small(written(found.join(ids, "component").join(link_counts(members, least, part), "node", "left").select("node", "component_id", "m"), "linked"))
    of = reps.join(linked, "node", "left").select(
        F.col("label").alias("l"), F.col("vec").alias("v"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    out = rows.join(of, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
