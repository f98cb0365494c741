"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.components import connected_components
from strider.llm.tables import drop_written, if_small, written

SEED = 42
#: Shingles hashed at a time, so that a very long text needs no more memory than its words.
BLOCK = 1 << 13
#: Fingerprints that share a segment value beyond which they are linked through whole-fingerprint balls.
BUCKET = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """The hashes of the ``width``-word shingles of a text, repeats included, a block at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined, count = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, count) + 1) - 1
    del words
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, count - width + 1)
    starts, ends = starts[:n], ends[min(width, count) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in spans), "<u8", min(BLOCK, n - at))


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(blocks: Iterable[np.ndarray]) -> np.ndarray:
    """The 64 bits set in over half the hashes; zeros if there are none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        n += len(h)
        ones += _set_bits(h)
    return 2 * ones > n


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of the ``width``-word shingles of a text, sorted."""
    blocks = [np.unique(h) for h in _hashes(text, width)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, "<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash, as a signed integer, of the ``width``-word shingles of a text.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words is one
    shingle, one of none (or null) is zero.
    """
    return int(np.packbits(_majority(_hashes(text, width)), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with a long column ``out``, the fingerprint of each whole text."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(out, of(F.col(text)))


def _segments(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n segments of 64 bits."""
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _part(fp, first: int, bits: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else fp


def near_links(nodes: DataFrame, max_bits: int = 2, segments: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (src, dst) that join all of ``nodes`` (node, fp; fp distinct) within ``max_bits`` bits.

    Two fingerprints that differ in at most ``max_bits`` bits differ in at most
    ``max_bits // segments`` (0 or 1 here) of some segment. Each posts its segments in a table per
    segment and probes them with its own values and those one bit away; of two values one bit apart
    only the one with the bit unset probes. The whole distance of each match is verified.

    A segment value shared by more than ``bucket`` fingerprints is not compared pairwise: all that
    hold or probe it list their whole-fingerprint ball of radius 1, and those that share a member
    of it (which are those within 2 bits; for 1 bit, the pairs that share an edge) are linked to the
    smallest of them. That is exact and linear in the size of the group: it links each to one of
    its group instead of to all.
    """
    if max_bits not in (1, 2) or max_bits // segments > 1:
        raise ValueError("max_bits is 1 or 2, with segments for a radius of at most 1 in each")
    parts = _segments(segments)
    radius = max_bits // segments
    posts = nodes.select(
        "node", "fp", F.explode(F.array(*[
            F.struct(F.lit(i).alias("seg"), _part(F.col("fp"), *p).alias("val")) for i, p in enumerate(parts)
        ])).alias("p"),
    ).select("node", "fp", "p.seg", "p.val")
    probes = posts.withColumn("own", F.lit(True))
    if radius:
        bits = F.array(*[F.lit(n) for _, n in parts])
        flips = (
            posts.select("node", "fp", "seg", "val", F.explode(F.sequence(F.lit(0), F.element_at(bits, F.col("seg") + 1) - 1)).alias("i"))
            .where("getbit(val, i) = 0")
            .select("node", "fp", "seg", F.expr("val | shiftleft(1L, i)").alias("val"), F.lit(False).alias("own"))
        )
        probes = probes.unionByName(flips)
    full = written(posts.groupBy("seg", "val").count().where(F.col("count") > bucket).select("seg", "val"), "full")
    crowded = full.head(1)
    table = posts.join(full, ["seg", "val"], "left_anti") if crowded else posts
    match = table.select("seg", "val", F.col("node").alias("dst"), F.col("fp").alias("other"))
    links = (
        probes.join(match, ["seg", "val"])
        .where((~F.col("own") | (F.col("node") < F.col("dst"))) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits))
        .select(F.col("node").alias("src"), "dst")
    )
    if crowded:
        some = probes.join(full, ["seg", "val"], "left_semi").select("node", "fp").distinct()
        bits = [F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]
        if max_bits == 2:
            keys = [F.struct(F.col("fp").bitwiseXOR(x).alias("at"), F.lit(0).alias("bit")) for x in [F.lit(0).cast("long"), *bits]]
        else:  # the pairs that differ in bit i share their value with that bit set
            keys = [F.struct(F.col("fp").bitwiseOR(x).alias("at"), F.lit(i).alias("bit")) for i, x in enumerate(bits)]
        balls = written(some.select("node", F.explode(F.array(*keys)).alias("key")), "balls")
        first = balls.groupBy("key").agg(F.min("node").alias("dst"), F.count("*").alias("n")).where("n > 1").drop("n")
        links = links.unionByName(balls.join(first, "key").where("node <> dst").select(F.col("node").alias("src"), "dst"))
    return links


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 2,
    segments: int = 2, bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``.

    fingerprint is 16 lower-case hex digits; component_id the smallest doc_id reachable through
    fingerprints within ``max_bits`` bits. Fingerprints are the nodes, so copies are never paired
    and an id that repeats joins nothing but its fingerprints' groups. Null and empty texts have
    fingerprint zero and link like any other, and so do rows without a doc_id, whose component_id is
    null only if their group has no id at all. Repeated rows stay; an empty table gives no rows.
    """
    fps = written(
        fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", width).select("doc_id", "fp"),
        "fingerprints",
    )
    n = fps.count()
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", n)
    found = connected_components(near_links(least.select(F.col("fp").alias("node"), "fp"), max_bits, segments, bucket))
    joined = written(least.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "components", n)
    ids = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = written(joined.join(ids, "component").select("fp", "component_id"), "groups", n)
    drop_written(least, joined)
    return fps.join(if_small(of), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: A wide fingerprint: bits of a segment at least, and segments. Tables of more than 2 ** (bits - 3) nodes take wider segments.
LEAST_BITS, WIDE_SEGMENTS = 20, 16
#: Values of a segment that a node posts, its own among them, at ``LEAST_BITS``; each further bit takes so many times more
#: for the same recall. Nodes meet in any value that both post, so fewer are needed than if one looked up what the other holds.
PROBES, PROBES_A_BIT = 5, 1.14
#: Bits of a segment that may be taken to differ, those with the closest vote, and how many of them at once, for up to so many probes.
CLOSE = {24: (8, 3), 1 << 30: (12, 4)}
#: The share of bits of a wide fingerprint in which candidates may differ, and bits of its first lane. Shingle sets with a
#: Jaccard similarity of 0.8 differ in 15 % of the bits: of 320 in 48 with a deviation of 6, of 64 in 9.6 with one of 2.9; unrelated ones in half.
WIDE_SHARE, FIRST_BITS = 0.2125, 20
#: Nodes that post a segment value beyond which they are compared in blocks, whole set with whole set, without a row for each pair.
CROWD = 64
#: Nodes of such a block, and shingles whose presence is a column of a matrix at a time.
CROWD_BLOCK, COLUMNS = 256, 1 << 13
#: The least Jaccard similarity of linked documents.
LEAST = 0.8

def segment_bits(nodes: int) -> int:
    """Bits of a segment for so many nodes: chance meetings of a node stay about the same however many there are."""
    return min(60, max(LEAST_BITS, math.ceil(math.log2(max(nodes, 1))) + 3))


def segment_probes(bits: int) -> int:
    return math.ceil(PROBES * PROBES_A_BIT ** (bits - LEAST_BITS))


def turns(probes: int) -> np.ndarray:
    """(subsets, bits): which of the closest bits a subset turns; the first turns none."""
    of, at_once = next(v for most, v in CLOSE.items() if probes <= most)
    subsets = [s for r in range(at_once + 1) for s in combinations(range(of), r)]
    out = np.zeros((len(subsets), of), np.float32)
    for i, s in enumerate(subsets):
        out[i, list(s)] = 1
    return out


def _votes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Of each bit of a SimHash of ``bits`` bits, by how much more of the set hashes have it than not, in steps of a 127th of the clearest; never zero. Lanes beyond the first rehash."""
    lanes = -(-bits // 64)
    ones = np.zeros((lanes, 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        h = hashes[at : at + BLOCK]
        for lane in range(lanes):
            ones[lane] += _set_bits(h)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    lead = 2 * ones.ravel()[:bits] - len(hashes)
    size = np.maximum(1, np.abs(lead) * 127 // max(1, int(np.abs(lead).max())))
    return np.where(lead > 0, size, -size).astype(np.int8)


def ball(votes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """(rows, segments, probes) segment values: each row's own first, then those of its Hamming ball that a like text most likely has.

    A bit with a close vote is the one that a small change of the text turns, so values are taken in
    order of the sum of squared votes of the bits that they turn.
    """
    parts, turned = votes.reshape(len(votes), WIDE_SEGMENTS, bits), turns(probes)
    own = (parts > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    close = np.argsort(np.abs(parts), axis=2, kind="stable")[:, :, : turned.shape[1]]
    cost = np.take_along_axis(parts, close, axis=2) ** 2 @ turned.T
    best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
    masks = (np.int64(1) << close) @ turned.T.astype(np.int64)
    return own[:, :, None] ^ np.take_along_axis(masks, best, axis=2)


def wide_votes(docs: DataFrame, keep: list[str], bits: int, text: str = "text", width: int = 5) -> DataFrame:
    """The columns ``keep`` of each row with ``cls``, a digest of its set of shingles, and ``votes``, a byte for each of the ``WIDE_SEGMENTS * bits`` bits of the SimHash of that set."""

    @F.pandas_udf("cls binary, votes binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                own = shingle_set(t, width)
                out.append((xxhash.xxh3_128_digest(own.tobytes()), _votes(own, WIDE_SEGMENTS * bits).tobytes()))
            yield pd.DataFrame(out, columns=["cls", "votes"])

    return docs.select(*keep, of(F.col(text)).alias("__wide")).select(*keep, "__wide.*")


def wide_fingerprints(nodes: DataFrame, bits: int) -> DataFrame:
    """(node, fp, segs) of (node, votes): the SimHash as longs, and the :func:`ball` of each segment, its number in the bits above the values."""
    probes, total = _stride(bits), WIDE_SEGMENTS * bits
    number = (np.arange(WIDE_SEGMENTS, dtype=np.int64) << bits)[None, :, None]

    @F.pandas_udf("fp array<long>, segs array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            votes = np.frombuffer(b"".join(b), np.int8).reshape(len(b), total).astype(np.float32)
            fp = np.packbits(np.pad(votes > 0, ((0, 0), (0, -total % 64))), axis=1, bitorder="little").view("<i8")
            yield pd.DataFrame({"fp": list(fp), "segs": list((ball(votes, bits, probes) + number).reshape(len(b), -1))})

    return nodes.select("node", of("votes").alias("__wide")).select("node", "__wide.*")


def _stride(bits: int) -> int:
    """Values of a segment in :func:`ball`."""
    return min(segment_probes(bits), len(turns(segment_probes(bits))))


def _held(nodes: DataFrame, probes: int) -> DataFrame:
    """(node, f, val): the segment values that each node has itself, without the others that it posts."""
    rows = nodes.select("node", F.element_at("fp", 1).alias("f"), F.posexplode("segs").alias("i", "val"))
    return rows.where(F.col("i") % probes == 0).drop("i")


def _near(f: str, g: str):
    return F.bit_count(F.col(f).bitwiseXOR(F.col(g))) <= FIRST_BITS


def _within(met: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Distinct (src < dst) of ``met`` (node, dst) whose whole distance is at most ``most`` bits."""
    met = met.select(F.least("node", "dst").alias("src"), F.greatest("node", "dst").alias("dst")).distinct()
    one = nodes.select(F.col("node").alias("src"), F.col("fp").alias("a"))
    two = nodes.select(F.col("node").alias("dst"), F.col("fp").alias("b"))
    distance = F.aggregate(F.zip_with("a", "b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    return met.join(one, "src").join(two, "dst").where(distance <= most).select("src", "dst")


def leader_pairs(nodes: DataFrame, bits: int) -> DataFrame:
    """Distinct (src < dst) of like fingerprints: each node with the smallest node that has the same value of a segment.

    At most ``WIDE_SEGMENTS`` pairs a node, however large its group.
    """
    held = _held(nodes, _stride(bits))
    first = held.groupBy("val").agg(F.min_by(F.struct("node", "f"), "node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("val", "lead.node", F.col("lead.f").alias("g")).withColumnRenamed("node", "dst")
    met = held.join(first, "val").where((F.col("node") != F.col("dst")) & _near("f", "g")).select("node", "dst")
    return _within(met, nodes, int(WIDE_SHARE * WIDE_SEGMENTS * bits))


def crowds(nodes: DataFrame, crowd: int = CROWD) -> DataFrame | None:
    """(node, g, full) of the ``nodes`` (node, segs) that post a segment value which more than ``crowd`` nodes post, if any; those that share such a value, and those they lead to, share ``g``; ``full`` are a node's such values."""
    n = nodes.count()
    posts = nodes.select("node", F.explode("segs").alias("val"))
    full = written(posts.groupBy("val").count().where(F.col("count") > crowd).select("val"), "full", n)
    if not full.head(1):
        return None
    members = written(posts.join(if_small(full), "val").select("val", "node"), "members")
    least = if_small(written(members.groupBy("val").agg(F.min("node").alias("dst")), "least"))
    of = written(connected_components(members.join(least, "val").select(F.col("node").alias("src"), "dst")).withColumnRenamed("component", "g"), "crowds", n)
    out = written(members.groupBy("node").agg(F.collect_list("val").alias("full")).join(if_small(of), "node").select("node", "g", "full"), "crowds", n)
    drop_written(members, of)
    return out


def linked(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Places (i, j) in ``sets`` that join the same ones as all pairs with a Jaccard similarity of ``least`` or more."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[column[shared]], np.repeat(np.arange(n), sizes)[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((n, n), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        some = slice(*np.searchsorted(column, (first, first + COLUMNS)))
        has = np.zeros((n, COLUMNS), np.float32)
        has[row[some], column[some] - first] = 1
        common += has @ has.T
    common = common.astype(np.float64)
    like, new, out = common >= least * (sizes[:, None] + sizes - common), np.ones(n, bool), []
    for root in range(n):
        waiting, new[root] = [root] if new[root] else [], False
        while waiting:
            found = np.flatnonzero(like[waiting.pop()] & new)
            new[found] = False
            out += [(root, int(j)) for j in found]
            waiting += found.tolist()
    return out


def crowd_links(members: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float = LEAST) -> DataFrame:
    """Links (src, dst) that join the same nodes of each crowd of ``members`` (node, c, g) as all pairs of different ``c`` whose sets are similar.

    ``sets`` gives the (node, s) of a table of nodes. Every node outside the main ``c`` of its crowd is compared with the whole
    crowd, exactly. A task compares two blocks of ``CROWD_BLOCK`` nodes and returns a link a node at most: its memory is bounded,
    and the rows dealt are a crowd's nodes times its blocks of other than the main ``c``.
    """
    counts = members.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g")
    of = counts.agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("mains"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    blocks = lambda n: F.ceil(F.col(n) / CROWD_BLOCK)
    dealt = members.join(if_small(written(of, "mains")), "g").withColumn("o", blocks("others")).withColumn("b", F.col("o") + blocks("mains")).withColumn("h", F.xxhash64("node"))
    own = F.expr("if(c = main, o + pmod(h, b - o), pmod(h, o))")
    met = F.explode(F.sequence(F.lit(0), F.when(F.col("c") == F.col("main"), F.col("o")).otherwise(F.col("b")) - 1))
    dealt = dealt.select("g", "node", own.alias("own"), met.alias("met")).select("g", "node", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"))

    def of_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy()
        return pd.DataFrame([(node[i], node[j]) for i, j in linked([np.asarray(s) for s in rows["s"]], least)], columns=["src", "dst"])

    whole = sets(written(members.select("node"), "ends", members.count()))
    out = written(dealt.join(whole, "node").groupBy("g", "i", "j").applyInPandas(of_blocks, "src long, dst long"), "links")
    drop_written(whole)
    return out


def candidate_pairs(nodes: DataFrame, labels: DataFrame, bits: int) -> DataFrame:
    """Distinct (src < dst) of like fingerprints of ``nodes`` (node, fp, segs) of different ``c``, and not of one ``g``, that meet in a segment.

    ``labels`` (node, c[, g, full]): a node without one is a ``c`` of its own; the values ``full`` are not posted, as all that
    share one share ``g`` too. So no value has more than a crowd's posts, and pairs grow with the nodes. A node posts
    :func:`segment_probes` values of each segment. Of two documents whose shingles have a similarity of 0.8 both post some
    value with a probability of about 0.99. The first lanes are compared on meeting, the whole distance then. Pairs within a
    crowd are left to :func:`crowd_links`.
    """
    if "g" not in labels.columns:
        labels = labels.withColumns({"g": F.lit(None).cast("long"), "full": F.lit(None).cast("array<long>")})
    val = F.when(F.col("full").isNull(), F.col("segs")).otherwise(F.array_except("segs", "full"))
    marked = nodes.join(if_small(labels), "node", "left").select("node", F.element_at("fp", 1).alias("f"), F.coalesce("c", "node").alias("c"), "g", val.alias("segs"))
    posts = marked.select("node", "f", "c", "g", F.explode("segs").alias("val")).repartition("val")
    apart = F.expr("a.node < b.node and a.c <> b.c and not coalesce(a.g = b.g, false)") & _near("a.f", "b.f")
    met = posts.alias("a").join(posts.alias("b"), F.col("a.val") == F.col("b.val")).where(apart)
    met = met.select(F.col("a.node").alias("node"), F.col("b.node").alias("dst"))
    return written(_within(met, nodes, int(WIDE_SHARE * WIDE_SEGMENTS * bits)), "candidates", nodes.count())


def shingle_sets(texts: Callable[[DataFrame], DataFrame], width: int) -> Callable[[DataFrame], DataFrame]:
    """Gives the (node, s), the sorted set of shingles, of each node of a table; ``texts`` gives their (node, text), perhaps more than once each."""

    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            yield pd.Series([shingle_set(t, width).view("<i8") for t in some], dtype=object)

    return lambda ends: written(texts(ends).select("node", of("text").alias("s")).groupBy("node").agg(F.first("s").alias("s")), "sets")


def similar_pairs(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame], least: float = LEAST) -> DataFrame:
    """Enough of ``pairs`` of nodes to join the same ones as all whose shingle sets have a Jaccard similarity of ``least`` or more.

    ``sets`` gives the (node, s) of a table of nodes. Similarities are exact, on whole texts. A node is compared with its
    smallest partner first; of the other pairs, those that this has joined already need no comparison.
    """
    n = pairs.count()

    def similar(some: DataFrame) -> DataFrame:
        some = written(some, "pairs", n)
        ends = written(some.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "ends", n)
        whole = sets(ends)
        both = some.join(whole.select(F.col("node").alias("src"), F.col("s").alias("a")), "src").join(whole.select(F.col("node").alias("dst"), F.col("s").alias("b")), "dst")
        common = F.size(F.array_intersect("a", "b"))
        out = written(both.where(common >= least * (F.size("a") + F.size("b") - common)).select("src", "dst"), "links")
        drop_written(some, ends, whole)
        return out

    first = pairs.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst")
    known = written(connected_components(similar(first)), "known", n)
    other = pairs.join(known.select(F.col("node").alias("src"), F.col("component").alias("c")), "src", "left").join(
        known.select(F.col("node").alias("dst"), F.col("component").alias("d")), "dst", "left"
    )
    other = other.where(F.coalesce("c", "src") != F.coalesce("d", "dst")).select("src", "dst").join(first, ["src", "dst"], "left_anti")
    return known.select(F.col("component").alias("src"), F.col("node").alias("dst")).unionByName(similar(other))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """(doc_id, digest, component) of each row: documents whose sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more, and those they lead to, share a component.

    digest is xxhash64 of the text; component a number that means nothing else. Wide fingerprints find
    candidates, whole texts verify them, so no unlike documents are linked. Documents with equal
    sets are one node and never paired. Null and empty texts are one group; a doc_id that repeats or
    is null joins nothing. An empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("digest", F.xxhash64("text"))
    n = own.count()
    bits = segment_bits(n)
    rows = written(wide_votes(own, ["doc_id", "digest"], bits, "text", width), "votes")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("one")
    reps = written(rows.groupBy("cls").agg(one, F.first("votes").alias("votes")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    of_text = reps.select("node", F.col("one.doc_id").alias("__id"), F.col("one.digest").alias("__digest"))
    nodes = written(wide_fingerprints(reps, bits), "fingerprints")

    def texts(ends: DataFrame) -> DataFrame:
        wanted = if_small(written(of_text.join(if_small(ends), "node"), "wanted", n))
        return own.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))).select("node", "text")

    sets = shingle_sets(texts, width)
    led_pairs = written(leader_pairs(nodes, bits), "candidates", n)
    joined = written(connected_components(similar_pairs(led_pairs, sets, least)).withColumnRenamed("component", "c"), "joined", n)
    drop_written(led_pairs)
    links, labels = joined.select(F.col("c").alias("src"), F.col("node").alias("dst")), joined
    members = crowds(nodes, crowd)
    if members is not None:
        labels = written(joined.join(members, "node", "full"), "labels", n)
        in_crowds = written(labels.where("g is not null").select("node", F.coalesce("c", "node").alias("c"), "g"), "members", n)
        links = links.unionByName(crowd_links(in_crowds, sets, least))
    more_pairs = candidate_pairs(nodes, labels, bits)
    links = links.unionByName(similar_pairs(more_pairs, sets, least))
    of = written(reps.select("node", "cls").join(connected_components(links), "node", "left").select("cls", F.coalesce("component", "node").alias("component")), "groups", n)
    drop_written(nodes, more_pairs, reps)
    return rows.select("doc_id", "digest", "cls").join(if_small(of), "cls").select("doc_id", "digest", "component")
