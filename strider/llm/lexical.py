"""Ranked lexical search: bit-sliced Bloom signatures bound every score from above, texts that may still count are scored exactly."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.tables import drop_written, if_small, written

#: Documents returned for an item.
TOP = 50
#: Bits of a signature for each entry that it holds at least, positions an entry sets, and the occurrences from which a term has a further entry.
BITS_PER_ENTRY, PROBES, LEVELS = 8, 3, (1, 2, 4, 8)
#: Bytes of the slices of a block, from which the documents of a block follow, and documents of a block at most.
BLOCK_BYTES, BLOCK_DOCS = 256 << 10, 1024
#: Distinct terms of a batch of items, and items whose bounds are computed together; neither has an effect on results.
BATCH_TERMS, TOGETHER = 50_000, 32

#: Lower case for A-Z, a space for what is no term.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of digits, ASCII letters and characters beyond ASCII, only A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def places(found: Iterable[bytes], n: int) -> np.ndarray:
    """Where the entries of ``n`` terms lie in a signature, before the remainder by its bits: (term, level, probe)."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    one, two = (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) | 1
    return (one[:, None] + two[:, None] * np.arange(len(LEVELS) * PROBES)).reshape(n, len(LEVELS), PROBES)


def impact_bounds(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds at most to a document's score, for each number of its levels and each document."""
    m = 50 + (50 * lengths * n_docs) // n_terms
    tf = [np.zeros_like(lengths), *[np.minimum(x - 1, lengths) for x in LEVELS[1:]], lengths]
    return np.stack([(1_000_000_000 * t) // (1000 * t + 20 * m) for t in tf])


@dataclass
class Items:
    """A batch of items: their ids, the places of their distinct terms in ``vocabulary``, and the terms' weights once known."""

    ids: list
    rows: list[np.ndarray]
    vocabulary: list[bytes]
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.places = places(self.vocabulary, len(self.vocabulary))

    def weigh(self, df: dict[bytes, int], n_docs: int) -> None:
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in self.vocabulary], np.int64)


def batches_of(items: list[tuple], most: int = BATCH_TERMS) -> Iterator[Items]:
    """``items`` (id, text) in batches of about ``most`` distinct terms; rows of one id are one item with all their terms."""
    by_id: dict = {}
    for i, text in items:
        by_id.setdefault(i, set()).update(terms(text))
    ids, rows, at = [], [], {}
    for i, found in by_id.items():
        if not found:
            continue
        ids.append(i)
        rows.append(np.array([at.setdefault(t, len(at)) for t in sorted(found)], np.int64))
        if len(at) >= most:
            yield Items(ids, rows, list(at))
            ids, rows, at = [], [], {}
    if ids:
        yield Items(ids, rows, list(at))


class _Block:
    """Documents of one size of signature whose bits are being collected."""

    def __init__(self, size: int):
        self.size = size
        self.room = max(8, min(BLOCK_DOCS, BLOCK_BYTES * 8 // (BITS_PER_ENTRY << size) // 8 * 8))
        self.ids, self.lengths, self.bits = [], [], []

    def slices(self) -> bytes:
        """A row of bits for each place of the signature, a bit for each document."""
        wide = -(-len(self.ids) // 8) * 8
        grid = np.zeros((BITS_PER_ENTRY << self.size, wide), bool)
        for column, at in enumerate(self.bits):
            grid[at, column] = True
        return np.packbits(grid, axis=1).tobytes()


def _signer(vocabulary: list[bytes], kind: pa.DataType, signatures: bool):
    """Documents to blocks of bit slices, and counts of the documents that hold each term of ``vocabulary``."""
    wanted = set(vocabulary)

    def row(block: _Block) -> pa.RecordBatch:
        lengths = pa.array([block.lengths], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array([block.size], pa.int32()), pa.array([block.ids], pa.list_(kind)), lengths, pa.array([block.slices()], pa.binary()), pa.nulls(1, pa.binary()), pa.array([len(block.ids)], pa.int64()), pa.array([sum(block.lengths)], pa.int64())],
            names=_INDEX,
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, _Block] = {}
        df: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                counts = Counter(terms(text.as_py()))
                if not counts:
                    continue
                df.update(wanted.intersection(counts))
                if not signatures:
                    continue
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                held = places(counts, len(counts))[tf[:, None] >= np.array(LEVELS)].ravel()
                size = max(0, (len(held) // PROBES - 1).bit_length())
                block = open_blocks.get(size)
                if block is None:
                    block = open_blocks[size] = _Block(size)
                block.ids.append(doc)
                block.lengths.append(counts.total())
                block.bits.append((held & ((BITS_PER_ENTRY << size) - 1)).astype(np.uint32))
                if len(block.ids) == block.room:
                    yield row(open_blocks.pop(size))
        for block in open_blocks.values():
            yield row(block)
        if df:
            n = len(df)
            empty = [pa.nulls(n, t) for t in (pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64()), pa.nulls(n, pa.int64())], names=_INDEX)

    return of


_INDEX = ["size", "doc_ids", "lengths", "slices", "term", "n", "n_terms"]


def index_documents(docs: DataFrame, items: Items, signatures: bool = True) -> DataFrame:
    """The bit-sliced index of ``docs`` (doc_id, text), written: rows of blocks, and rows (term, n) of counts a task made for the items' terms.

    A block holds documents whose signatures have the same number of bits, at least
    ``BITS_PER_ENTRY`` for each entry; slice b has a bit for each of them: whether bit b of its
    signature is set. A term sets entries for 1, 2, 4 and 8 occurrences, as far as it has them.
    A text's signature is in proportion to its distinct terms; a task holds a block of each size.
    """
    kind = dict(docs.dtypes)["doc_id"]
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if arrow == pa.string() and kind != "string":
        raise TypeError(f"doc_id must be an integer or a string, not {kind}")
    schema = f"size int, doc_ids array<{kind}>, lengths array<long>, slices binary, term binary, n long, n_terms long"
    return written(docs.select("doc_id", "text").mapInArrow(_signer(items.vocabulary, arrow, signatures), schema), "signatures")


def bounds(slices: np.ndarray, caps: np.ndarray, items: Items, chunk: slice) -> np.ndarray:
    """Upper bounds of the scores of a block's documents for the items of ``chunk``: weighted sums of slices.

    A term that is there has all its places set, level by level, so the levels found are at least its
    own and ``caps`` at that level is at least what it adds.
    """
    rows = items.rows[chunk]
    used, where = np.unique(np.concatenate(rows), return_inverse=True)
    at = items.places[used] & (len(slices) - 1)
    there = np.bitwise_and.accumulate(np.bitwise_and.reduce(slices[at], axis=2), axis=1)
    term, level = np.nonzero(there.any(axis=2))
    gains = np.unpackbits(there[term, level], axis=1, count=caps.shape[1]) * np.diff(caps, axis=0).astype(np.float64)[level]
    weights = np.zeros((len(rows), len(used)))
    weights[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), where] = items.weights[used][where]
    # All sums are whole numbers below 2^53 for items of up to 300,000 terms; the factor covers any beyond.
    return np.floor(weights[:, term] @ gains * (1 + 1e-9))


def _bounded(items: Items, n_docs: int, n_terms: int, least: np.ndarray | None, kind: pa.DataType):
    """Blocks to (item, doc_id, bound): those of at least ``least``, or else the ``TOP`` largest of each item in a task."""
    chunks = [slice(i, i + TOGETHER) for i in range(0, len(items.ids), TOGETHER)]

    def table(item: np.ndarray, docs: list, bound: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(docs, kind), pa.array(bound.astype(np.float64))], names=["item", "doc_id", "bound"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((len(items.ids), TOP))
        docs = np.empty((len(items.ids), TOP), object)
        for b in batches:
            for ids, lengths, slices in zip(b.column("doc_ids"), b.column("lengths"), b.column("slices"), strict=True):
                ids, lengths = np.array(ids.as_py(), object), lengths.values.to_numpy()
                grid = np.frombuffer(slices.as_buffer(), np.uint8).reshape(-1, -(-len(ids) // 8))
                caps = impact_bounds(lengths, n_docs, n_terms)
                for c in chunks:
                    score = bounds(grid, caps, items, c)
                    if least is not None:
                        i, d = np.nonzero((score >= least[c, None]) & (score > 0))
                        if len(i):
                            yield table(i + c.start, list(ids[d]), score[i, d])
                        continue
                    both, names = np.concatenate([top[c], score], axis=1), np.concatenate([docs[c], np.broadcast_to(ids, score.shape)], axis=1)
                    best = np.argpartition(-both, TOP - 1, axis=1)[:, :TOP]
                    top[c], docs[c] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
        if least is None:
            i, d = np.nonzero(top > 0)
            yield table(i, list(docs[i, d]), top[i, d])

    return of


def _scorer(items: Items, n_docs: int, n_terms: int):
    """(doc_id, text, items) to the exact scores above 0."""
    index = {t: k for k, t in enumerate(items.vocabulary)}
    wanted_terms = set(index)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adds = np.zeros(len(index), np.int64)  # what each term adds to the score of the document at hand
        for b in batches:
            item, at, score = [], [], []
            for k, (text, wanted) in enumerate(zip(b.column("text"), b.column("items"), strict=True)):
                counts = Counter(terms(text.as_py()))
                m = 50 + (50 * counts.total() * n_docs) // n_terms
                held = wanted_terms.intersection(counts)
                there, tf = [index[t] for t in held], np.array([counts[t] for t in held], np.int64)
                adds[there] = items.weights[there] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                for i in wanted.as_py():
                    s = int(adds[items.rows[i]].sum())
                    if s > 0:
                        item.append(i)
                        at.append(k)
                        score.append(s)
                adds[there] = 0
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return of


def _best(rows: DataFrame, order: list, most: int = TOP) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``TOP`` documents of ``docs`` with the highest scores above 0 for each item of ``queries``.

    One pass over the texts writes the bit-sliced index and counts. Its weighted slice sums bound the
    score of every document and item from above. The documents with the largest bounds are scored on
    their texts, which gives each item a score that TOP documents reach; then all documents whose
    bound is not below it are scored. So the result is exact, whatever the signatures.

    Items pass through the driver, ``BATCH_TERMS`` terms at a time; rows of one item_id are one item.
    Texts that are null or without a term, and items without one, have no rows. Each row of ``docs``
    is a document, also where ids repeat or are null (null is last among equal scores); candidates
    are looked up by id, so rows of one id are scored together. An empty table gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kinds = {c: queries.schema[item_id].dataType.simpleString() if c == "item" else plain.schema["doc_id"].dataType.simpleString() for c in ("item", "doc")}
    out = None
    rows = [tuple(r) for r in queries.select(F.col(item_id), F.col(item_text)).collect()]
    index = n_docs = n_terms = None
    for items in batches_of(rows):
        found = index_documents(plain, items, signatures=index is None)
        if index is None:
            index = found
            totals = index.where("size is not null").agg(F.sum("n"), F.sum("n_terms")).first()
            n_docs, n_terms = totals[0], totals[1]
        if not n_docs:
            break
        df = {bytes(r.term): r.n for r in found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        items.weigh(df, n_docs)
        best = _search(plain, index.where("size is not null").select("doc_ids", "lengths", "slices"), items, n_docs, n_terms)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(items.ids)], f"item int, item_id {kinds['item']}")
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kinds['item']}, rank int, doc_id {kinds['doc']}, score long") if out is None else out


def _search(docs: DataFrame, index: DataFrame, items: Items, n_docs: int, n_terms: int) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def rescored(candidates: DataFrame, name: str) -> DataFrame:
        """Exact scores of candidates (item, doc_id), each document's text read once."""
        wanted = written(candidates.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("item").alias("items")), name)
        met = docs.join(if_small(wanted), F.col("doc_id").eqNullSafe(F.col("of")))
        scores = written(met.select("doc_id", "text", "items").mapInArrow(_scorer(items, n_docs, n_terms), f"item int, doc_id {kind}, score long"), "scores")
        drop_written(wanted)
        return scores

    bounded = f"item int, doc_id {kind}, bound double"
    first = _best(index.mapInArrow(_bounded(items, n_docs, n_terms, None, arrow), bounded), [F.desc("bound"), F.asc("doc_id")])
    scores = rescored(first, "first")
    reached = _best(scores, [F.desc("score")]).where(F.col("rank") == TOP).select("item", "score").collect()
    least = np.ones(len(items.ids))
    for r in reached:
        least[r.item] = r.score
    drop_written(scores)
    rest = index.mapInArrow(_bounded(items, n_docs, n_terms, least, arrow), bounded)
    return _best(rescored(rest, "candidates"), [F.desc("score"), F.asc_nulls_last("doc_id")])
