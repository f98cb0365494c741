"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

import functools
import math
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.tables import drop_written, if_small, written

CAPACITY = 2048
#: Rows of a range of documents and gaps that one task sweeps; what is no more is one range.
ROWS_A_TASK = 10_000
MAX_ROUNDS = 200
#: Words after which a worker forgets those it has not met since as many before, and the longest it remembers.
CACHE, LONGEST = 300_000, 32
#: Marks that may follow a stem; the tokenizer always parts them from letters.
_MARKS = ".,;:!?#$%&*()-|"

PLACED, DOC, GAP, SHRUNK = 0, 1, 2, 3
_ROUND = "kind int, id long, size int, seq long, at int, pid int, rank int"


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers put for each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [x for x in range(256) if x not in printable]
    return {x: x for x in printable} | {x: 256 + i for i, x in enumerate(others)}


class _Words(dict):
    """The ids of words, as bytes, by a byte-level tokenizer that lower-cases and parts words at white space and around runs of letters; a word is learned when first looked up."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.ids = [np.array([i], "<u4").tobytes() for i in range(self.tokenizer.get_vocab_size())]
        #: Words of the turn before; those met since the last turn are the dict's own.
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._learn(word)
        self[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _marks(self, marks: str) -> bytes:
        ids = self.get(marks) or self.old.get(marks) or self._encode(marks)
        self[marks] = ids
        return ids

    def _stem(self, stem: str) -> bytes:
        """A run of lower-case letters is one piece for the model, whose tokens are the ids without further steps."""
        ids = self.get(stem) or self.old.get(stem)
        if ids is None:
            plain = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
            ids = b"".join([self.ids[t.id] for t in self.model.tokenize(plain)])
        self[stem] = ids
        return ids

    def _learn(self, word: str) -> bytes:
        stem = word.rstrip(_MARKS)
        marks = word[len(stem) :]
        if stem.isascii():
            stem = stem.lower()
            plain = stem.isalpha()
        else:  # lower case or composition may set letters apart from their marks
            stem = "".join(map(str.lower, unicodedata.normalize("NFC", stem)))
            plain = stem.isalpha() and unicodedata.is_normalized("NFC", stem)
        if not plain or len(word) > LONGEST:
            return self._encode(word)
        return self._stem(stem) + self._marks(marks) if marks else self._stem(stem)

    def of(self, text: str | None) -> bytes:
        """The ids of a text. Words longer than ``LONGEST`` are not kept beyond a turn."""
        text = text or ""
        if text.isascii():
            text = text.lower()
        ids = b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
        if len(self) > CACHE:
            self.old = {w: x for w, x in self.items() if len(w) <= LONGEST}
            self.clear()
        return ids


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> _Words:
    return _Words(path)


def token_bytes(texts: list[str | None], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers.

    For tokenizers that part words at ASCII white space, which then joins no token and sets none:
    the ids of a text are those of its words one after the other, and words repeat.
    """
    yield from map(_tokenizer(path).of, texts)


def token_pieces(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each piece of each row of ``docs``.

    A row's ids are those of its text, then ``end_id``; only rows of more than ``capacity`` ids are
    cut. ``tokenizer`` is the path of a file all workers have. A null or empty text is one piece of
    ``end_id`` alone.
    """
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, ids in zip(b["doc_id"], token_bytes(list(b["text"]), tokenizer), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((key, n, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            out["doc_id"] = out["doc_id"].astype(b["doc_id"].dtype)
            yield out

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    )


def sweep(docs: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int):
    """Best fit of documents (size, id) into gaps (size, seq), largest document first.

    Returns (id, size, seq, at) of those placed, the documents without a gap as large, largest
    first, the gaps that took none, smallest first, and what is left of the others. Equal sizes go
    by id.
    """
    stacks: dict[int, list[int]] = {}
    mask = 0
    for size, seq in sorted(gaps, key=lambda g: (g[0], -g[1])):
        stacks.setdefault(size, []).append(seq)
        mask |= 1 << size
    placed, left = [], []
    for size, key in sorted(docs, key=lambda d: (-d[0], d[1])):
        above = mask >> size
        if not above:
            left.append((size, key))
            continue
        gap = size + (above & -above).bit_length() - 1
        seq = stacks[gap].pop()
        if not stacks[gap]:
            mask &= ~(1 << gap)
        placed.append((key, size, seq, capacity - gap))
        if gap > size:
            stacks.setdefault(gap - size, []).append(seq)
            mask |= 1 << (gap - size)
    used = {p[2] for p in placed}
    rest = sorted((size, seq) for size, s in stacks.items() for seq in s)
    return placed, left, [g for g in rest if g[1] not in used], [g for g in rest if g[1] in used]


def _swept(items: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """One sweep over each range of the sorted documents and gaps; what it leaves has the number of its range and its rank there, largest first."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"kind": [], "id": [], "size": []})])
        side = lambda k: list(rows.loc[rows["kind"] == k, ["size", "id"]].itertuples(index=False, name=None))
        placed, left, gaps, used = sweep(side(DOC), side(GAP), capacity)
        pid = TaskContext.get().partitionId()
        out = [(PLACED, k, size, seq, at, pid, 0) for k, size, seq, at in placed]
        out += [(DOC, k, size, None, None, pid, i) for i, (size, k) in enumerate(left)]
        out += [(GAP, k, size, None, None, pid, i) for i, (size, k) in enumerate(reversed(gaps))]
        out += [(SHRUNK, k, size, None, None, pid, 0) for size, k in used]
        yield pd.DataFrame(out, columns=["kind", "id", "size", "seq", "at", "pid", "rank"]).astype({"seq": "Int64", "at": "Int32"})

    rows = items.select("kind", "id", "size")
    ranged = rows.repartitionByRange(tasks, "size", "kind", F.xxhash64("id")) if tasks > 1 else rows.repartition(1)
    return ranged.mapInPandas(of, _ROUND)


def _met(swept: DataFrame, most: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """What the ranges leave, matched across them: (kind, id, size, level, gap, room, slot) of each document, and the gaps no document can use.

    Read from the largest size down, gaps are opening and documents closing brackets: a document
    closes the bracket opened last that is still open, which is the smallest gap as large. A gap
    opens a bracket for each document that it holds whatever their sizes (those of smaller ranges),
    ``most`` at most. Brackets that belong together have the same level and follow each other there;
    the level is a running sum over ranges, one row each, and ranks within them. A level has at most
    two brackets of a range. A document without a gap has a level that no bracket opened: 0, -1, ..
    from the largest on.
    """
    down = Window.orderBy(F.desc("pid")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    left = swept.where(F.col("kind").isin(DOC, GAP))
    largest = left.groupBy("pid").agg(F.max(F.when(F.col("kind") == DOC, F.col("size"))).alias("largest"), F.count_if(F.col("kind") == DOC).alias("docs"))
    below = if_small(written(largest.select("pid", "docs", F.max("largest").over(up).alias("below")), "ranges", ranges))
    slots = F.when(F.col("below").isNull(), 0).otherwise(F.least(F.lit(most), F.floor(F.col("size") / F.col("below")))).cast("int")
    gaps = left.where(F.col("kind") == GAP).join(below.drop("docs"), "pid").withColumn("slots", slots)
    open_gaps = gaps.where("slots > 0")
    in_range = Window.partitionBy("pid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    opened = open_gaps.groupBy("pid").agg(F.sum("slots").alias("opens"))
    sums = below.join(opened, "pid", "left").select("pid", "docs", F.coalesce(F.sum(F.coalesce("opens", F.lit(0)) - F.col("docs")).over(down), F.lit(0)).alias("before"))
    levels = if_small(written(sums, "levels", ranges))
    closing = left.where(F.col("kind") == DOC).join(levels, "pid").select("pid", "kind", "id", "size", F.lit(0).alias("slot"), (F.col("before") - F.col("rank")).alias("level"))
    first = open_gaps.withColumn("first", F.coalesce(F.sum("slots").over(in_range), F.lit(0))).join(levels, "pid")
    opening = first.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select(
        "pid", "kind", "id", "size", "slot", (F.col("before") - F.col("docs") + 1 + F.col("first") + F.col("slot")).alias("level")
    )
    order = Window.partitionBy("level").orderBy(F.desc("pid"), "kind")
    mate = lambda step, k: F.when(step("kind").over(order) == k, F.struct(step("id").over(order).alias("id"), step("size").over(order).alias("size"), step("slot").over(order).alias("slot")))
    both = closing.unionByName(opening).withColumn("before", mate(F.lag, GAP)).withColumn("after", mate(F.lead, DOC))
    met = both.where((F.col("kind") == DOC) | F.col("after").isNotNull() | (F.col("slot") == 0)).select(
        "kind", "id", "size", "level", "slot", F.when(F.col("kind") == DOC, F.col("before.id")).alias("gap"), F.when(F.col("kind") == GAP, F.col("after.id")).alias("doc"), F.when(F.col("kind") == GAP, F.col("after.size")).alias("taken"),
    )
    return met, gaps.where("slots = 0").select("kind", "id", "size")


def best_fit(items: DataFrame, capacity: int = CAPACITY, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(id, seq, at): the sequence and offset of each of ``items`` (id long, size int; ids distinct).

    Documents longer than half the capacity open sequences. In each round the documents left and the
    gaps left are sorted by size into ranges; each task sweeps its range (a document takes the
    smallest gap as large, its successor); what a range leaves is matched across ranges by rank
    (see :func:`_met`), so that no two documents want the same gap; gaps shrink, gaps below the
    smallest document left are closed, and if documents need more room than all gaps have, or few
    fitted, the largest without a gap open new sequences. The driver sees sums only. Each round is
    a table in the shared folder.
    """
    big = F.col("size") * 2 > capacity
    base = items.select(F.col("id").cast("long").alias("id"), F.col("size").cast("int").alias("size"))
    fields = lambda kind, key, size, seq, at: (F.lit(kind).alias("kind"), F.col(key).alias("id"), F.expr(size).cast("int").alias("size"), F.expr(seq).cast("long").alias("seq"), F.expr(at).cast("int").alias("at"))

    def opened(rows: DataFrame) -> DataFrame:
        own = rows.select(*fields(PLACED, "id", "size", "id", "0"))
        return own.unionByName(rows.where(F.col("size") < capacity).select(*fields(GAP, "id", f"{capacity} - size", "null", "null")))

    def plain(kind: int, rows: DataFrame) -> DataFrame:
        return rows.select(*fields(kind, "id", "size", "null", "null"))

    after = written(opened(base.where(big)).unionByName(plain(DOC, base.where(~big))), "packed")
    counts = {r["kind"]: r["count"] for r in after.groupBy("kind").count().collect()}
    waiting, gaps_left, done = counts.get(DOC, 0), counts.get(GAP, 0), []
    for _ in range(MAX_ROUNDS):
        done.append(after.where(F.col("kind") == PLACED).select("id", "seq", "at"))
        if not waiting:
            break
        items, ranges = waiting + gaps_left, math.ceil((waiting + gaps_left) / rows_a_task)
        swept = written(_swept(after.where(F.col("kind") != PLACED), capacity, ranges), "swept")
        done.append(swept.where(F.col("kind") == PLACED).select("id", "seq", "at"))
        sums = {r["kind"]: r for r in swept.groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("size").alias("least")).collect()}
        of = lambda k, c: sums[k][c] if k in sums else 0  # noqa: E731, B023
        waiting = of(DOC, "n")
        if not waiting:
            break
        most = 1 + 2 * waiting // max(1, of(GAP, "n"))
        found, unused = _met(swept, most, ranges)
        met = written(found, "met", items)
        without = met.where((F.col("kind") == DOC) & F.col("gap").isNull()).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
        matched, rest = waiting - without["n"], without["size"] or 0
        room = of(GAP, "size") + of(SHRUNK, "size") - (of(DOC, "size") - rest)
        fitted = matched + of(PLACED, "n")
        waiting = without["n"]
        new = min(waiting, math.ceil((max(0, rest - max(0, room)) if fitted * 20 > waiting else rest) / capacity))
        least, gaps_left, waiting = of(DOC, "least"), of(GAP, "n") + of(SHRUNK, "n") + new, waiting - new
        docs = met.where((F.col("kind") == DOC) & F.col("gap").isNull())
        order = Window.partitionBy("id").orderBy("slot")
        upto = F.coalesce(F.sum("taken").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
        gaps = met.where(F.col("kind") == GAP).withColumn("upto", upto).withColumn("next", F.lead("slot").over(order))
        placed = gaps.where("doc is not null").select(*fields(PLACED, "doc", "taken", "id", f"{capacity} - size + upto - taken"))
        parts = [placed, plain(GAP, gaps.where("next is null").withColumn("size", F.col("size") - F.col("upto"))), plain(GAP, unused), plain(GAP, swept.where(F.col("kind") == SHRUNK))]
        parts += [opened(docs.where(F.col("level") > -new)), plain(DOC, docs.where(F.col("level") <= -new))]
        then = functools.reduce(DataFrame.unionByName, parts)
        after = written(then.where((F.col("kind") != GAP) | (F.col("size") >= least)), "packed", items)
        drop_written(met)
    else:
        raise RuntimeError(f"packing did not end in {MAX_ROUNDS} rounds")
    return functools.reduce(DataFrame.unionByName, done)


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """The pieces of :func:`token_pieces` with ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own. Offsets of a sequence have no gaps. Rows with repeated or
    null ids are packed each; an empty table gives no rows. Ids, if asked for, are stored with the
    pieces.
    """
    pieces = written(
        token_pieces(docs, tokenizer, doc_id, text, capacity, end_id, with_ids).withColumn("__id", F.monotonically_increasing_id()), "pieces"
    )
    at = best_fit(pieces.where(F.col("length") < capacity).select(F.col("__id").alias("id"), F.col("length").alias("size")), capacity)
    parts = pieces.join(at.withColumnRenamed("id", "__id"), "__id", "left")
    return parts.select(
        *[c for c in pieces.columns if c != "__id"], F.coalesce("seq", "__id").alias("sequence_id"), F.coalesce("at", F.lit(0)).cast("long").alias("offset")
    )
