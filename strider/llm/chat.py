"""Chat formatting: segments of a turn encoded apart, reserved ids spliced between them, loss masks by prefix sums."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.tables import written

# The control strings of the template. A turn is START role SEP text END.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END)
#: The role whose text is learned.
LEARNED = "assistant"

_NAMES = "|".join(c[2:-2] for c in CONTROL)
_PLAIN = re.compile(rf"<(\\*)\|({_NAMES})\|>")
_ESCAPED = re.compile(rf"<\\(\\*)\|({_NAMES})\|>")


def escape(text: str) -> str:
    """``text`` with a backslash put into each control string, after those that are there already."""
    return _PLAIN.sub(r"<\1\\|\2|>", text) if "|>" in text else text


def unescape(text: str) -> str:
    """What :func:`escape` was given."""
    return _ESCAPED.sub(r"<\1|\2|>", text) if "|>" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = [t.partition(SEP) for t in formatted.split(START)[1:]]
    return [(unescape(role), unescape(text.removesuffix(END))) for role, _, text in turns]


class Codec:
    """A byte-level tokenizer from a file, in which control strings of a text are ordinary text; reserved ids follow its vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.first = self.model.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids, skip_special_tokens=False)

    def text(self, ids: list[int]) -> str:
        """All ids as text, the reserved ones as their control strings."""
        out, begun = [], 0
        for at, i in enumerate([*ids, self.first]):
            if i >= self.first:
                out.append(self.decode(ids[begun:at]))
                out += [CONTROL[i - self.first]] if at < len(ids) else []
                begun = at + 1
        return "".join(out)


def assemble(roles: list[list[int]], texts: list[list[int]], learned: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, mask) of all turns, one after the other; ``first`` is the id of START, SEP and END follow.

    Where a segment starts is the prefix sum of the lengths before it; the mask is the prefix sum of
    +1 where a learned text starts and -1 where it ends.
    """
    n = len(roles)
    lengths = np.ones((n, 5), np.int64)
    lengths[:, 1], lengths[:, 3] = [len(r) for r in roles], [len(t) for t in texts]
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    total = int(ends[-1, -1]) if n else 0
    ids, step = np.empty(total, np.int32), np.zeros(total + 1, np.int64)
    for k, reserved in ((0, first), (2, first + 1), (4, first + 2)):
        ids[starts[:, k]] = reserved
    for i in range(n):
        ids[starts[i, 1] : ends[i, 1]] = roles[i]
        ids[starts[i, 3] : ends[i, 3]] = texts[i]
    np.add.at(step, starts[learned, 3], 1)
    np.add.at(step, ends[learned, 3], -1)
    return ids, np.concatenate([starts[:, 0], [total]]) if n else np.zeros(1, np.int64), np.cumsum(step)[:total].astype(bool)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _formatter(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, roles = Codec(path), {}
        now, place, tokens, loss = object(), 0, 0, 0
        for b in batches:
            convs, said = b.column("conv_id").to_pylist(), b.column("role").to_pylist()
            for r in set(said) - roles.keys():
                roles[r] = codec.encode([escape(r)])[0]
            texts = codec.encode([escape(t) for t in b.column("text").to_pylist()])
            learned = np.array([r == LEARNED for r in said], bool)
            ids, offsets, mask = assemble([roles[r] for r in said], texts, learned, codec.first)
            if len(roles) > 10_000:
                roles.clear()
            sizes, learn = np.diff(offsets), np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
            ahead = np.empty((len(convs), 3), np.int64)
            for i, c in enumerate(convs):
                if i == 0 and c != now or i and c != convs[i - 1]:
                    place = tokens = loss = 0
                ahead[i] = place, tokens, loss
                place, tokens, loss, now = place + 1, tokens + sizes[i], loss + learn[i], c
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("conv_id"), b.column("turn"), _lists(offsets, ids), _lists(offsets, mask), *[pa.array(ahead[:, k]) for k in range(3)], pa.array(sizes), pa.array(learn)],
                names=["part", "conv_id", "turn", "ids", "mask", "place", "token_start", "loss_start", "n_tokens", "n_loss"],
            )

    return of


def format_conversations(
    conversations: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turn, place, ids, mask, token_start, loss_start) of each row, a turn of a conversation.

    ids: the reserved id of START, the escaped role, SEP, the escaped text, END, in token ids of
    ``tokenizer`` (a byte-level one, so all text comes back). mask: true for the text of an
    ``assistant``. place, token_start and loss_start: turns, ids and learned ids of the conversation
    before this turn.

    Turns go by ``turn``, nulls first, then by role and text; repeated rows are turns each. A null role
    or text is empty; rows without a conv_id are one conversation. An empty table gives no rows.
    Rows are sorted in ranges of (conv_id, turn, role, text), so that a conversation of any size is
    spread over tasks, and each range adds what those before it hold of its first conversation.
    """
    spark = conversations.sparkSession
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    counts = "place long, token_start long, loss_start long, n_tokens long, n_loss long"
    schema = f"part int, conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, mask array<boolean>, {counts}"
    turns = written(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_formatter(tokenizer), schema), "turns")
    sums = turns.groupBy("conv_id", "part").agg(F.count("*").alias("a"), F.sum("n_tokens").alias("b"), F.sum("n_loss").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), *[F.sum(x).over(before).alias(x) for x in "abc"]).where("a is not null")
    # A range has at most one conversation that began before it, so these rows are as few as ranges.
    met = turns.join(F.broadcast(ahead), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")), "left")
    plus = lambda c, x: (F.col(c) + F.coalesce(F.col(x), F.lit(0))).alias(c)
    return met.select("conv_id", "turn", plus("place", "a"), "ids", "mask", plus("token_start", "b"), plus("loss_start", "c"))


def _reader(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        marks = [codec.first + k for k in range(3)]
        for b in batches:
            said, learned, chars = [], [], []
            for ids, mask in zip(b.column("ids"), b.column("mask"), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False)
                at = np.flatnonzero(ids >= codec.first)
                if ids[at].tolist() != marks or at[0] != 0 or at[2] != len(ids) - 1:
                    raise ValueError("a turn is not START role SEP text END")
                role, text = codec.decode(ids[1 : at[1]].tolist()), codec.decode(ids[at[1] + 1 : -1].tolist())
                said.append(f"{unescape(role)}\n{unescape(text)}\n")
                learned.append(unescape(codec.decode(ids[mask].tolist())))
                chars.append(sum(map(len, CONTROL)) + len(role) + len(text))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("place"), pa.array(said, pa.string()), pa.array(learned, pa.string()), pa.array(chars, pa.int64())], names=["conv_id", "place", "said", "learned", "chars"]
            )

    return of


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = object(), None
    names, kind = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None

    def row() -> pa.RecordBatch:
        n, turns, size, loss, chars = state
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, n, turns.hexdigest(), size, loss.hexdigest(), chars), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=names)

    for b in batches:
        kind = b.column("conv_id").type
        for conv, said, learned, chars in zip(*[b.column(c).to_pylist() for c in ("conv_id", "said", "learned", "chars")], strict=True):
            if state is None or conv != now:
                if state is not None:
                    yield row()
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[0] += 1
            state[1].update(said.encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += chars
    if state is not None:
        yield row()


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the ids and masks of :func:`format_conversations`.

    Ids are decoded where they lie; the texts of a conversation then pass through its two digests in
    order, a stream of which a task holds one batch. A digest is a chain, so one conversation's
    texts are hashed in one task, however many they are.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    texts = formatted.select("conv_id", "place", "ids", "mask").mapInArrow(_reader(tokenizer), f"conv_id {kind}, place long, said string, learned string, chars long")
    dealt = texts.repartition(int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
