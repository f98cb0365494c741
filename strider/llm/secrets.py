"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.tables import is_small, written

# The base patterns and the least lengths of what they match.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What the ownership test may add: unlabelled runs of key characters.
ADDED = "owned"
_BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|x{4}|0{6}|1234567", re.I)

#: A value that more owners, or more repositories, have is a widely copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20
MIN_BITS = 3.0
#: Parts that the rows of a hash are dealt to where they meet what is known of it.
SALTS = 16

_SPAN = "array<struct<start:long,rank:int,kind:string,end:long,hash:string,live_looking:boolean>>"


def live_looking(value: str, min_bits: float = MIN_BITS) -> bool:
    """Of 16 characters or more, with a letter and a digit, ``min_bits`` of entropy each, no placeholder."""
    n = len(value)
    if n < 16 or not (re.search("[A-Za-z]", value) and re.search("[0-9]", value)) or _PLACEHOLDER.search(value):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= min_bits


def candidates(text: str | None) -> list[tuple[int, int, str, int, str]]:
    """(start, rank, kind, end, value) of the base matches and of bare runs that overlap none of them.

    Offsets are code points, the end is exclusive. Base matches are leftmost and do not overlap
    others of their kind; those too short are dropped after matching.
    """
    text = text or ""
    found = [(m.start(), 0, "assign", m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted(found)
    at, reach = 0, 0
    for m in _BARE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][3])
            at += 1
        if reach <= m.start() and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            found.append((m.start(), 3, ADDED, m.end(), m[0]))
    return sorted(found)


def scan(docs: DataFrame, keep: list[str], text: str = "text", min_bits: float = MIN_BITS) -> DataFrame:
    """The columns ``keep`` of each row and ``found``, its candidates with the hash of each value."""
    kept = [f for f in docs.select(*keep).schema]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"found {_SPAN}"])

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(found=[
                [{"start": s, "rank": r, "kind": k, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], "live_looking": live_looking(v, min_bits)}
                 for s, r, k, e, v in candidates(t)]
                for t in b["__text"]
            ])
            yield b.drop(columns="__text")

    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(of, schema)


def ownership(found: DataFrame, owner: str = "owner", repository: str = "repository", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(hash, repositories, owners, copied) of each candidate hash of rows with ``found``.

    A null owner or repository is one of its own; owners count apart where they have a repository
    of the same name. Counts go through (hash, owner, repository) groups, which are summed before
    each shuffle, so that a hash in a third of all rows is no large group. copied: more than
    ``max_owners`` owners or ``max_repositories`` repositories have it.
    """
    each = found.select(
        F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"),
        F.col(owner).alias("o"), F.col(repository).alias("r"),
    )
    pairs = each.groupBy("hash", "o", "r").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("hash", "o").agg(F.sum("one").alias("repositories"))
    return (
        by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
        .withColumn("copied", (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories))
    )


_JUDGED = "array<struct<start:long,rank:int,kind:string,end:long,copied:boolean>>"


def judged(
    docs: DataFrame, keep: list[str], text: str = "text", owner: str = "source", repository: str = "doc_id",
    max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, min_bits: float = MIN_BITS,
) -> DataFrame:
    """The columns ``keep`` of each row, n_live, n_example, most_owners, most_repositories and ``spans``.

    Base matches are always spans. Others become spans of kind ``owned`` if they look live and few
    owners and repositories have their hash anywhere in the corpus; the rest are widely copied
    examples and add nothing. n_live and n_example count the spans and candidates of either sort,
    the other two are the largest counts of any candidate of the row. The table in the shared folder
    holds spans, never texts. What is known of a hash is broadcast while that is small; else it
    meets the rows by hash and salt, so that a hash in a third of them is dealt to many tasks.
    """
    named = docs.select(*keep, F.col(text).alias("__text"), F.col(owner).alias("__owner"), F.col(repository).alias("__repository"))
    found = written(
        scan(named, [*keep, "__owner", "__repository"], "__text", min_bits).withColumn("__row", F.monotonically_increasing_id()), "spans"
    )
    some = found.where(F.size("found") > 0)
    owners = written(ownership(some, "__owner", "__repository", max_owners, max_repositories), "owners")
    each = some.select("__row", F.explode("found").alias("s")).select("__row", "s", F.col("s.hash").alias("hash"))
    if is_small(owners):
        met = each.join(F.broadcast(owners), "hash")
    else:
        salted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = each.withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    live = F.col("s.live_looking") & ~F.col("copied")
    known = met.groupBy("__row").agg(
        F.collect_list(F.when((F.col("s.rank") < 3) | live, F.struct("s.start", "s.rank", "s.kind", "s.end", "copied"))).alias("spans"),
        F.count_if(live).alias("n_live"), F.count_if("copied").alias("n_example"),
        F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.join(known, "__row", "left").select(
        *keep, *map(zero, ("n_live", "n_example", "most_owners", "most_repositories")),
        F.coalesce(F.array_sort("spans"), F.array().cast(_JUDGED)).alias("spans"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", **options) -> DataFrame:
    """One row per row of ``docs``: counts per base kind, a digest of the base spans, all spans.

    Null and empty texts have no spans (the digest is that of the empty string). Repeated rows are
    reported each; an owner or id that is null counts as a value; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(owner).alias("source"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return judged(rows, ["doc_id"], **options).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example", "most_owners", "most_repositories",
    )


def redact(text: str | None, spans) -> str | None:
    """The text with each span, overlapping ones together, replaced by ``[SECRET]``."""
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
