"""WARC archives: a deterministic sharded writer and a reader."""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strider.llm.tables import drop_written, if_small, new_path, written

#: Payload bytes of a shard, most shards (beyond that they are larger), and compressed bytes at which a file of one is closed.
SHARD_BYTES, MOST_SHARDS, ROLL_BYTES = 32 << 20, 20_000, 8 << 20
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record_id(kind: str, key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One gzip member: a WARC record of this type, with length and block digest made from the block."""
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def _http(length: int, body: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + body


def page_record(page_id, url: str | None, payload: bytes, digest: str, length: int, refers_to, again: str = "") -> bytes:
    """The response or, with ``refers_to``, the revisit record of a page; its payload is stored in the former only.

    ``again`` tells records of the same page_id and digest apart; the first has none.
    """
    headers = [
        ("WARC-Record-ID", _record_id("page", f"{page_id}:{digest}{again}")), ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(length)),
    ]
    if refers_to is None:
        return record("response", headers, _http(length, payload))
    headers += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", _record_id("page", f"{refers_to}:{digest}")), ("X-Refers-To-Page-Id", str(refers_to)),
    ]
    return record("revisit", headers, _http(length, b""))


def _shard_starts(sizes: DataFrame, shard_bytes: int, most: int) -> list[bytes]:
    """The first key of each shard but the first: runs of sorted ``sizes`` (key, bytes) of about so many bytes, ``most`` of them at most.

    Rows are sorted in ranges and summed from the first on, so starts do not depend on how the
    input or the ranges are split.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    width = max(shard_bytes, -(-total // most))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(sizes.repartitionByRange(n, "key").sortWithinPartitions("key").select("key", "bytes", F.monotonically_increasing_id().alias("at")), "placed")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    part = F.shiftrightunsigned("at", 33)
    sums = placed.groupBy(part.alias("p")).agg(F.sum("bytes").alias("bytes"))  # a row for each task of the sort
    offsets = if_small(written(sums.select("p", F.coalesce(F.sum("bytes").over(ahead(Window.orderBy("p"))), F.lit(0)).alias("offset")), "offsets"))
    before = F.coalesce(F.sum("bytes").over(ahead(Window.partitionBy("p").orderBy("at"))), F.lit(0))
    shard = F.floor((F.col("offset") + F.col("before")) / width)
    starts = placed.withColumn("p", part).withColumn("before", before).join(offsets, "p").groupBy(shard.alias("shard")).agg(F.min("key").alias("key"))
    found = [bytes(r["key"]) for r in starts.orderBy("shard").collect()][1:]
    drop_written(placed)
    return found


def plan_records(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT,
    shard_bytes: int = SHARD_BYTES, most: int = MOST_SHARDS,
) -> tuple[DataFrame, int]:
    """(shard, first, page_id, digest, bytes, kept, url, body) and the number of shards.

    Of equal payloads of ``least`` bytes or more the one with the largest page_id is stored; rows
    that repeat that id are stored too. Each other page has, besides its row, a notice without body
    whose ``kept`` is that page_id. Repeats are found on digests alone and notices travel with the
    bodies, so each body is shuffled once, however many repeat. Shards are runs of page_id and
    digest, cut by the exact sum of bytes before them; no more than ``most`` first keys come to the
    driver. Rows without an id are sorted by digest alone. Where rows of one page_id and payload
    fill several shards, they are dealt to these; ``first`` is the first of them.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha1("body")).withColumn("bytes", F.length("body").cast("long"))
    sizes = written(rows.select("page_id", "digest", "bytes"), "digests")
    repeated = sizes.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    repeated = written(repeated.where("n > 1 and kept is not null").drop("n"), "repeated")
    notices = sizes.join(if_small(repeated), ["digest", "bytes"]).where("page_id is null or page_id < kept")
    # Bytes that sort like (page_id, digest), null first.
    sorted_id = F.unhex(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    key = F.concat(F.when(F.col("page_id").isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), sorted_id)), F.unhex("digest"))
    starts = _shard_starts(sizes.select(key.alias("key"), "bytes"), shard_bytes, most)
    shared = pages.sparkSession.sparkContext.broadcast(starts)

    @F.pandas_udf("lo int, hi int")
    def shards_of(keys: pd.Series) -> pd.DataFrame:
        cuts = shared.value
        hi = [bisect.bisect_right(cuts, bytes(k)) for k in keys]
        lo = [min(h, bisect.bisect_left(cuts, bytes(k)) + 1) for h, k in zip(hi, keys, strict=True)]
        return pd.DataFrame({"lo": lo, "hi": hi}, dtype="int32")

    both = rows.withColumn("kept", F.lit(None).cast("long")).unionByName(notices, allowMissingColumns=True).withColumn("at", shards_of(key))
    dealt = F.array((F.col("at.lo") + F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.col("at.hi") - F.col("at.lo") + 1)).cast("int"))
    plan = both.withColumn("shard", F.explode(F.when(F.col("kept").isNull(), dealt).otherwise(F.sequence("at.lo", "at.hi"))))
    return plan.select("shard", F.col("at.lo").alias("first"), "page_id", "digest", "bytes", "kept", "url", "body"), len(starts) + 1


def write_warc(pages: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES, **options) -> DataFrame:
    """Write the archives below ``uri`` and return their manifest (file, records, bytes).

    Each shard is sorted by page_id and written as files closed at ``roll_bytes`` compressed, named
    by shard and number. A task writes under a temporary name of its own and renames a file when it
    is whole, so an attempt that is lost or repeated leaves no half file and the same bytes. The
    manifest is a table committed after all files; readers open only what it lists. An empty table
    writes no file.
    """
    plan, shards = plan_records(pages, **options)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _fs(uri)
        store.create_dir(root, recursive=True)
        out, shard, number, state, notice, last, times = [], None, 0, {}, (None, None), None, 0

        def close() -> None:
            if state:
                state["to"].close()
                store.move(state["as"], f"{root}/{state['name']}")
                out.append((state["name"], state["n"], state["size"]))
                state.clear()

        for b in batches:
            for r in b.itertuples(index=False):
                own = r.page_id, r.digest, r.bytes
                if r.kept is not None:
                    notice = own, int(r.kept)
                    continue
                if r.shard != shard or state.get("size", 0) >= roll_bytes:
                    close()
                    shard, number = r.shard, number + 1 if r.shard == shard else 0
                if not state:
                    name = f"part-{shard:06d}-{number:05d}.warc.gz"
                    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                    info = record("warcinfo", [("WARC-Record-ID", _record_id("file", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    state.update(name=name, to=store.open_output_stream(temporary, compression=None), n=0, size=len(info), **{"as": temporary})
                    state["to"].write(info)
                refers = notice[1] if notice[0] == own else None
                last, times = (r.shard, own), times + 1 if last == (r.shard, own) else 0
                again = "" if r.shard == r.first and not times else f":{r.shard}:{times}"
                data = page_record(r.page_id, r.url, b"" if refers is not None else bytes(r.body), r.digest, int(r.bytes), refers, again)
                state["to"].write(data)
                state["n"] += 1
                state["size"] += len(data)
        close()
        yield pd.DataFrame(out, columns=["file", "records", "bytes"])

    order = [F.col("shard"), F.col("page_id").asc_nulls_first(), "digest", "bytes", F.col("kept").desc_nulls_last(), "url"]
    dealt = plan.repartitionById(shards, F.col("shard")).sortWithinPartitions(*order)
    # As strings, ids stay exact where some are null.
    dealt = dealt.withColumns({c: F.col(c).cast("string") for c in ("page_id", "kept")})
    return written(dealt.mapInPandas(of, "file string, records long, bytes long"), "manifest")


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each whole."""
    z, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(z.decompress(data))
            data = b""
            if z.eof:
                yield b"".join(parts)
                data, z, parts = z.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record; its length and digest are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or _sha1(block) != headers["warc-block-digest"]:
        raise ValueError("a record's length or block digest is wrong")
    return headers, block


def read_warc(manifest: DataFrame, uri: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of the records of the listed files.

    Reads a file as a stream, a record at a time. The digest of a stored payload is verified.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _fs(uri)
        for b in batches:
            for name, count in zip(b["file"], b["records"], strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        h, block = parse_record(data)
                        if h["warc-type"] == "warcinfo":
                            continue
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        body = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                        if body is not None and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(h["x-payload-length"])):
                            raise ValueError(f"a payload in {name} does not match its digest")
                        refers = h.get("x-refers-to-page-id")
                        rows.append((int(h["x-page-id"]) if h["x-page-id"] else None, h["warc-target-uri"], int(h["x-payload-length"]), digest, h["warc-type"], int(refers) if refers else None, body))
                        seen += 1
                        if len(rows) == 1000:
                            yield _frame(rows)
                            rows = []
                if seen != count:
                    raise ValueError(f"{name} has {seen} records, its manifest {count}")
                yield _frame(rows)

    return manifest.select("file", "records").repartition(max(1, manifest.count())).mapInPandas(
        of, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def warc_round_trip(pages: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """What :func:`read_warc` gives of the archives written of ``pages``, without the payloads."""
    uri = new_path(spark, "warc")
    return read_warc(write_warc(pages, uri, **options), uri).drop("payload", "url")
