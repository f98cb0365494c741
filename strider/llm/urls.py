"""URL filters: host and path rules, then a blocked Bloom filter and an exact join with listed URLs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.llm.tables import written

#: Words of a block of the filter, bits of a word, and bits of the filter a listed URL gets.
WORDS, WORD_BITS, BITS_PER_KEY = 8, 32, 16
#: A filter of at most so many bytes is broadcast; a larger one is joined by block.
BROADCAST_BYTES = 32 << 20
#: Listed URLs that rows hit up to which these are broadcast; beyond that they are joined by URL and salt.
BROADCAST_URLS, SALTS = 200_000, 32

#: The rules of the ``pages`` query. (host, path) with what they say.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The URL without scheme, leading ``www.``, fragment, last slash and tracking parameters, the others sorted.

    Null where there is no ``://``.
    """
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]*|ref|fbclid|gclid)(=|$)")))
    bare = F.concat(F.regexp_replace(host(url), "^www[.]", ""), F.regexp_replace(path(url), "/$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(bare, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def longest_rule(h: Column, p: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule whose host is ``h`` or a domain above it and whose path starts ``p``; null if none."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and, for each word of it, the mask of the key's bit."""
    bits = F.xxhash64(key, F.lit(1))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")) for i in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), masks


def bloom_filter(listed: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, w0 .. w7) of the distinct keys of ``listed``: a bit set in each word of the block a key hashes to."""
    block, masks = _place(F.col(key), blocks)
    return listed.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]
    )


def filter_urls(urls: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url", rules=RULES, broadcast_urls: int = BROADCAST_URLS) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed, possible) of each row of ``urls``.

    verdict: the longest rule's, else block if the canonical URL is listed, else allow. The Bloom
    filter passes all listed URLs and a thousandth of the others (``possible``); their distinct
    values meet the list in an exact join. The filter takes 16 bits a listed URL and is broadcast
    up to ``BROADCAST_BYTES``; beyond that it is joined by block. Up to ``broadcast_urls`` listed URLs
    that occur meet the rows by broadcast; beyond that only possible hits are shuffled, salted, so
    that a URL of a third of all rows is dealt to many tasks. Null URLs have empty host and
    path and are never listed; repeated rows are judged each; empty tables give no rows.
    """
    keys = written(listed.select(canonical(F.col(listed_url)).alias("key")).where("key is not null").distinct(), "listed")
    blocks = max(1, math.ceil(keys.count() * BITS_PER_KEY / (WORDS * WORD_BITS)))
    filters = bloom_filter(keys, blocks)
    if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        filters = F.broadcast(filters)
    rows = urls.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    block, masks = _place(F.col("key"), blocks)
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) != 0)
    probed = rows.withColumn("block", F.when(F.col("key").isNotNull(), block)).join(filters, "block", "left")
    marked = probed.select("page_id", "host", "path", "key", F.coalesce(hit, F.lit(False)).alias("possible"))
    exact = written(marked.where("possible").select("key").distinct().join(keys, "key").select(F.col("key").alias("sure")), "exact")
    if exact.count() <= broadcast_urls:
        judged = marked.join(F.broadcast(exact), F.when(F.col("possible"), F.col("key")) == F.col("sure"), "left")
    else:
        salted = exact.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = marked.where("possible").withColumn("own", F.pmod(F.xxhash64("page_id", F.lit(2)), F.lit(SALTS)).cast("int"))
        met = dealt.join(salted, (F.col("key") == F.col("sure")) & (F.col("own") == F.col("salt")), "left").drop("own", "salt")
        judged = met.unionByName(marked.where("not possible").withColumn("sure", F.lit(None).cast("string")))
    judged = judged.withColumn("listed", F.col("sure").isNotNull())
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.withColumn("by", rule).select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"),
        F.coalesce("by.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed", "possible",
    )


# Words for which a page is reported in the ``pages`` query.
REPORTED = ("idiot", "worthless", "pathetic", "disgusting")


def reported(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url) of pages whose markup holds one of the words ``REPORTED``."""
    return pages.where(F.col(html).rlike(rf"(?i)\b({'|'.join(REPORTED)})\b")).select(F.col(url).alias("url"))
