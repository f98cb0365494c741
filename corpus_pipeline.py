"""From raw documents to packed training sequences, one stage after the other.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on all that the one before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.llm import langid, mixing, packing, secrets, simhash
from strider.llm.queries import tokenizer_path
from strider.llm.tables import if_small, small_batches, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents, drops those without a letter or far from every language, labels the unlabelled.

    Null and empty texts go; repeated rows are judged alike; without a labelled row all go. Other
    columns stay as they are, whatever their names.
    """
    small_batches(spark)
    judged = langid.predict(docs, langid.fit(docs), prefix="__").where("not __rejected")
    return judged.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one stays: that with the smallest doc_id (null last), and of its texts that with the least hash.

    A doc_id that repeats with unlike texts keeps one row for each, and so do unlike texts without
    an id; of rows equal in id and text one stays, the least by its other columns. Null and empty
    texts are one group. An empty table gives no rows.
    """
    small_batches(spark)
    n = docs.count()
    keys = simhash.similar_documents(docs).groupBy("doc_id", "digest").agg(F.first("component").alias("component"), F.count("*").alias("n"))
    keys = written(keys.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")), "keys", n)
    kept = written(keys.groupBy("component").agg(F.min("key").alias("kept")), "kept", n)
    named = lambda rows: if_small(written(rows.select(F.col("key.doc_id").alias("__id"), F.col("key.digest").alias("__digest")), "kinds", n))
    judged = keys.join(if_small(kept), "component")
    again = written(judged.where("n > 1 and key = kept").select("key"), "again", n)
    of = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__digest"))
    left = docs.join(named(judged.where("key <> kept")), of, "left_anti")
    if not again.head(1):
        return left
    repeated = named(again)
    rest = left.join(repeated, of, "left_anti")
    least = left.join(repeated, of).groupBy("__id", "__digest").agg(F.min(F.struct(*docs.columns)).alias("one"))
    return rest.unionByName(least.select("one.*").select(*docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each reported span; a widely copied example that no base pattern matches stays.

    Spans belong to a doc_id and text, so other texts of a repeated or null doc_id keep what lies
    there. Null and empty texts stay as they are, repeated rows are treated alike; n_chars follows
    the text; an empty table gives no rows.
    """
    small_batches(spark)
    found = secrets.judged(docs.withColumn("__digest", F.xxhash64("text")), ["doc_id", "__digest"]).select("doc_id", "__digest", F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias("__spans"))
    found = found.where(F.size("__spans") > 0).groupBy("doc_id", "__digest").agg(F.array_distinct(F.flatten(F.collect_list("__spans"))).alias("__spans"))
    found = written(found.withColumnRenamed("doc_id", "__id"), "found")
    of = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__digest"))
    marked = docs.join(if_small(found), of, "left").drop("__id", "__digest")

    @F.pandas_udf("string")
    def redacted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in batches:
            yield pd.Series([secrets.redact(t, None if s is None else [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redacted("text", "__spans"))
    return marked.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it: a null source is one of its own, texts of no words stay out or in by chance, an empty table gives no rows."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their sequence and offset; null and empty texts are one piece, repeated rows are packed each, an empty table gives no rows."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can express neither a learned classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
