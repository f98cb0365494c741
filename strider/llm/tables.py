"""Tables written to the shared folder, which cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where all tasks share the machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strider-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Rows of a few numbers each that a task writes, where their number is known.
ROWS_A_TASK = 5000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again with the same schema.

    ``rows``: about how many it has, if its last step is light, so that a small table has few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_TASK + 1)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strider_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`written` once nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_strider_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch of whole texts; their number has no effect on results.
BATCH_ROWS = 100


def small_batches(spark: SparkSession) -> None:
    """Let workers get texts in batches of at most ``BATCH_ROWS`` rows, so that a batch of long ones stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: Bytes of a side, counted as rows in memory, up to which it is broadcast.
BROADCAST_BYTES = 12 << 20


def _bytes(kind: T.DataType, value: Column) -> Column:
    """About the bytes of a value in a row in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            return F.coalesce(F.aggregate(value, F.lit(16), lambda s, x: (s + _bytes(kind.elementType, x)).cast("int")), F.lit(0)) + 8
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(16))
    return F.lit(8)


def is_small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, a written table, take at most ``most`` bytes in memory (with 24 a row besides its columns)."""
    row = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(24))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most


def if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, marked for broadcast if :func:`is_small`; else the join shuffles."""
    return F.broadcast(df) if is_small(df, most) else df
