"""What the training-data operators share: the shared scratch folder, row keys and batch sizes.

Every operator takes a DataFrame with ``doc_id`` and ``text`` and ignores other columns, whatever
their names. Each row counts as a document of its own, also when another row repeats it.
"""

from __future__ import annotations

import atexit
import gc
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if a session on one machine names no shared folder (local runs and tests).
LOCAL_SHARED = "/tmp/checkpoints/sparkwell"
#: Rows of whole texts, and their bytes, that a Python worker holds at once; one longer text is a batch of its own.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20
#: The six ASCII characters between words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local one where that is unset and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or LOCAL_SHARED


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors. Also gives the path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkwell-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``written`` for tables that a result still reads: they go when the driver's Python ends."""
    return written(df, name)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more; a session that has ended can't, and leaves it."""
    context = spark.sparkContext
    if context._jsc is None:
        return
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark then deletes the shuffle files of queries that nothing holds any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what Arrow hands to a Python worker at once; texts may be long. Holds for the session: queries run after this returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_id() -> Column:
    """The doc_id, or 64 bits of the text where there is none."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), F.col("text")))


def row_tag() -> Column:
    """64 bits that tell rows of one doc_id apart by their text; with row_id 128 bits for rows without id."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """(_id, _tag, doc_id, text as UTF-8 bytes): _id and _tag name a text for joins, also if ids are null or repeat."""
    return docs.select(row_id().alias("_id"), row_tag().alias("_tag"), F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
