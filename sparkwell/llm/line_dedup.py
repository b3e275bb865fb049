"""Line deduplication across documents, with DataFrame functions only.

A line's key (stripped, A-Z lower-cased) is hashed to 96 bits and its text left behind. The hashes are
range-partitioned and sorted by document and position inside each range; a running ``first`` streams over
them and keeps the lines of the first document of each key. What goes back to the documents is a
run-length compressed bitmap of the lines, not text.

A key that a third of all documents hold is split: the first pass ranges over (hash, slice of the ids), so
such a key is spread over ``SLICES`` ranges, each of which keeps its own first document and drops the
rest for good. A second pass over the survivors, at most ``SLICES`` documents a key, keeps the first of them.

Defined cases: a null or empty text is one empty line; keys shorter than ``min_chars`` are never dropped;
repeated lines of the first document all stay; rows that share a doc_id are one document; rows without
doc_id are one document that comes after all others; an empty table gives an empty result; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.llm.common import SPACES, partitions, row_id, row_tag

SLICES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped of the six ASCII spaces at both ends; A-Z lower-cased, other letters as they are."""
    bare = F.trim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(docs: DataFrame) -> DataFrame:
    """(_id, _tag, _none, lines, doc_id, text, row): one row per input row; _none: it has no doc_id."""
    return docs.select(
        row_id().alias("_id"),
        row_tag().alias("_tag"),
        F.col("doc_id").isNull().alias("_none"),
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1).alias("lines"),
        F.col("doc_id"),
        F.col("text"),
        F.struct("*").alias("row"),
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(_id, _tag, n_dropped, dropped): for each row that loses lines, the zero runs of its keep bitmap.

    ``dropped`` is an array of (first, last) positions, counted from 0; rows that keep all lines have no row.
    """
    n = partitions(docs.sparkSession)
    document = F.when(~F.col("_none"), F.col("_id"))  # rows without doc_id are one
    hashes = (
        _lines(docs)
        .select("_id", "_tag", "_none", F.posexplode("lines").alias("pos", "line"))
        .select("_id", "_tag", "_none", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("_id", "_tag", "_none", "pos", F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), F.pmod(F.hash(document), F.lit(SLICES)).cast("byte").alias("slice"))
    )
    stream = lambda *keys: F.first(document).over(Window.partitionBy(*keys).orderBy("_none", "_id", "_tag", "pos").rowsBetween(Window.unboundedPreceding, 0))
    of_first = document.eqNullSafe(F.col("first"))
    sliced = hashes.repartitionByRange(n, "h1", "h2", "slice").withColumn("first", stream("h1", "h2", "slice"))
    heads = sliced.where(of_first).drop("first", "slice")
    ranged = heads.repartitionByRange(n, "h1", "h2").withColumn("first", stream("h1", "h2"))
    lost = sliced.where(~of_first).select("_id", "_tag", "pos").unionByName(ranged.where(~of_first).select("_id", "_tag", "pos"))
    by_row = Window.partitionBy("_id", "_tag").orderBy("pos")
    # Rows that repeat one another lose the same lines: dense_rank counts a position once.
    runs = lost.withColumn("run", F.col("pos") - F.dense_rank().over(by_row)).groupBy("_id", "_tag", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.groupBy("_id", "_tag").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("dropped"),
    )


def drop_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Apply the bitmaps: (row, doc_id, text, kept_text, n_lines, n_dropped, dropped), one row per input row.

    ``row`` is the input row as a struct; Spark reads its columns only if they are used.
    """
    maps = keep_bitmaps(docs, min_chars)
    joined = _lines(docs).join(maps, ["_id", "_tag"], "left")
    gone = F.flatten(F.transform("dropped", lambda r: F.sequence(r["first"], r["last"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    kept = F.when(F.col("dropped").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.select(
        "row",
        "doc_id",
        "text",
        kept.alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.col("n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        "dropped",
    )
