"""Ledger turns from growing folders of JSON lines, as Structured Streaming.

Files are immutable once they appear; a turn that two files hold is counted once, by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "timestamp string, type string, session string, message struct<model:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
KEY = ["session", "ts", "input_tokens", "output_tokens", "cache_read_tokens"]


def parse_turns(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) to turns; lines that are no JSON or carry no usage are skipped."""
    rows = lines.select(F.from_json("value", TURN).alias("v")).where(F.col("v.message.usage").isNotNull())
    usage = F.col("v.message.usage")
    count = lambda c, name: F.coalesce(usage[c], F.lit(0)).alias(name)
    return rows.select(
        F.coalesce("v.session", F.lit("")).alias("session"),
        # The zone is ignored: the clock time counts as UTC.
        F.to_timestamp(F.substring("v.timestamp", 1, 19), "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.coalesce("v.message.model", F.lit("")).alias("model"),
        count("input_tokens", "input_tokens"),
        count("output_tokens", "output_tokens"),
        count("cache_read_input_tokens", "cache_read_tokens"),
        count("cache_creation_input_tokens", "cache_write_tokens"),
    )


def read_turns(spark: SparkSession, folder: str, late: str = "7 days") -> DataFrame:
    """A stream of turns, each once; keys are remembered for ``late`` of event time, which bounds the state."""
    lines = spark.readStream.format("text").load(folder)
    return parse_turns(lines).withWatermark("ts", late).dropDuplicatesWithinWatermark(KEY)


def hourly(turns: DataFrame) -> DataFrame:
    """Tumbling windows by model; works on streams and tables alike."""
    return turns.groupBy(F.window("ts", "1 hour").alias("w"), "model").agg(F.count("*").alias("turns"), F.sum("output_tokens").alias("output")).select(F.col("w.start").alias("hour"), "model", "turns", "output")


def sync(turns: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is new since the last call and stop."""
    turns.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
