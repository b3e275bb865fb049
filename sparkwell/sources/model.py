"""The engine's fact and dimension tables: observations, sessions and ledger turns, projected from the test tables.

Each function is a narrow projection, so filters and column pruning reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One optimized tool call a row: raw and delivered tokens, model, reasons as JSON text."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    raw = F.coalesce(F.round(F.col("value") * 100), F.lit(0)).cast("long")
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("tool_type"),
        epoch_seconds(F.col("ts")).alias("created_at"),
        raw.alias("raw_tokens"),
        F.floor(raw * F.least(k, F.lit(100)) / 100.0).cast("long").alias("delivered_tokens"),
        k.alias("k"),
    )
    avoided = F.greatest(F.col("raw_tokens") - F.col("delivered_tokens"), F.lit(0))
    half = F.expr("div(avoided_tokens, 2)")
    reasons = F.when(F.col("k") % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit('[{"label":"log noise","tokens":'), half.cast("string"), F.when(F.col("k") % 3 == 0, F.lit("},{}]")).otherwise(F.lit('},{"label":"repeated output","tokens":1}]'))))
    return base.withColumn("avoided_tokens", avoided).select(
        "*",
        F.when(F.col("k") % 7 == 0, F.col("delivered_tokens")).otherwise(0).cast("long").alias("refetched_tokens"),
        F.when(F.col("k") % 4 == 0, F.lit("")).when(F.col("k") % 4 == 1, F.lit("claude-sonnet-4-5")).when(F.col("k") % 4 == 2, F.lit("gpt-5")).otherwise(F.lit("deepseek-chat")).alias("model"),
        F.when(F.col("k") % 6 == 0, F.lit(None)).when(F.col("k") % 2 == 0, F.lit("shell")).otherwise(F.lit("file-read")).alias("optimizer"),
        (F.col("tool_type") == "error").alias("referenced"),
        (F.col("k") % 11 == 0).alias("shadow"),
        reasons.alias("reasons"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce(F.col("c_nationkey"), F.lit(0)) % 4
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(n == 0, F.lit("cursor")).when(n == 1, F.lit("claude")).when(n == 2, F.lit("codex")).otherwise(F.lit("other")).alias("harness"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("gpt-5-mini")).alias("model"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One provider turn a row, with its token counts."""
    quantity = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber")).alias("ts"),
        F.col("l_orderkey").alias("turn_key"),
        F.col("l_suppkey").alias("session"),
        F.when(F.col("l_linestatus") == "O", F.lit("codex")).otherwise(F.lit("claude")).alias("harness"),
        F.when(F.col("l_returnflag") == "A", F.lit("claude-sonnet-4-5")).when(F.col("l_returnflag") == "N", F.lit("gpt-5")).otherwise(F.lit("deepseek-chat")).alias("model"),
        (quantity * 1000).alias("input_tokens"),
        (quantity * 37).alias("output_tokens"),
        (F.round(F.col("l_discount") * 100).cast("long") * 700).alias("cache_read_tokens"),
        (F.round(F.col("l_tax") * 100).cast("long") * 200).alias("cache_write_5m"),
        (F.col("l_linenumber").cast("long") * 50).alias("cache_write_1h"),
        (F.col("l_linenumber").cast("long") * 100).alias("reasoning_tokens"),
        (F.col("l_linenumber") == 7).alias("is_compaction"),
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") * 1.5).alias("quota_used_pct"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit("")).when(F.col("l_linenumber") % 3 == 1, F.lit("plus")).otherwise(F.lit("pro")).alias("plan_type"),
    )


#: The same projections as SQL, for oracles: prepend to a query over obs, sess or turns.
OBS_SQL = """obs0 AS (
  SELECT event_id AS id, user_id AS session_id, event_type AS tool_type, epoch_us(ts) // 1000000 AS created_at,
         CAST(coalesce(round(value * 100), 0) AS BIGINT) AS raw_tokens, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k
  FROM events
), obs1 AS (SELECT *, CAST(floor(raw_tokens * least(k, 100) / 100.0) AS BIGINT) AS delivered_tokens FROM obs0
), obs2 AS (SELECT *, greatest(raw_tokens - delivered_tokens, 0) AS avoided_tokens FROM obs1
), obs AS (
  SELECT *, CASE WHEN k % 7 = 0 THEN delivered_tokens ELSE 0 END AS refetched_tokens,
         CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'claude-sonnet-4-5' WHEN 2 THEN 'gpt-5' ELSE 'deepseek-chat' END AS model,
         CASE WHEN k % 6 = 0 THEN NULL WHEN k % 2 = 0 THEN 'shell' ELSE 'file-read' END AS optimizer,
         tool_type = 'error' AS referenced, k % 11 = 0 AS shadow,
         CASE WHEN k % 5 = 0 THEN '[]' ELSE '[{"label":"log noise","tokens":' || (avoided_tokens // 2) || CASE WHEN k % 3 = 0 THEN '},{}]' ELSE '},{"label":"repeated output","tokens":1}]' END END AS reasons
  FROM obs2
)"""
SESS_SQL = """sess AS (
  SELECT c_custkey AS id, CASE coalesce(c_nationkey, 0) % 4 WHEN 0 THEN 'cursor' WHEN 1 THEN 'claude' WHEN 2 THEN 'codex' ELSE 'other' END AS harness,
         CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'gpt-5-mini' END AS model FROM customer
)"""
TURNS_SQL = """turns AS (
  SELECT epoch_us(l_shipdate) // 1000000 + l_linenumber AS ts, l_orderkey AS turn_key, l_suppkey AS session,
         CASE WHEN l_linestatus = 'O' THEN 'codex' ELSE 'claude' END AS harness,
         CASE l_returnflag WHEN 'A' THEN 'claude-sonnet-4-5' WHEN 'N' THEN 'gpt-5' ELSE 'deepseek-chat' END AS model,
         CAST(l_quantity AS BIGINT) * 1000 AS input_tokens, CAST(l_quantity AS BIGINT) * 37 AS output_tokens,
         CAST(round(l_discount * 100) AS BIGINT) * 700 AS cache_read_tokens, CAST(round(l_tax * 100) AS BIGINT) * 200 AS cache_write_5m,
         CAST(l_linenumber AS BIGINT) * 50 AS cache_write_1h, CAST(l_linenumber AS BIGINT) * 100 AS reasoning_tokens, l_linenumber = 7 AS is_compaction,
         CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity * 1.5 END AS quota_used_pct, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'plus' ELSE 'pro' END AS plan_type
  FROM lineitem
)"""
