"""Ledger sources: JSON lines of two harnesses, key-value exports of a third, price lists. DataFrames of lines or pairs in, rows out.

A file's lines come as (file, pos, value); malformed lines are skipped. Price lists are small files, parsed with the same functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.functions.columns import seconds_of

USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint,cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>,output_tokens_details:struct<thinking_tokens:bigint>,service_tier:string>"
MESSAGE_LINE = f"timestamp string, type string, message struct<model:string,usage:{USAGE}>"
COUNT_LINE = "timestamp string, type string, model string, payload struct<type:string,model:string,info:struct<last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,cache_write_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>,model_context_window:bigint>,rate_limits:struct<primary:struct<used_percent:double,resets_at:string>,plan_type:string>>"
COMPOSER, BUBBLE = "composerData:", "bubbleId:"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, pos, value) of all JSON-lines files of a folder; pos orders the lines of a file.

    A file is read whole by one task only where it is not split; ids that grow along the file keep the order across splits.
    """
    lines = spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") * F.lit(1 << 20)).alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    return lines.select("file", F.struct("start", "id").alias("pos"), "value")


def _count(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def message_turns(lines: DataFrame) -> DataFrame:
    """Turns of lines that carry a message with its usage; cache writes without a split count as 5-minute writes."""
    rows = lines.select("file", "pos", F.from_json("value", MESSAGE_LINE).alias("v")).where("v.message.usage is not null")
    u, made = F.col("v.message.usage"), F.col("v.message.usage.cache_creation")
    return rows.select(
        "file",
        "pos",
        seconds_of(F.col("v.timestamp")).alias("ts"),
        F.coalesce("v.message.model", F.lit("")).alias("model"),
        _count(u["input_tokens"]).alias("input_tokens"),
        _count(u["output_tokens"]).alias("output_tokens"),
        _count(u["cache_read_input_tokens"]).alias("cache_read_tokens"),
        F.when(made.isNotNull(), _count(made["ephemeral_5m_input_tokens"])).otherwise(_count(u["cache_creation_input_tokens"])).alias("cache_write_5m"),
        _count(made["ephemeral_1h_input_tokens"]).alias("cache_write_1h"),
        _count(u["output_tokens_details"]["thinking_tokens"]).alias("reasoning_tokens"),
        F.coalesce(u["service_tier"], F.lit("")).alias("plan_type"),
    )


def counted_turns(lines: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Turns of token-count lines; each takes the last model that a line of its file named, or the file's seed (file, seed)."""
    rows = lines.select("file", "pos", F.from_json("value", COUNT_LINE).alias("v"))
    named = F.coalesce(F.nullif("v.payload.model", F.lit("")), F.nullif("v.model", F.lit("")))
    along = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("model", F.last(named, ignorenulls=True).over(along)).where("v.payload.type = 'token_count' and v.payload.info.last_token_usage is not null")
    rows = rows.withColumn("seed", F.lit("")) if seeds is None else rows.join(seeds, "file", "left")
    u, limits = F.col("v.payload.info.last_token_usage"), F.col("v.payload.rate_limits")
    return rows.select(
        "file",
        "pos",
        seconds_of(F.col("v.timestamp")).alias("ts"),
        F.coalesce("model", "seed", F.lit("")).alias("model"),
        _count(u["input_tokens"]).alias("input_tokens"),
        _count(u["output_tokens"]).alias("output_tokens"),
        _count(u["cached_input_tokens"]).alias("cache_read_tokens"),
        _count(u["cache_write_input_tokens"]).alias("cache_write_5m"),
        _count(u["reasoning_output_tokens"]).alias("reasoning_tokens"),
        F.col("v.payload.info.model_context_window").alias("context_window"),
        limits["primary"]["used_percent"].alias("quota_used_pct"),
        F.coalesce(limits["plan_type"], F.lit("")).alias("plan_type"),
        F.coalesce(limits["primary"]["resets_at"], F.lit("")).alias("resets_at"),
    )


def composers(pairs: DataFrame) -> DataFrame:
    """(session, ts, context_tokens, context_window, model) of the composer entries of a key-value export (key, value)."""
    at = lambda path: F.get_json_object("value", path)
    rows = pairs.where(F.col("key").startswith(COMPOSER) & (_count(at("$.contextTokensUsed").try_cast("long")) > 0))
    return rows.select(
        F.substr("key", F.lit(len(COMPOSER) + 1)).alias("session"),
        seconds_of(F.coalesce(at("$.lastUpdatedAt"), at("$.createdAt"))).alias("ts"),
        at("$.contextTokensUsed").try_cast("long").alias("context_tokens"),
        at("$.contextTokenLimit").try_cast("long").alias("context_window"),
        F.coalesce(at("$.modelConfig.modelName"), F.lit("")).alias("model"),
    )


def bubbles(pairs: DataFrame) -> DataFrame:
    """(session, bubble, input_tokens, output_tokens) of the bubble entries with tokens."""
    at = lambda path: _count(F.get_json_object("value", path).try_cast("long"))
    rows = pairs.where(F.col("key").startswith(BUBBLE) & (at("$.tokenCount.inputTokens") + at("$.tokenCount.outputTokens") > 0))
    name = F.split("key", ":")
    return rows.select(F.get(name, F.lit(1)).alias("session"), F.get(name, F.lit(2)).alias("bubble"), at("$.tokenCount.inputTokens").alias("input_tokens"), at("$.tokenCount.outputTokens").alias("output_tokens"))


def changed(entries: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries (session, ts, context_tokens, ...) that are newer than what was seen of their session, or of another size."""
    before = seen.select("session", F.col("ts").alias("seen_ts"), F.col("context_tokens").alias("seen_tokens"))
    rows = entries.join(before, "session", "left")
    return rows.where(F.col("seen_ts").isNull() | (F.col("ts") > F.col("seen_ts")) | (F.col("context_tokens") != F.col("seen_tokens"))).drop("seen_ts", "seen_tokens")


def markdown_prices(lines: DataFrame) -> DataFrame:
    """(model_id, usd): the rows of Markdown tables ``| name | $input | ...``; names become ids in lower case with dashes."""
    cells = F.transform(F.split(F.regexp_replace("value", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.where(F.col("value").rlike(r"^\s*\|.*\|")).select(cells.alias("c"))
    usd = F.regexp_extract(F.get("c", F.lit(1)), r"^\$?([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    ids = F.regexp_replace(F.regexp_replace(F.lower(F.get("c", F.lit(0))), r"[*`]|\(.*\)", ""), r"[^a-z0-9.]+", "-")
    return rows.select(F.trim(ids, F.lit("-")).alias("model_id"), usd.alias("usd")).where("usd is not null and model_id <> ''")


def catalog_prices(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """(model_id, usd) of JSON catalogues {provider: {models: {id: {cost: {input}}}}} (column ``value``), for ids of ``listed`` (model_id)."""
    kind = "map<string, struct<models:map<string, struct<cost:struct<input:double>>>>>"
    providers = documents.select(F.explode(F.from_json("value", kind)).alias("provider", "p")).select(F.explode("p.models").alias("id", "m"))
    prices = providers.select(F.lower("id").alias("model_id"), F.col("m.cost.input").alias("usd")).where("usd is not null")
    return prices.join(listed.select("model_id").distinct(), "model_id", "left_semi").groupBy("model_id").agg(F.min("usd").alias("usd"))
