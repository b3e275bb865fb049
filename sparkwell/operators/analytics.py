"""Questions about observations, sessions and ledger turns. DataFrame in, DataFrame out; no driver loops.

Groups over hot keys combine on the map side; windows partition by session, the finest key that the question allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.functions.columns import bucket, canonical_model, input_price, layer, reduction_pct, round_usd, uncached_input
from sparkwell.functions.prices import catalog, priced

REASON = "array<struct<label:string,tokens:bigint>>"


def totals(obs: DataFrame, *by: str) -> DataFrame:
    """Raw, delivered, avoided and refetched tokens with the share saved and the saving net of refetches."""
    sums = [F.coalesce(F.sum(f"{c}_tokens"), F.lit(0)).alias(c) for c in ("raw", "delivered", "avoided", "refetched")]
    return obs.groupBy(*by).agg(F.count("*").alias("n"), *sums).withColumns({"reduction_pct": reduction_pct(F.col("avoided"), F.col("raw")), "net_avoided": F.greatest(F.col("avoided") - F.col("refetched"), F.lit(0))})


def between(df: DataFrame, column: str, since: int, until: int) -> DataFrame:
    return df.where(F.col(column).between(since, until))


def with_sessions(obs: DataFrame, sessions: DataFrame, how: str = "left") -> DataFrame:
    """Observations with their session's harness and model; dangling ones stay under a left join."""
    s = sessions.select(F.col("id").alias("session_id"), "harness", F.col("model").alias("session_model"))
    return obs.join(s, "session_id", how)


def models(joined: DataFrame) -> DataFrame:
    """Totals by resolved model, with the distinct sessions and harnesses."""
    model = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.nullif(F.col("session_model"), F.lit("")), F.lit("__unknown__"))
    return joined.groupBy(model.alias("model_id")).agg(
        F.count("*").alias("n"),
        F.sum("avoided_tokens").alias("avoided"),
        F.count_distinct("session_id").alias("sessions"),
        F.array_join(F.sort_array(F.collect_set("harness")), ",").alias("harnesses"),
    )


def series(obs: DataFrame, width: int, offset: int = 0) -> DataFrame:
    return obs.groupBy(bucket(F.col("created_at"), width, offset).alias("bucket")).agg(F.count("*").alias("n"), F.sum("avoided_tokens").alias("avoided"))


def dense_series(obs: DataFrame, since: int, until: int, width: int, offset: int = 0) -> DataFrame:
    """Every bucket of the range, empty ones with zeros. The grid is small: one row a bucket."""
    first, last = ((t + offset) // width * width - offset for t in (since, until))
    grid = obs.sparkSession.range(first, last + 1, width).withColumnRenamed("id", "bucket")
    sparse = series(between(obs, "created_at", since, until), width, offset)
    return grid.join(sparse, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "avoided")])


def reasons(obs: DataFrame) -> DataFrame:
    """Avoided tokens by reason: the JSON array exploded; an empty one counts its whole saving as unspecified."""
    parsed = F.coalesce(F.from_json("reasons", REASON), F.array().cast(REASON))
    rest = F.array(F.struct(F.lit("unspecified").alias("label"), F.col("avoided_tokens").alias("tokens"))).cast(REASON)
    either = F.when((F.size(parsed) == 0) & (F.col("avoided_tokens") > 0), rest).otherwise(parsed)
    rows = obs.select(F.explode(either).alias("r")).select(F.coalesce("r.label", F.lit("unspecified")).alias("label"), F.coalesce("r.tokens", F.lit(0)).alias("tokens"))
    return rows.groupBy("label").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))


def composition(obs: DataFrame) -> DataFrame:
    """Delivered tokens, the reasons above zero, and what the reasons leave of the saving."""
    by_reason = reasons(obs).where("tokens > 0").select("label", "tokens")
    delivered = obs.agg(F.lit("delivered").alias("label"), F.coalesce(F.sum("delivered_tokens"), F.lit(0)).alias("tokens"))
    signed = obs.agg(F.sum("avoided_tokens").alias("tokens")).unionByName(by_reason.select((-F.col("tokens")).alias("tokens")))
    residual = signed.agg(F.lit("residual").alias("label"), F.sum("tokens").alias("tokens")).where("tokens > 0")
    return delivered.unionByName(by_reason).unionByName(residual)


def optimizer_shares(obs: DataFrame) -> DataFrame:
    """Avoided tokens by optimizer and their whole percent of the total."""
    by = obs.groupBy(F.coalesce("optimizer", F.lit("none")).alias("optimizer")).agg(F.sum("avoided_tokens").alias("tokens"))
    return by.withColumn("pct", F.floor(F.col("tokens") * 100 / F.sum("tokens").over(Window.partitionBy())).cast("long"))


def clean_sessions(sessions: DataFrame, obs: DataFrame) -> DataFrame:
    """Sessions none of whose observations was referenced."""
    hit = obs.where("referenced").select(F.col("session_id").alias("id")).distinct()
    return sessions.join(hit, "id", "left_anti")


def latest(obs: DataFrame, key: str = "session_id") -> DataFrame:
    """The newest row of each key, by a combinable maximum instead of a sort."""
    return obs.groupBy(key).agg(F.max_by(F.struct("id", "tool_type", "raw_tokens", "created_at"), F.struct("created_at", "id")).alias("r")).select(key, "r.*")


def previous(obs: DataFrame) -> DataFrame:
    """Each call with the one before it in its session."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return obs.select("id", "session_id", F.lag("tool_type").over(w).alias("prev_tool"), (F.col("raw_tokens") - F.lag("raw_tokens").over(w)).alias("delta"))


def carried_model(obs: DataFrame) -> DataFrame:
    """The last model named so far in the session."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return obs.select("id", F.coalesce(F.last(F.nullif("model", F.lit("")), ignorenulls=True).over(w), F.lit("__unknown__")).alias("model"))


def first_wins(obs: DataFrame) -> DataFrame:
    """Insert-or-ignore: of the rows of one non-empty key the first to arrive; rows without key all stay."""
    key = F.when(F.col("model") == "", F.concat(F.lit("id:"), F.col("id").cast("string"))).otherwise(F.concat_ws("|", F.col("session_id").cast("string"), "model", "tool_type"))
    return obs.withColumn("dedup_key", key).groupBy("dedup_key").agg(F.min(F.struct("id", "raw_tokens")).alias("r")).select("r.id", "r.raw_tokens")


def layers(obs: DataFrame, now: int) -> DataFrame:
    rows = obs.select(layer(F.col("referenced"), F.lit(now) - F.col("created_at")).alias("layer"), "tool_type", "delivered_tokens")
    return rows.groupBy("layer", "tool_type").agg(F.count("*").alias("n"), F.sum("delivered_tokens").alias("delivered"))


def notable(obs: DataFrame, k: int = 8, least: int = 80) -> DataFrame:
    """The k largest calls; a bounded top-k, not a sort."""
    return obs.where(F.col("raw_tokens") >= least).orderBy(F.desc("raw_tokens"), F.desc("avoided_tokens"), "id").limit(k).select("id", "raw_tokens", "avoided_tokens")


def capped_feed(obs: DataFrame, each: int = 4, k: int = 12) -> DataFrame:
    """The k newest calls with at most ``each`` of one tool type."""
    w = Window.partitionBy("tool_type").orderBy(F.desc("created_at"), F.desc("id"))
    return obs.select("id", "tool_type", "created_at").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).orderBy(F.desc("created_at"), F.desc("id")).limit(k).drop("r")


def budget_fill(obs: DataFrame, budget: int) -> DataFrame:
    """The newest calls of each session whose running sum of delivered tokens stays within the budget."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return obs.select("id", "session_id", F.sum("delivered_tokens").over(w).alias("used")).where(F.col("used") <= budget)


def sliding_median(obs: DataFrame, rows: int = 128) -> DataFrame:
    """Median raw tokens of a session's last ``rows`` calls (lower median)."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(1 - rows, 0)
    seen = obs.select("id", F.sort_array(F.collect_list("raw_tokens").over(w)).alias("seen"))
    return seen.select("id", F.element_at("seen", F.expr("div(size(seen) + 1, 2)").cast("int")).alias("median_raw"))


def epochs(obs: DataFrame) -> DataFrame:
    """Runs of one model in a session: a new epoch at every change."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    new = F.when(F.lag("model").over(w).eqNullSafe(F.col("model")), 0).otherwise(1)
    marked = obs.select("session_id", "model", "created_at", "id", new.alias("new")).withColumn("epoch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("session_id", "epoch", "model").agg(F.min("created_at").alias("started_at"), F.count("*").alias("n"))


def journal(obs: DataFrame) -> DataFrame:
    """A session's calls as text, in order."""
    line = F.struct("created_at", "id", F.concat_ws(":", "tool_type", F.col("raw_tokens").cast("string")).alias("body"))
    return obs.groupBy("session_id").agg(F.sort_array(F.collect_list(line)).alias("s")).select("session_id", F.array_join(F.transform("s", lambda x: x["body"]), "\n").alias("body"))


def ledger(turns: DataFrame, *by: str) -> DataFrame:
    """Token sums, compactions and the token-weighted cache hit rate (null without turns, 0 without input)."""
    written = F.col("cache_write_5m") + F.col("cache_write_1h")
    rows = turns.withColumn("fresh", uncached_input(F.col("harness"), F.col("input_tokens"), F.col("cache_read_tokens"), written)).withColumn("written", written)
    out = rows.groupBy(*by).agg(
        F.count("*").alias("turns"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("fresh", "fresh"), ("output_tokens", "output"), ("cache_read_tokens", "read"), ("written", "written"), ("reasoning_tokens", "reasoning"))],
        F.coalesce(F.sum(F.col("is_compaction").cast("long")), F.lit(0)).alias("compactions"),
        F.coalesce(F.sum(F.when(F.col("cache_read_tokens") == 0, 1).otherwise(0)), F.lit(0)).alias("misses"),
    )
    base = F.col("fresh") + F.col("read") + F.col("written")
    return out.withColumn("hit_rate", F.when(F.col("turns") == 0, None).when(base <= 0, 0.0).otherwise(F.round(F.col("read") / base * 1e6) / 1e6))


def ledger_by_domain(turns: DataFrame, domain: list[str]) -> DataFrame:
    """One row for each of a fixed list of harnesses, empty ones too."""
    names = turns.sparkSession.createDataFrame([(d,) for d in domain], "harness string")
    return names.join(ledger(turns, "harness"), "harness", "left").select("harness", F.coalesce("turns", F.lit(0)).alias("turns"), "hit_rate")


def costs(turns: DataFrame, *by: str) -> DataFrame:
    """US dollars by group: each turn rounded to a millionth; null if no turn has a price."""
    fresh = uncached_input(F.col("harness"), F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_5m") + F.col("cache_write_1h"))
    return priced(turns, catalog(turns.sparkSession), fresh).groupBy(*by).agg(F.count("*").alias("turns"), (F.sum(F.round(F.col("usd") * 1e6).cast("long")) / 1e6).alias("usd"))


def avoided_usd(obs: DataFrame) -> DataFrame:
    by = obs.groupBy(canonical_model(F.col("model")).alias("model_id")).agg(F.sum("avoided_tokens").alias("avoided"))
    return by.withColumn("usd", round_usd(F.col("avoided") / 1e6 * input_price(F.col("model_id"))))


def inferred_cache(turns: DataFrame) -> DataFrame:
    """Where a provider reports only context sizes: what of each was read from the cache, by the size before it."""
    w = Window.partitionBy("session").orderBy("ts", "turn_key", "input_tokens")
    rows = turns.select("ts", "turn_key", "session", "input_tokens", F.lag("input_tokens").over(w).alias("prev"))
    cold = F.col("prev").isNull() | (F.col("input_tokens") * 100 < F.col("prev") * 85)
    return rows.select("ts", "turn_key", "session", "input_tokens", F.when(cold, 0).otherwise(F.least("prev", "input_tokens")).cast("long").alias("read"), F.when(cold, F.col("input_tokens")).otherwise(F.greatest(F.col("input_tokens") - F.col("prev"), F.lit(0))).alias("written"))


def union_models(obs: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows of both fact tables merged by canonical model."""
    a = obs.where("model <> ''").groupBy(canonical_model(F.col("model")).alias("model_id")).agg(F.count("*").alias("calls")).withColumn("turns", F.lit(0).cast("long"))
    b = turns.groupBy(canonical_model(F.col("model")).alias("model_id")).agg(F.count("*").alias("turns")).withColumn("calls", F.lit(0).cast("long"))
    return a.unionByName(b).groupBy("model_id").agg(F.sum("calls").alias("calls"), F.sum("turns").alias("turns"))


def enclosing(hits: DataFrame, frames: DataFrame, cell: int = 64) -> DataFrame:
    """Stabbing join: the tightest frame (doc_id, first, last) around each hit (doc_id, line); none: null.

    Frames are cut into cells of lines, so the join is on (document, cell) and not a nested loop.
    """
    cells = frames.select("doc_id", "name", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / cell), F.floor(F.col("last") / cell))).alias("cell"))
    found = hits.withColumn("cell", F.floor(F.col("line") / cell)).join(cells, ["doc_id", "cell"]).where(F.col("line").between(F.col("first"), F.col("last")))
    best = found.groupBy("doc_id", "line").agg(F.min_by("name", F.struct(F.col("last") - F.col("first"), F.col("first"), F.col("name"))).alias("name"))
    return hits.join(best, ["doc_id", "line"], "left")
