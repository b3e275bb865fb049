"""Scans, filters, write semantics, ledger blocks and top-k lists of the dashboard, as DataFrame functions.

Writes are folds: the table after a series of upserts is an aggregation of the rows that arrived, by key.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.functions.columns import round_usd, uncached_input

UNKNOWN = "__unknown__"
#: Harnesses that a filter's name also stands for.
HARNESS_ALIASES = {"cursor": ["cursor", "cursor-cli"], "claude": ["claude", "claude-code"]}
#: Model names that say nothing about the model.
WEAK_MODELS = ["default", "auto"]


# Filters


def harness_filter(harnesses: list[str] | None, column: Column) -> Column:
    """True without a filter; names stand for their aliases."""
    if not harnesses:
        return F.lit(True)
    return F.coalesce(column, F.lit("")).isin(sorted({a for h in harnesses for a in HARNESS_ALIASES.get(h, [h])}))


def model_filter(models: list[str] | None, model: Column, listed_session: Column | None = None) -> Column:
    """True without a filter; ``UNKNOWN`` stands for the blank model.

    ``listed_session`` is true for rows whose session the ledger gives to a selected model: their blank models count too.
    """
    if not models:
        return F.lit(True)
    named = [m for m in models if m != UNKNOWN]
    out = model.isin(named) if named else F.lit(False)
    if UNKNOWN in models:
        out |= model == ""
    return out if listed_session is None else out | (listed_session & (model == ""))


def resolved_model(own: str = "model", session: str = "session_model") -> Column:
    return F.coalesce(F.nullif(F.col(own), F.lit("")), F.nullif(F.col(session), F.lit("")), F.lit(""))


def attributed(joined: DataFrame, turns: DataFrame, model: str) -> DataFrame:
    """Rows of a model, and rows without model of the sessions that the ledger lists for it."""
    listed = turns.where(F.col("model") == model).select(F.col("session").alias("session_id")).distinct().withColumn("listed", F.lit(True))
    marked = joined.join(listed, "session_id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return marked.where(model_filter([model], resolved_model(), F.col("listed"))).drop("listed")


def listed_model(model: Column) -> Column:
    """Neither blank nor unknown nor synthetic nor in angle brackets."""
    bare = F.trim(model)
    return ~F.lower(bare).isin("", UNKNOWN, "unknown", "synthetic", "<synthetic>") & ~(bare.startswith("<") & bare.endswith(">"))


def contains_text(column: Column, query: str) -> Column:
    """LIKE with the query's wildcards escaped, in either case."""
    return F.lower(column).contains(query.lower())


def like_text(column: Column, query: str) -> Column:
    """LIKE in which the query's % and _ stay wildcards."""
    return F.lower(column).like(f"%{query.lower()}%")


def prefix_text(column: Column, query: str) -> Column:
    """LIKE of a beginning: the query's own wildcards count as they stand, its case too. Reaches the scan as a filter."""
    return column.startswith(query)


# Scans and look-ups


def scan(df: DataFrame, order: list[str], *conditions: Column) -> DataFrame:
    """An ordered scan; the conditions reach the Parquet reader."""
    return df.where(reduce(and_, conditions, F.lit(True))).orderBy(*order)


def resolve_hashes(wanted: DataFrame, hashes: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """(prefix, hash): the one hash that starts with each prefix of ``least`` to ``most`` digits; null if none or several do."""
    prefixes = hashes.select("hash").distinct().select("hash", F.explode(F.array(*[F.substring("hash", 1, n) for n in range(least, most + 1)])).alias("prefix"))
    only = prefixes.groupBy("prefix").agg(F.count("*").alias("n"), F.min("hash").alias("hash")).where("n = 1").drop("n")
    return wanted.select("prefix").distinct().join(only, "prefix", "left")


def layered(*layers: DataFrame) -> DataFrame:
    """(model_id, usd, layer): of the prices of a model that of the last layer that has one."""
    numbered = [d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)]
    return reduce(DataFrame.unionByName, numbered).where("usd is not null").groupBy("model_id").agg(F.max_by("usd", "layer").alias("usd"), F.max("layer").alias("layer"))


# Writes


def upserted_models(events: DataFrame, key: str = "session_id") -> DataFrame:
    """Each key's model after all upserts: blank ones change nothing, and a weak name never replaces a real one."""
    order = F.struct("created_at", "id")
    real = (F.col("model") != "") & ~F.lower("model").isin(WEAK_MODELS)
    last = lambda ok: F.max_by(F.when(ok, F.col("model")), F.when(ok, order))
    return events.groupBy(key).agg(F.coalesce(last(real), last(F.lower("model").isin(WEAK_MODELS)), F.lit("")).alias("model"))


def last_wins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: the newest row of each key, with the time at which the key first came."""
    newest = F.max_by(F.struct("id", "raw_tokens", F.col("created_at").alias("updated_at")), F.struct("created_at", "id"))
    return rows.groupBy(*keys).agg(F.min("created_at").alias("created_at"), newest.alias("r")).select(*keys, "created_at", "r.*")


def replaced(rows: DataFrame, key: str, load: Column, cap: int = 48) -> DataFrame:
    """Delete then insert: of each key the rows of its last load, at most ``cap`` of them."""
    loads = rows.withColumn("load", load)
    last = loads.groupBy(key).agg(F.max("load").alias("load"))
    w = Window.partitionBy(key).orderBy("id")
    return loads.join(last, [key, "load"]).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap).select("id", key, "load", F.col("pos").cast("long").alias("pos"))


def refetches_applied(obs: DataFrame, refetches: DataFrame) -> DataFrame:
    """(id, refetched): what was refetched of a session is added to its latest row."""
    latest = obs.groupBy("session_id").agg(F.max(F.struct("created_at", "id")).alias("l")).select("session_id", F.col("l.id").alias("id"))
    added = latest.join(refetches.groupBy("session_id").agg(F.sum("tokens").alias("more")), "session_id").select("id", "more")
    return obs.join(added, "id", "left").select("id", (F.col("refetched_tokens") + F.coalesce("more", F.lit(0))).alias("refetched"))


def appended(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(id, seq) of the new rows: numbers go on from what each key holds."""
    base = held.groupBy(*keys).agg(F.max("seq").alias("base"))
    w = Window.partitionBy(*keys).orderBy("created_at", "id")
    numbered = new.withColumn("n", F.row_number().over(w)).join(base, keys, "left")
    return numbered.select("id", (F.coalesce("base", F.lit(0)) + F.col("n")).cast("long").alias("seq"))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("created_at", "id")))


def metric_lines(totals: DataFrame, label: str, metrics: list[str], prefix: str = "sparkwell") -> DataFrame:
    """Text exposition: one ``name{label="value"} number`` line a metric and row."""
    name = F.regexp_replace(F.col(label), r'[\\"\n]', "_")
    lines = F.array(*[F.concat(F.lit(f'{prefix}_{m}_total{{{label}="'), name, F.lit('"} '), F.col(m).cast("string")) for m in metrics])
    return totals.select(F.explode(lines).alias("line"))


def json_report(totals: DataFrame, *columns: str) -> DataFrame:
    return totals.select(F.to_json(F.struct(*columns)).alias("report"))


# Joins and sets


def backfilled(obs: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, model): blank models take their session's."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("model").alias("session_model"))
    return obs.join(s, "session_id", "left").select("id", resolved_model().alias("model"))


def name_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, state) of two versions' (name, body): added, gone, changed or same."""
    both = old.withColumnRenamed("body", "before").join(new.withColumnRenamed("body", "after"), "name", "full")
    state = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "gone").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return both.select("name", state.alias("state"))


def suffix_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): paths of which one equals the other or its last segments; an equi-join on exploded suffixes."""

    def suffixes(df: DataFrame, c: str) -> DataFrame:
        parts = F.split(F.col(c), "/")
        return df.select(F.col(c)).distinct().select(c, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("suffix"))

    one = suffixes(left, "a").join(right.select("b").distinct(), F.col("suffix") == F.col("b")).select("a", "b")
    other = suffixes(right, "b").join(left.select("a").distinct(), F.col("suffix") == F.col("a")).select("a", "b")
    return one.union(other).distinct()


def previous_version(obs: DataFrame) -> DataFrame:
    """(id, prev_id): the session's row before of the same tool."""
    return obs.select("id", F.lag("id").over(Window.partitionBy("session_id", "tool_type").orderBy("id")).alias("prev_id"))


def ranked_union(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """(uri, source): hits of the first search, then those of the second that it lacks, ``k`` in all."""
    rest = second.join(first.select("uri"), "uri", "left_anti")
    both = first.select("uri", F.lit(0).alias("source")).unionByName(rest.select("uri", F.lit(1).alias("source")))
    return both.orderBy("source", "uri").limit(k)


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, added, removed): distinct lines that a version of a text (doc_id, text) gains and loses."""
    own = lambda df, n: df.select("doc_id", F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias(n))
    both = own(old, "a").join(own(new, "b"), "doc_id")
    return both.select("doc_id", F.size(F.array_except("b", "a")).cast("long").alias("added"), F.size(F.array_except("a", "b")).cast("long").alias("removed"))


# Ledger


def latest_plans(turns: DataFrame, by: str = "harness") -> DataFrame:
    """The last plan that is not blank."""
    return turns.where("plan_type <> ''").groupBy(by).agg(F.max_by("plan_type", F.struct("ts", "turn_key", "plan_type")).alias("plan_type"))


def rollup(turns: DataFrame, by: str = "harness") -> DataFrame:
    """Counts, sums, the highest quota (nulls skipped) and the last plan that is not blank."""
    named = F.col("plan_type") != ""
    sums = {"input": F.col("input_tokens"), "output": F.col("output_tokens"), "read": F.col("cache_read_tokens"), "written": F.col("cache_write_5m") + F.col("cache_write_1h"), "reasoning": F.col("reasoning_tokens"), "compactions": F.col("is_compaction").cast("long")}
    plan = F.max_by(F.when(named, F.col("plan_type")), F.when(named, F.struct("ts", "turn_key", "plan_type")))
    return turns.groupBy(by).agg(F.count("*").alias("turns"), *[F.sum(c).alias(n) for n, c in sums.items()], F.max("quota_used_pct").alias("quota"), plan.alias("plan_type"))


def naive_hit_rate(turns: DataFrame, by: str = "harness") -> DataFrame:
    """Reads over input, reads and writes, whatever the provider counts as input."""
    out = turns.groupBy(by).agg(F.sum("input_tokens").alias("i"), F.sum("cache_read_tokens").alias("r"), F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("w"))
    base = F.col("i") + F.col("r") + F.col("w")
    return out.select(by, F.when(base <= 0, 0.0).otherwise(F.round(F.col("r") / base * 1e6) / 1e6).alias("hit_rate"))


def domain_costs(priced: DataFrame, domain: list[str]) -> DataFrame:
    """One row for each harness of a fixed list: turns, dollars (null without priced turns) and kind (``empty`` without turns). ``priced``: (harness, usd)."""
    by = priced.groupBy("harness").agg(F.count("*").alias("turns"), (F.sum(F.round(F.col("usd") * 1e6).cast("long")) / 1e6).alias("usd"))
    names = priced.sparkSession.createDataFrame([(d,) for d in domain], "harness string")
    kind = F.when(F.col("turns").isNull(), "empty").when(F.col("usd").isNull(), "unpriced").otherwise("priced")
    return names.join(by, "harness", "left").select("harness", F.coalesce("turns", F.lit(0)).alias("turns"), "usd", kind.alias("kind"))


def last_two(turns: DataFrame) -> DataFrame:
    """Each session's last turn with the cache reads of the one before: a bounded top-2 by session."""
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("turn_key"), F.desc("reasoning_tokens"))
    two = turns.withColumn("r", F.row_number().over(w)).where("r <= 2")
    last = F.max_by(F.struct("ts", "harness", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_5m", "cache_write_1h", "reasoning_tokens"), -F.col("r"))
    return two.groupBy("session").agg(last.alias("last"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("cache_read_tokens"))), F.max(F.when(F.col("r") == 1, F.col("cache_read_tokens")))).alias("prev_read"))


def advice(turns: DataFrame, remaining: int, now: int, usd_of, rebuilt_usd_of) -> DataFrame:
    """(session, keep, reason, keep_cost, rotate_cost): keep a session's cached prefix, or start anew.

    ``usd_of`` and ``rebuilt_usd_of`` turn a struct column of the last turn into its cost, and into its cost with a cold cache.
    """
    compacted = turns.groupBy("session").agg(F.max(F.col("is_compaction").cast("int")).alias("compacted"))
    rows = last_two(turns).join(compacted, "session").withColumns({"per_turn": F.coalesce(usd_of(F.col("last")), F.lit(0.0))})
    rows = rows.withColumn("rebuild", F.coalesce(rebuilt_usd_of(F.col("last")), F.col("per_turn") * 2))
    rows = rows.withColumns({"keep_cost": round_usd(F.col("per_turn") * remaining), "rotate_cost": round_usd(F.col("rebuild") + F.col("per_turn") * 0.4 * max(remaining - 1, 0))})
    read = F.col("last.cache_read_tokens")
    window = F.when(F.col("last.cache_write_1h") > 0, 3300).otherwise(270)
    idle = (F.col("last.ts") > 0) & (F.lit(now) - F.col("last.ts") > window) & (read > 0)
    reason = (
        F.when((read == 0) & (F.col("prev_read") > 0), "cache-miss-window")
        .when(idle, "ttl-idle")
        .when(F.col("compacted") == 1, "already-compacted")
        .when(F.lit(remaining == 0), "session-ending")
        .when(F.col("keep_cost") <= F.col("rotate_cost"), "keep-hot-prefix")
        .otherwise("cheaper-new-epoch")
    )
    return rows.withColumn("reason", reason).select("session", F.col("reason").isin("session-ending", "keep-hot-prefix").alias("keep"), "reason", "keep_cost", "rotate_cost")


def cold_turn(turn: Column) -> dict[str, Column]:
    """The last turn's fields as if nothing had been cached."""
    fields = {f: turn[f] for f in ("harness", "model", "input_tokens", "output_tokens", "cache_write_1h", "reasoning_tokens")}
    return fields | {"cache_read_tokens": F.lit(0), "cache_write_5m": F.greatest(turn["input_tokens"], turn["cache_read_tokens"])}


def epochs(rows: DataFrame, key: str, order: list[str], marks: list[str]) -> DataFrame:
    """(key, epoch, started_at, n): a new epoch at every change of any of ``marks``."""
    w = Window.partitionBy(key).orderBy(*order)
    same = reduce(and_, [F.lag(m).over(w).eqNullSafe(F.col(m)) for m in marks])
    new = F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.select(key, *order, new.alias("new")).withColumn("epoch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "epoch").agg(F.min(order[0]).alias("started_at"), F.count("*").alias("n"))


def tuned(obs: DataFrame, keys: list[str], every: int = 50) -> DataFrame:
    """(keys, intercepts, tune): after every ``every`` rows the factor goes up or down with the share that was refetched."""
    w = Window.partitionBy(*keys).orderBy("created_at", "id")
    seen = obs.select(*keys, "created_at", "id", F.row_number().over(w).alias("n"), F.sum("refetched_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("refetched"))
    steps = F.sort_array(F.collect_list(F.when(F.col("n") % every == 0, F.struct("n", (F.col("refetched") / F.col("n")).alias("rate")))))
    move = lambda t, s: F.when(s["rate"] > 0.20, F.least(t + 0.05, F.lit(1.4))).when(s["rate"] < 0.05, F.greatest(t - 0.05, F.lit(0.75))).otherwise(t)
    return seen.groupBy(*keys).agg(F.max("n").cast("long").alias("intercepts"), steps.alias("steps")).select(*keys, "intercepts", F.round(F.aggregate("steps", F.lit(1.0), move), 6).alias("tune"))


# Lists


def newest_distinct(obs: DataFrame, keys: list[str], k: int = 12) -> DataFrame:
    """The ``k`` newest distinct values; the maximum of each combines before the shuffle."""
    return obs.groupBy(*keys).agg(F.max(F.struct("created_at", "id")).alias("o")).orderBy(F.desc("o")).limit(k).select(*keys, F.col("o.id").alias("id"))


def hits_by_file(hits: DataFrame, files: int = 8, each: int = 4) -> DataFrame:
    """(file, pos): the first hits of the files that come first."""
    first = hits.groupBy("file").agg(F.min("pos").alias("first")).orderBy("first", "file").limit(files)
    w = Window.partitionBy("file").orderBy("pos")
    return hits.join(first.select("file"), "file").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each).select("file", "pos")


def sliding_quantiles(obs: DataFrame, rows: int = 128) -> DataFrame:
    """Nearest-rank p50, p90 and p99 of a session's last ``rows`` values, up to each row."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id").rowsBetween(1 - rows, 0)
    seen = obs.select("id", F.sort_array(F.collect_list("raw_tokens").over(w)).alias("seen"))
    at = lambda q: F.element_at("seen", (F.floor((F.size("seen") - 1) * F.lit(q) + 0.5) + 1).cast("int"))
    return seen.select("id", *[at(q).alias(n) for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])


def best_named(frames: DataFrame, name: str) -> DataFrame:
    """Of each text the frame of a name: exact before substring matches (either case), then the longest, then the last."""
    exact = F.lower("name") == name.lower()
    rank = F.struct(exact.cast("int"), (F.col("last") - F.col("first")), F.col("first"), F.col("name"))
    return frames.where(exact | contains_text(F.col("name"), name)).groupBy("doc_id").agg(F.max_by("name", rank).alias("name"), F.max_by("first", rank).alias("first"))


def fresh_input(turns: DataFrame) -> Column:
    return uncached_input(F.col("harness"), F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_5m") + F.col("cache_write_1h"))
