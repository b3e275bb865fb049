"""Dashboard, ledger and write-fold queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions import columns as C
from sparkwell.functions import prices
from sparkwell.operators import analytics, dashboard
from sparkwell.plans.queries import NOW, SINCE, UNTIL, query
from sparkwell.sources.model import observations, sessions, table, turns

FROM, TO = 820454400, 823132800
JOINED = "j AS (SELECT obs.*, harness, coalesce(nullif(obs.model, ''), nullif(sess.model, ''), '') AS m FROM obs LEFT JOIN sess ON session_id = sess.id)"
SUMS = "count(*) AS n, CAST(coalesce(sum(raw_tokens), 0) AS BIGINT) AS raw, CAST(coalesce(sum(avoided_tokens), 0) AS BIGINT) AS avoided"


def sums(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum("raw_tokens"), F.lit(0)).alias("raw"), F.coalesce(F.sum("avoided_tokens"), F.lit(0)).alias("avoided"))


def joined(spark, d):
    return analytics.with_sessions(observations(spark, d), sessions(spark, d))


@query(f"SELECT id, created_at, raw_tokens FROM obs WHERE created_at >= {SINCE} ORDER BY created_at, id", "obs")
def obs_since(spark, d):
    return dashboard.scan(observations(spark, d), ["created_at", "id"], F.col("created_at") >= SINCE).select("id", "created_at", "raw_tokens")


@query("SELECT id, session_id, raw_tokens FROM obs WHERE session_id = (SELECT min(session_id) FROM obs)", "obs")
def obs_of_session(spark, d):
    obs = observations(spark, d)
    first = obs.agg(F.min("session_id").alias("session_id"))
    return obs.join(F.broadcast(first), "session_id", "left_semi").select("id", "session_id", "raw_tokens")  # one row


@query(f"SELECT ts, turn_key, model FROM turns WHERE ts BETWEEN {FROM} AND {TO} ORDER BY ts", "turns")
def ledger_range(spark, d):
    return dashboard.scan(turns(spark, d), ["ts"], F.col("ts").between(FROM, TO)).select("ts", "turn_key", "model")


@query("SELECT s.session_id, coalesce(harness, '') AS harness, coalesce(model, '') AS model FROM (SELECT DISTINCT session_id FROM obs) s LEFT JOIN sess ON s.session_id = sess.id", "obs sess")
def session_lookup(spark, d):
    wanted = observations(spark, d).select("session_id").distinct()
    found = wanted.join(sessions(spark, d).withColumnRenamed("id", "session_id"), "session_id", "left")
    return found.select("session_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("harness", "model")])


@query("""WITH h AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL),
  w AS (SELECT DISTINCT substr(sha256(text), 1, 2 + doc_id % 8) AS prefix FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0)
  SELECT prefix, CASE WHEN count(*) = 1 THEN min(hash) END AS hash FROM w LEFT JOIN h ON starts_with(hash, prefix) GROUP BY prefix""")
def resolved_uris(spark, d):
    hashes = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))
    wanted = hashes.where("doc_id % 5 = 0").select(F.expr("substring(hash, 1, cast(2 + doc_id % 8 as int))").alias("prefix"))
    return dashboard.resolve_hashes(wanted, hashes)


# Writes

EVENTS = "ev AS (SELECT id, session_id, created_at, raw_tokens, tool_type, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'default' WHEN 2 THEN 'gpt-5' WHEN 3 THEN 'auto' ELSE 'grok-4.5' END AS model FROM obs WHERE k % 3 <> 0)"


def events(spark, d):
    names = F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 5 == 1, "default").when(F.col("k") % 5 == 2, "gpt-5").when(F.col("k") % 5 == 3, "auto").otherwise("grok-4.5")
    return observations(spark, d).where("k % 3 <> 0").withColumn("model", names)


@query(f""", {EVENTS} SELECT session_id, coalesce(arg_max(model, (created_at, id)) FILTER (model NOT IN ('', 'default', 'auto')),
  arg_max(model, (created_at, id)) FILTER (model IN ('default', 'auto')), '') AS model FROM ev GROUP BY 1""", "obs")
def session_models_upserted(spark, d):
    return dashboard.upserted_models(events(spark, d))


@query("""SELECT session_id, tool_type, min(created_at) OVER w AS created_at, id, raw_tokens, created_at AS updated_at FROM obs
  WINDOW w AS (PARTITION BY session_id, tool_type) QUALIFY row_number() OVER (PARTITION BY session_id, tool_type ORDER BY created_at DESC, id DESC) = 1""", "obs")
def last_wins_upsert(spark, d):
    return dashboard.last_wins(observations(spark, d), ["session_id", "tool_type"])


@query("""SELECT id, session_id, created_at // 86400 AS load, row_number() OVER (PARTITION BY session_id ORDER BY id) AS pos FROM obs
  WHERE (session_id, created_at // 86400) IN (SELECT (session_id, max(created_at // 86400)) FROM obs GROUP BY session_id) QUALIFY pos <= 48""", "obs")
def replaced_rows(spark, d):
    return dashboard.replaced(observations(spark, d), "session_id", F.floor(F.col("created_at") / 86400))


@query(""", r AS (SELECT session_id, CAST(sum(raw_tokens) AS BIGINT) AS more FROM obs WHERE tool_type = 'error' GROUP BY 1),
  l AS (SELECT session_id, id FROM obs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) = 1)
  SELECT obs.id, refetched_tokens + coalesce(more, 0) AS refetched FROM obs LEFT JOIN l ON obs.id = l.id LEFT JOIN r ON l.session_id = r.session_id""", "obs")
def refetches_added(spark, d):
    obs = observations(spark, d)
    return dashboard.refetches_applied(obs, obs.where("tool_type = 'error'").select("session_id", F.col("raw_tokens").alias("tokens")))


@query(f"""SELECT id, seq FROM (SELECT id, created_at, row_number() OVER (PARTITION BY session_id, tool_type ORDER BY created_at >= {UNTIL}, created_at, id) AS seq FROM obs) WHERE created_at >= {UNTIL}""", "obs")
def sequence_append(spark, d):
    obs, keys = observations(spark, d), ["session_id", "tool_type"]
    return dashboard.appended(dashboard.numbered(obs.where(F.col("created_at") < UNTIL), keys), obs.where(F.col("created_at") >= UNTIL), keys)


@query("""SELECT 'sparkwell_' || m || '_total{tool_type="' || tool_type || '"} ' || v AS line FROM (
  SELECT tool_type, unnest(['raw', 'avoided']) AS m, unnest([CAST(sum(raw_tokens) AS BIGINT), CAST(sum(avoided_tokens) AS BIGINT)]) AS v FROM obs GROUP BY 1)""", "obs")
def metric_lines(spark, d):
    return dashboard.metric_lines(sums(observations(spark, d), "tool_type"), "tool_type", ["raw", "avoided"])


@query("""SELECT '{"tool_type":"' || tool_type || '","n":' || count(*) || ',"raw":' || CAST(sum(raw_tokens) AS BIGINT) || '}' AS report FROM obs GROUP BY tool_type""", "obs")
def json_report(spark, d):
    return dashboard.json_report(sums(observations(spark, d), "tool_type"), "tool_type", "n", "raw")


# Filters


@query(f", {JOINED} SELECT {SUMS} FROM j WHERE (m = '' OR m IN ('gpt-5')) AND coalesce(harness, '') IN ('claude', 'claude-code', 'cursor', 'cursor-cli')", "obs sess")
def filtered_totals(spark, d):
    rows = joined(spark, d)
    return sums(rows.where(dashboard.model_filter(["gpt-5", dashboard.UNKNOWN], dashboard.resolved_model()) & dashboard.harness_filter(["claude", "cursor"], F.col("harness"))))


@query(f"SELECT {SUMS} FROM obs", "obs")
def unfiltered_totals(spark, d):
    rows = joined(spark, d)
    return sums(rows.where(dashboard.model_filter([], dashboard.resolved_model()) & dashboard.harness_filter(None, F.col("harness"))))


@query(f", {JOINED} SELECT {SUMS} FROM j WHERE m = 'gpt-5' OR (m = '' AND session_id IN (SELECT session FROM turns WHERE model = 'gpt-5'))", "obs sess turns")
def blank_models_attributed(spark, d):
    return sums(dashboard.attributed(joined(spark, d), turns(spark, d), "gpt-5"))


@query(f"SELECT {SUMS} FROM obs WHERE session_id IN (SELECT session FROM turns)", "obs turns")
def ledger_session_totals(spark, d):
    return sums(observations(spark, d).join(turns(spark, d).select(F.col("session").alias("session_id")).distinct(), "session_id", "left_semi"))


NAMES = "names AS (SELECT l_orderkey AS id, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN ' Unknown ' WHEN 3 THEN '<x>' WHEN 4 THEN 'synthetic' WHEN 5 THEN 'cursor/claude-opus-4-7-thinking-max' WHEN 6 THEN 'openai/gpt-5-high' ELSE 'grok-4.5-fast' END AS model, l_quantity, l_linenumber FROM lineitem)"


def names(spark, d):
    by = ["", " Unknown ", "<x>", "synthetic", "cursor/claude-opus-4-7-thinking-max", "openai/gpt-5-high", "grok-4.5-fast"]
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, by)), F.col("l_linenumber").cast("int")).alias("model"), "l_quantity", "l_linenumber")


@query(f"WITH {NAMES} SELECT model, count(*) AS n FROM names WHERE l_linenumber >= 5 GROUP BY 1")
def listed_models(spark, d):
    return names(spark, d).where(dashboard.listed_model(F.col("model"))).groupBy("model").agg(F.count("*").alias("n"))


@query(f"""WITH {NAMES} SELECT DISTINCT model, CASE l_linenumber WHEN 5 THEN 'claude-opus-4-7' WHEN 6 THEN 'gpt-5' WHEN 7 THEN 'grok-4.5' ELSE trim(model) END AS base,
  CASE l_linenumber WHEN 5 THEN 'max' WHEN 6 THEN 'high' WHEN 7 THEN 'fast' ELSE '' END AS effort, l_linenumber = 5 AS thinking, CASE l_linenumber WHEN 5 THEN 'anthropic' WHEN 6 THEN 'openai' WHEN 7 THEN 'xai' ELSE '' END AS provider,
  CASE l_linenumber WHEN 1 THEN 'Other' WHEN 2 THEN 'Other' WHEN 3 THEN '<x>' WHEN 4 THEN 'Synthetic' WHEN 5 THEN 'Cursor/claude-Opus-4-7-Thinking-Max' WHEN 6 THEN 'Openai/gpt-5-High' ELSE 'Grok-4.5-Fast' END AS label,
  CASE WHEN l_linenumber IN (5, 6) THEN 200000 ELSE 128000 END AS context FROM names""")
def model_parts(spark, d):
    rows = names(spark, d).select("model").distinct()
    return rows.select("model", C.model_parts(F.col("model")).alias("p"), C.model_label(F.col("model")).alias("label"), C.context_window(F.col("model")).alias("context")).select("model", "p.*", "label", "context")


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'al') AND lower(p_name) LIKE '%a_e%'")
def text_filters(spark, d):
    parts = table(spark, d, "part")
    return parts.where(dashboard.contains_text(F.col("p_type"), "AL") & dashboard.like_text(F.col("p_name"), "A_E")).select("p_partkey", "p_type")


@query("SELECT p_partkey, p_name, o_orderpriority, count(*) AS orders FROM part JOIN orders ON p_partkey = o_orderkey % 2000 WHERE p_name LIKE 'red %' AND o_orderpriority LIKE '1%' GROUP BY ALL")
def prefix_filters(spark, d):
    parts = table(spark, d, "part").where(dashboard.prefix_text(F.col("p_name"), "red ")).select("p_partkey", "p_name")
    orders = table(spark, d, "orders").where(dashboard.prefix_text(F.col("o_orderpriority"), "1")).select((F.col("o_orderkey") % 2000).alias("p_partkey"), "o_orderpriority")
    return parts.join(orders, "p_partkey").groupBy("p_partkey", "p_name", "o_orderpriority").agg(F.count("*").alias("orders"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 GROUP BY 1")
def json_path_filter(spark, d):
    return table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("long") > 50).groupBy("event_type").agg(F.count("*").alias("n"))


# Joins and sets


@query("SELECT obs.id, coalesce(nullif(obs.model, ''), nullif(sess.model, ''), '') AS model FROM obs LEFT JOIN sess ON session_id = sess.id", "obs sess")
def models_backfilled(spark, d):
    return dashboard.backfilled(observations(spark, d), sessions(spark, d))


@query("""WITH v AS (SELECT p_brand || '/' || p_type AS name, p_size <= 25 AS old, count(*) AS body FROM part GROUP BY 1, 2)
  SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'gone' WHEN a.body = b.body THEN 'same' ELSE 'changed' END AS state
  FROM (SELECT * FROM v WHERE old) a FULL JOIN (SELECT * FROM v WHERE NOT old) b ON a.name = b.name""")
def name_difference(spark, d):
    v = table(spark, d, "part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("name"), (F.col("p_size") <= 25).alias("old")).agg(F.count("*").alias("body"))
    return dashboard.name_difference(v.where("old").drop("old"), v.where("not old").drop("old"))


PATHS = "paths AS (SELECT page_id, trim(regexp_extract(url, '^[^:]*://[^/?#]*/([^?#]*)', 1), '/') AS path FROM pages), a AS (SELECT DISTINCT path AS a FROM paths WHERE path <> ''), b AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS b FROM paths WHERE page_id % 3 = 0 AND path <> '' UNION SELECT DISTINCT path FROM paths WHERE page_id % 5 = 0 AND path <> '')"


@query(f"WITH {PATHS} SELECT a, b FROM a, b WHERE a = b OR ends_with(a, '/' || b) OR ends_with(b, '/' || a)")
def suffix_paths(spark, d):
    paths = table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("url", "^[^:]*://[^/?#]*/([^?#]*)", 1), F.lit("/")).alias("path")).where("path <> ''")
    last = paths.where("page_id % 3 = 0").select(F.regexp_extract("path", "[^/]*$", 0).alias("b")).union(paths.where("page_id % 5 = 0").select("path"))
    return dashboard.suffix_matches(paths.select(F.col("path").alias("a")), last)


@query("SELECT id, lag(id) OVER (PARTITION BY session_id, tool_type ORDER BY id) AS prev_id FROM obs", "obs")
def previous_version(spark, d):
    return dashboard.previous_version(observations(spark, d))


@query("""WITH f AS (SELECT DISTINCT p_name AS uri FROM part WHERE contains(lower(p_name), 'a')), s AS (SELECT DISTINCT p_name AS uri FROM part WHERE p_size > 20)
  SELECT uri, source FROM (SELECT uri, 0 AS source FROM (SELECT * FROM f ORDER BY uri LIMIT 10) UNION ALL SELECT uri, 1 FROM s WHERE uri NOT IN (SELECT uri FROM (SELECT * FROM f ORDER BY uri LIMIT 10))) ORDER BY source, uri LIMIT 16""")
def search_union(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("uri"), "p_size")
    first = parts.where(dashboard.contains_text(F.col("uri"), "A")).select("uri").distinct().orderBy("uri").limit(10)
    return dashboard.ranked_union(first, parts.where("p_size > 20").select("uri").distinct(), 16)


@query("""WITH l AS (SELECT doc_id, list_distinct(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)
  SELECT b.doc_id, CAST(len(list_filter(b.x, lambda y: NOT list_contains(a.x, y))) AS BIGINT) AS added, CAST(len(list_filter(a.x, lambda y: NOT list_contains(b.x, y))) AS BIGINT) AS removed FROM l b JOIN l a ON a.doc_id = b.doc_id - 1""")
def line_changes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return dashboard.line_changes(docs.select((F.col("doc_id") + 1).alias("doc_id"), "text"), docs)


# Ledger


@query("""SELECT harness, count(*) AS turns, CAST(sum(input_tokens) AS BIGINT) AS input, CAST(sum(output_tokens) AS BIGINT) AS output, CAST(sum(cache_read_tokens) AS BIGINT) AS read,
  CAST(sum(cache_write_5m + cache_write_1h) AS BIGINT) AS written, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning, CAST(sum(CAST(is_compaction AS BIGINT)) AS BIGINT) AS compactions,
  max(quota_used_pct) AS quota, arg_max(plan_type, (ts, turn_key, plan_type)) FILTER (plan_type <> '') AS plan_type FROM turns GROUP BY 1""", "turns")
def ledger_rollup(spark, d):
    return dashboard.rollup(turns(spark, d))


@query("SELECT model, arg_max(plan_type, (ts, turn_key, plan_type)) AS plan_type FROM turns WHERE plan_type <> '' GROUP BY 1", "turns")
def latest_plan(spark, d):
    return dashboard.latest_plans(turns(spark, d), "model")


@query("SELECT harness, round(sum(cache_read_tokens)::DOUBLE / sum(input_tokens + cache_read_tokens + cache_write_5m + cache_write_1h) * 1e6) / 1e6 AS hit_rate FROM turns GROUP BY 1", "turns")
def naive_hit_rate(spark, d):
    return dashboard.naive_hit_rate(turns(spark, d))


@query("SELECT DISTINCT session FROM turns WHERE model = 'gpt-5' ORDER BY 1", "turns")
def sessions_of_model(spark, d):
    return turns(spark, d).where("model = 'gpt-5'").select("session").distinct().orderBy("session")


#: A model of each price family with its input price.
TIERED = [("claude-opus-5", 5.0), ("gpt-5", 1.25), ("o3", 10.0), ("grok-4.5", 2.0), ("composer-2.5", 0.5), ("deepseek-v4-pro", 0.435), ("gemini-2.5-pro", 1.25), ("unpriced", None)]
TIER_SQL = f"""tier AS (SELECT *, CASE turn_key % 8 {' '.join(f"WHEN {i} THEN '{m}'" for i, (m, _) in enumerate(TIERED))} END AS m,
  CAST(CASE turn_key % 8 {' '.join(f"WHEN {i} THEN {'NULL' if p is None else p}" for i, (_, p) in enumerate(TIERED))} END AS DOUBLE) AS price, CASE turn_key % 8 WHEN 2 THEN 'openai' ELSE '' END AS provider,
  CASE WHEN harness = 'codex' THEN greatest(input_tokens - greatest(cache_read_tokens, 0) - (cache_write_5m + cache_write_1h), 0) ELSE input_tokens END AS fresh FROM turns),
usd AS (SELECT *, round((fresh + CASE turn_key % 8 WHEN 0 THEN cache_read_tokens * 0.1::DOUBLE + cache_write_5m * 1.25::DOUBLE + cache_write_1h * 2.0::DOUBLE + output_tokens * 5.0::DOUBLE
    WHEN 1 THEN cache_read_tokens * 0.25::DOUBLE + cache_write_5m + cache_write_1h + output_tokens * 8.0::DOUBLE WHEN 2 THEN cache_read_tokens * 0.25::DOUBLE + cache_write_5m + cache_write_1h + output_tokens * 8.0::DOUBLE
    WHEN 5 THEN cache_read_tokens * 0.02::DOUBLE + cache_write_5m + cache_write_1h + output_tokens * 2.0::DOUBLE WHEN 6 THEN cache_read_tokens * 0.1::DOUBLE + cache_write_5m + cache_write_1h + output_tokens * 4.0::DOUBLE
    ELSE cache_read_tokens * 0.1::DOUBLE + cache_write_5m + cache_write_1h + output_tokens * 3.0::DOUBLE END
  + CASE WHEN harness = 'codex' OR provider = 'openai' THEN 0.0::DOUBLE ELSE reasoning_tokens * CASE turn_key % 8 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 8.0::DOUBLE WHEN 5 THEN 2.0::DOUBLE WHEN 6 THEN 4.0::DOUBLE ELSE 3.0::DOUBLE END END) * price / 1e6 * 1e6) / 1e6 AS usd FROM tier)"""


def tiered(spark, d):
    i = (F.col("turn_key") % 8 + 1).cast("int")
    rows = turns(spark, d).withColumns({"m": F.element_at(F.array(*[F.lit(m) for m, _ in TIERED]), i), "price": F.element_at(F.array(*[F.lit(p).cast("double") for _, p in TIERED]), i), "provider": F.when(F.col("turn_key") % 8 == 2, "openai").otherwise("")})
    usd = prices.usd(F.col("price"), {}, F.col("m"), F.col("harness"), F.col("provider"), dashboard.fresh_input(rows), *[F.col(c) for c in ("output_tokens", "cache_read_tokens", "cache_write_5m", "cache_write_1h", "reasoning_tokens")])
    return rows.withColumn("usd", usd)


@query(f", {TIER_SQL} SELECT m AS model, harness, count(*) AS turns, sum(CAST(round(usd * 1e5) AS BIGINT)) / 1e5 AS usd FROM usd GROUP BY 1, 2", "turns")
def tier_costs(spark, d):
    return tiered(spark, d).groupBy(F.col("m").alias("model"), "harness").agg(F.count("*").alias("turns"), (F.sum(F.round(F.col("usd") * 1e5).cast("long")) / 1e5).alias("usd"))


@query(f""", {TIER_SQL} SELECT h AS harness, count(usd.harness) AS turns, round(sum(CAST(round(usd * 1e6) AS BIGINT)) / 1e6, 2) AS usd,
  CASE WHEN count(usd.harness) = 0 THEN 'empty' WHEN count(usd) = 0 THEN 'unpriced' ELSE 'priced' END AS kind FROM (VALUES ('claude'), ('codex'), ('cursor')) x(h) LEFT JOIN usd ON h = usd.harness GROUP BY 1""", "turns")
def source_costs(spark, d):
    return dashboard.domain_costs(tiered(spark, d).select("harness", "usd"), ["claude", "codex", "cursor"]).withColumn("usd", F.round("usd", 2))


@query("""SELECT session, max(CASE WHEN r = 1 THEN cache_read_tokens END) = 0 AND coalesce(max(CASE WHEN r = 2 THEN cache_read_tokens END), 0) > 0 AS dead
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, turn_key DESC, reasoning_tokens DESC) AS r FROM turns) WHERE r <= 2 GROUP BY 1""", "turns")
def cache_dead_sessions(spark, d):
    last = dashboard.last_two(turns(spark, d))
    return last.select("session", ((F.col("last.cache_read_tokens") == 0) & (F.col("prev_read") > 0)).alias("dead"))


def _usd(t: dict):
    get = lambda f: t[f]
    fresh = C.uncached_input(get("harness"), get("input_tokens"), get("cache_read_tokens"), get("cache_write_5m") + get("cache_write_1h"))
    return prices.usd(C.input_price(get("model")), {}, get("model"), get("harness"), F.lit(""), fresh, *[get(f) for f in ("output_tokens", "cache_read_tokens", "cache_write_5m", "cache_write_1h", "reasoning_tokens")])


@query(None)
def keep_or_rotate(spark, d):
    return dashboard.advice(turns(spark, d), 3, NOW, _usd, lambda t: _usd(dashboard.cold_turn(t)))


@query("""SELECT session_id, epoch, min(created_at) AS started_at, count(*) AS n FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM (
    SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(model) OVER w IS NOT DISTINCT FROM model AND lag(optimizer) OVER w IS NOT DISTINCT FROM optimizer THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id))) GROUP BY 1, 2""", "obs")
def epochs_of_marks(spark, d):
    return dashboard.epochs(observations(spark, d), "session_id", ["created_at", "id"], ["model", "optimizer"])


@query(None)
def optimizer_tunes(spark, d):
    return dashboard.tuned(observations(spark, d), ["session_id", "tool_type"], every=3)


@query("""WITH n AS (SELECT session_id, row_number() OVER w AS n, sum(refetched_tokens) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS r FROM obs WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
  s AS (SELECT session_id, list(r / n::DOUBLE ORDER BY n) FILTER (n % 50 = 0) AS rates, max(n) AS intercepts FROM n GROUP BY 1)
  SELECT session_id, intercepts, round(list_reduce(coalesce(rates, []), lambda t, x: CASE WHEN x > 0.20 THEN least(t + 0.05, 1.4) WHEN x < 0.05 THEN greatest(t - 0.05, 0.75) ELSE t END, 1.0::DOUBLE), 6) AS tune FROM s""".replace("WITH n", ", n", 1), "obs")
def session_tunes(spark, d):
    """The feedback fold with a step after every 50 calls of a session."""
    return dashboard.tuned(observations(spark, d), ["session_id"])


# Lists


@query("SELECT page_id FROM pages ORDER BY page_id DESC LIMIT 16")
def recent_pages(spark, d):
    return table(spark, d, "pages").select("page_id").orderBy(F.desc("page_id")).limit(16)


@query(f", {JOINED} SELECT coalesce(nullif(m, ''), '__unknown__') AS model_id, CAST(sum(avoided_tokens) AS BIGINT) AS avoided, CAST(sum(raw_tokens) AS BIGINT) AS raw FROM j GROUP BY 1 ORDER BY model_id = '__unknown__', avoided DESC, raw DESC, model_id LIMIT 3", "obs sess")
def models_ordered(spark, d):
    by = sums(joined(spark, d).withColumn("model_id", F.coalesce(F.nullif(dashboard.resolved_model(), F.lit("")), F.lit(dashboard.UNKNOWN))), "model_id")
    return by.select("model_id", "avoided", "raw").orderBy(F.col("model_id") == dashboard.UNKNOWN, F.desc("avoided"), F.desc("raw"), "model_id").limit(3)


@query("SELECT coalesce(optimizer, 'passthrough') AS optimizer, count(*) AS intercepts, CAST(sum(avoided_tokens) AS BIGINT) AS avoided, CAST(sum(refetched_tokens) AS BIGINT) AS refetched FROM obs GROUP BY 1 ORDER BY intercepts DESC, optimizer", "obs")
def optimizer_stats(spark, d):
    by = observations(spark, d).groupBy(F.coalesce("optimizer", F.lit("passthrough")).alias("optimizer"))
    return by.agg(F.count("*").alias("intercepts"), F.sum("avoided_tokens").alias("avoided"), F.sum("refetched_tokens").alias("refetched")).orderBy(F.desc("intercepts"), "optimizer")


@query("SELECT tool_type, model, id FROM (SELECT *, row_number() OVER (PARTITION BY tool_type, model ORDER BY created_at DESC, id DESC) AS r FROM obs) WHERE r = 1 ORDER BY created_at DESC, id DESC LIMIT 12", "obs")
def newest_distinct(spark, d):
    return dashboard.newest_distinct(observations(spark, d), ["tool_type", "model"])


@query(f"SELECT id, created_at FROM obs WHERE created_at >= {UNTIL} - 7 * 86400 AND created_at <= {UNTIL} ORDER BY created_at DESC, id DESC LIMIT 12", "obs")
def feed_of_week(spark, d):
    return observations(spark, d).where(F.col("created_at").between(UNTIL - 7 * 86400, UNTIL)).select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(12)


@query("""WITH h AS (SELECT source AS file, doc_id AS pos FROM documents WHERE contains(lower(text), 'the')), f AS (SELECT file, min(pos) AS p FROM h WHERE file IS NOT NULL GROUP BY 1 ORDER BY p, file LIMIT 8)
  SELECT file, pos FROM h WHERE file IN (SELECT file FROM f) QUALIFY row_number() OVER (PARTITION BY file ORDER BY pos) <= 4""")
def hits_by_file(spark, d):
    hits = table(spark, d, "documents").where(dashboard.contains_text(F.col("text"), "the") & F.col("source").isNotNull())
    return dashboard.hits_by_file(hits.select(F.col("source").alias("file"), F.col("doc_id").alias("pos")))


@query("""SELECT id, s[CAST(floor((len(s) - 1) * 0.5::DOUBLE + 0.5) AS BIGINT) + 1] AS p50, s[CAST(floor((len(s) - 1) * 0.9::DOUBLE + 0.5) AS BIGINT) + 1] AS p90, s[CAST(floor((len(s) - 1) * 0.99::DOUBLE + 0.5) AS BIGINT) + 1] AS p99
  FROM (SELECT id, list_sort(list(raw_tokens) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)) AS s FROM obs)""", "obs")
def sliding_quantiles(spark, d):
    return dashboard.sliding_quantiles(observations(spark, d))


# Scalars


@query("SELECT id, CASE WHEN x > 1e10 THEN x // 1000 ELSE x END AS a, CASE WHEN x > 1e10 THEN x // 1000 ELSE x END AS b, created_at AS c FROM (SELECT id, created_at, CASE WHEN id % 2 = 0 THEN created_at * 1000 ELSE created_at END AS x FROM obs)", "obs")
def clock_seconds(spark, d):
    x = F.when(F.col("id") % 2 == 0, F.col("created_at") * 1000).otherwise(F.col("created_at"))
    text = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ss'+05:30'")
    return observations(spark, d).select("id", C.seconds_of(x.cast("string")).alias("a"), C.seconds_of(F.concat(x.cast("string"), F.lit(".5"))).alias("b"), C.seconds_of(text).alias("c"))


@query("SELECT id, strftime(make_timestamp(created_at * 1000000), '%b %d') AS label, year(make_timestamp(created_at * 1000000)) AS y, month(make_timestamp(created_at * 1000000)) AS m, day(make_timestamp(created_at * 1000000)) AS d FROM obs", "obs")
def civil_dates(spark, d):
    t = F.timestamp_seconds("created_at")
    return observations(spark, d).select("id", F.date_format(t, "MMM dd").alias("label"), *[f(t).cast("long").alias(n) for f, n in ((F.year, "y"), (F.month, "m"), (F.dayofmonth, "d"))])


@query("""SELECT id, CAST(least(greatest(cap, lo), hi) AS BIGINT) AS cap FROM (SELECT *, floor(floor(floor(floor(least(greatest(raw_tokens * 15 // 100, 180), 512) * w + 0.5) * CASE k % 3 WHEN 0 THEN 0.72::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.35::DOUBLE END + 0.5) * 1.05::DOUBLE + 0.5) * CASE WHEN k = 0 THEN 1.0::DOUBLE WHEN k < 40 THEN 1.15::DOUBLE WHEN k > 70 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END + 0.5) AS cap
  FROM (SELECT id, raw_tokens, k, CASE k % 4 WHEN 0 THEN 0.62::DOUBLE WHEN 1 THEN 1.35::DOUBLE WHEN 2 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS w,
    CASE k % 4 WHEN 0 THEN 120 WHEN 1 THEN 220 WHEN 2 THEN 120 ELSE 160 END AS lo, CASE k % 4 WHEN 0 THEN 280 WHEN 1 THEN 720 WHEN 2 THEN 320 ELSE 640 END AS hi FROM obs))""", "obs")
def token_caps(spark, d):
    k = F.col("k")
    kind, code = F.when(k % 4 <= 1, "shell").when(k % 4 == 2, "mcp").otherwise("file"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 1)
    strategy = F.when(k % 3 == 0, "extreme").when(k % 3 == 1, "balanced").otherwise("conservative")
    return observations(spark, d).select("id", C.token_cap(F.col("raw_tokens"), kind, code, F.lit(0), F.lit(False), strategy, F.lit(1.05), k, F.lit(False)).alias("cap"))


@query("SELECT id, CASE WHEN raw_tokens >= 1000000 THEN printf('%.2fM', floor(raw_tokens / 1e4 + 0.5) / 100) WHEN raw_tokens >= 1000 THEN printf('%.2fK', floor(raw_tokens / 1e1 + 0.5) / 100) ELSE CAST(raw_tokens AS VARCHAR) END AS short, format('{:,}', raw_tokens) AS long, CAST(least(greatest(raw_tokens * 100 // 128000, 0), 100) AS BIGINT) AS pct FROM obs", "obs")
def number_labels(spark, d):
    return observations(spark, d).select("id", C.compact_number(F.col("raw_tokens")).alias("short"), F.format_number("raw_tokens", 0).alias("long"), C.occupancy_pct(F.col("raw_tokens"), F.lit(128000)).alias("pct"))


@query("SELECT id, sha256(session_id || '|' || id || '|' || tool_type) AS key, substr(sha256(session_id || '|' || id || '|' || tool_type), 1, 12) AS short_id, 'page://' || tool_type || '/' || substr(sha256(session_id || '|' || id || '|' || tool_type), 1, 12) AS uri, tool_type AS kind FROM obs", "obs")
def page_keys(spark, d):
    key = F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), F.col("id").cast("string"), "tool_type"), 256)
    rows = observations(spark, d).select("id", key.alias("key"), F.substring(key, 1, 12).alias("short_id"), F.concat(F.lit("page://"), "tool_type", F.lit("/"), F.substring(key, 1, 12)).alias("uri"))
    return rows.withColumn("kind", F.regexp_extract("uri", "^page://([^/]*)/", 1))


@query("SELECT id, 'at <ts> id <id>' || chr(10) || 'n ' || k AS text FROM obs", "obs")
def canonical_texts(spark, d):
    clock = F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ss'.25Z'")
    uuid = F.regexp_replace(F.md5(F.col("id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return observations(spark, d).select("id", C.canonical_text(F.concat(F.lit("at "), clock, F.lit(" id "), uuid, F.lit("\r\nn "), F.col("k").cast("string"))).alias("text"))


@query("""SELECT doc_id, CASE WHEN n > 0 AND (n - a) * 100 >= n * 20 THEN 'cjk' WHEN regexp_matches(s, '^[ \\t\\n\\r]*[{\\[]') AND contains(s, ':') THEN 'json' WHEN n > 80 AND d * 100 // n > 92 THEN 'binary' ELSE 'prose' END AS kind
  FROM (SELECT doc_id, s, length(s) AS n, length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g')) AS a, length(s) - length(regexp_replace(s, '[A-Za-z0-9+/=]', '', 'g')) AS d FROM (SELECT doc_id, left(coalesce(text, ''), 4000) AS s FROM documents))""")
def token_kinds(spark, d):
    return table(spark, d, "documents").select("doc_id", C.token_kind(F.lit("prose"), F.coalesce("text", F.lit(""))).alias("kind"))
