"""The engine's own queries by name, each with the SQL that must give the same rows (none where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.functions.columns import ALIASES, FAMILIES, INPUT_USD, estimated_tokens
from sparkwell.operators import analytics, texts
from sparkwell.sources.model import OBS_SQL, SESS_SQL, TURNS_SQL, observations, sessions, table, turns

SINCE, UNTIL, NOW = 1704412800, 1705276800, 1706745600
ZONE = 19800
TERMS = ["idiot", "the", "and", "menteau"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "") -> Callable:
    """Register a function under its name; ``uses`` lists the CTEs that the SQL needs."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            parts = [{"obs": OBS_SQL, "sess": SESS_SQL, "turns": TURNS_SQL}[u] for u in uses.split()]
            SQL[f.__name__] = f"WITH {', '.join(parts)}{'' if sql.startswith(',') else ' '}{sql}" if parts else sql
        return f

    return put


TOTALS = """count(*) AS n, CAST(coalesce(sum(raw_tokens), 0) AS BIGINT) AS raw, CAST(coalesce(sum(delivered_tokens), 0) AS BIGINT) AS delivered,
  CAST(coalesce(sum(avoided_tokens), 0) AS BIGINT) AS avoided, CAST(coalesce(sum(refetched_tokens), 0) AS BIGINT) AS refetched,
  CAST(CASE WHEN coalesce(sum(raw_tokens), 0) = 0 THEN 0 ELSE round(sum(avoided_tokens) * 100.0::DOUBLE / sum(raw_tokens)) END AS BIGINT) AS reduction_pct,
  CAST(greatest(coalesce(sum(avoided_tokens), 0) - coalesce(sum(refetched_tokens), 0), 0) AS BIGINT) AS net_avoided"""


@query(f"SELECT {TOTALS} FROM obs WHERE created_at BETWEEN {SINCE} AND {UNTIL}", "obs")
def totals_window(spark, d):
    return analytics.totals(analytics.between(observations(spark, d), "created_at", SINCE, UNTIL))


@query(f"SELECT tool_type, {TOTALS} FROM obs GROUP BY 1", "obs")
def totals_by_tool(spark, d):
    return analytics.totals(observations(spark, d), "tool_type")


@query(f"SELECT session_id, {TOTALS} FROM obs GROUP BY 1 ORDER BY avoided DESC, session_id LIMIT 20", "obs")
def totals_by_session_top(spark, d):
    return analytics.totals(observations(spark, d), "session_id").orderBy(F.desc("avoided"), "session_id").limit(20)


@query(f"SELECT shadow, {TOTALS} FROM obs GROUP BY 1", "obs")
def totals_shadow_split(spark, d):
    return analytics.totals(observations(spark, d), "shadow")


@query(f"SELECT harness, {TOTALS} FROM obs JOIN sess ON session_id = sess.id GROUP BY 1", "obs sess")
def totals_by_harness(spark, d):
    return analytics.totals(analytics.with_sessions(observations(spark, d), sessions(spark, d), "inner"), "harness")


@query(f"SELECT coalesce(harness, 'unknown') AS harness, {TOTALS} FROM obs LEFT JOIN sess ON session_id = sess.id GROUP BY 1", "obs sess")
def totals_by_harness_all(spark, d):
    joined = analytics.with_sessions(observations(spark, d), sessions(spark, d))
    return analytics.totals(joined.withColumn("harness", F.coalesce("harness", F.lit("unknown"))), "harness")


@query("""SELECT coalesce(nullif(obs.model, ''), nullif(sess.model, ''), '__unknown__') AS model_id, count(*) AS n, CAST(sum(avoided_tokens) AS BIGINT) AS avoided,
  count(DISTINCT session_id) AS sessions, coalesce(string_agg(DISTINCT harness, ',' ORDER BY harness), '') AS harnesses FROM obs LEFT JOIN sess ON session_id = sess.id GROUP BY 1""", "obs sess")
def models_rollup(spark, d):
    return analytics.models(analytics.with_sessions(observations(spark, d), sessions(spark, d)))


@query("SELECT created_at // 3600 * 3600 AS bucket, count(*) AS n, CAST(sum(avoided_tokens) AS BIGINT) AS avoided FROM obs GROUP BY 1", "obs")
def series_hourly(spark, d):
    return analytics.series(observations(spark, d), 3600)


@query(f"""SELECT g.bucket, coalesce(n, 0) AS n, coalesce(avoided, 0) AS avoided
  FROM (SELECT unnest(generate_series(({SINCE} + {ZONE}) // 86400 * 86400 - {ZONE}, ({UNTIL} + {ZONE}) // 86400 * 86400 - {ZONE}, 86400)) AS bucket) g
  LEFT JOIN (SELECT (created_at + {ZONE}) // 86400 * 86400 - {ZONE} AS bucket, count(*) AS n, CAST(sum(avoided_tokens) AS BIGINT) AS avoided
             FROM obs WHERE created_at BETWEEN {SINCE} AND {UNTIL} GROUP BY 1) s ON g.bucket = s.bucket""", "obs")
def series_daily_dense(spark, d):
    return analytics.dense_series(observations(spark, d), SINCE, UNTIL, 86400, ZONE)


REASONS = """rows AS (
  SELECT coalesce(json_extract_string(r, '$.label'), 'unspecified') AS label, coalesce(CAST(json_extract_string(r, '$.tokens') AS BIGINT), 0) AS tokens
  FROM (SELECT unnest(CAST(CAST(reasons AS JSON) AS JSON[])) AS r FROM obs WHERE reasons <> '[]')
  UNION ALL SELECT 'unspecified', avoided_tokens FROM obs WHERE reasons = '[]' AND avoided_tokens > 0
)"""


@query(f", {REASONS} SELECT label, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM rows GROUP BY 1", "obs")
def reason_breakdown(spark, d):
    return analytics.reasons(observations(spark, d))


@query(f""", {REASONS}, named AS (SELECT label, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows GROUP BY 1 HAVING sum(tokens) > 0),
  whole AS (SELECT CAST(sum(delivered_tokens) AS BIGINT) AS delivered, CAST(sum(avoided_tokens) AS BIGINT) AS avoided FROM obs)
  SELECT 'delivered' AS label, delivered AS tokens FROM whole UNION ALL SELECT * FROM named
  UNION ALL SELECT 'residual', CAST(avoided - (SELECT coalesce(sum(tokens), 0) FROM named) AS BIGINT) AS t FROM whole WHERE avoided - (SELECT coalesce(sum(tokens), 0) FROM named) > 0""", "obs")
def composition(spark, d):
    return analytics.composition(observations(spark, d))


@query("SELECT coalesce(optimizer, 'none') AS optimizer, CAST(sum(avoided_tokens) AS BIGINT) AS tokens, CAST(sum(avoided_tokens) * 100 // sum(sum(avoided_tokens)) OVER () AS BIGINT) AS pct FROM obs GROUP BY 1", "obs")
def optimizer_shares(spark, d):
    return analytics.optimizer_shares(observations(spark, d))


@query("SELECT * FROM sess WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.session_id = sess.id AND referenced)", "obs sess")
def clean_sessions(spark, d):
    return analytics.clean_sessions(sessions(spark, d), observations(spark, d))


@query("SELECT session_id, id, tool_type, raw_tokens, created_at FROM obs QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) = 1", "obs")
def latest_per_session(spark, d):
    return analytics.latest(observations(spark, d))


@query("SELECT id, session_id, lag(tool_type) OVER w AS prev_tool, raw_tokens - lag(raw_tokens) OVER w AS delta FROM obs WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)", "obs")
def prev_turn_delta(spark, d):
    return analytics.previous(observations(spark, d))


@query("SELECT id, coalesce(last_value(nullif(model, '') IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING), '__unknown__') AS model FROM obs", "obs")
def carry_forward_model(spark, d):
    return analytics.carried_model(observations(spark, d))


@query("SELECT id, raw_tokens FROM obs WHERE model = '' UNION ALL SELECT id, raw_tokens FROM (SELECT * FROM obs WHERE model <> '' QUALIFY row_number() OVER (PARTITION BY session_id, model, tool_type ORDER BY id) = 1)", "obs")
def dedup_first_wins(spark, d):
    return analytics.first_wins(observations(spark, d))


@query(f"""SELECT CASE WHEN referenced AND {NOW} - created_at <= 900 THEN 'hot' WHEN referenced OR {NOW} - created_at <= 86400 THEN 'warm' ELSE 'cold' END AS layer, tool_type,
  count(*) AS n, CAST(sum(delivered_tokens) AS BIGINT) AS delivered FROM obs GROUP BY 1, 2""", "obs")
def hot_warm_cold(spark, d):
    return analytics.layers(observations(spark, d), NOW)


@query("SELECT id, raw_tokens, avoided_tokens FROM obs WHERE raw_tokens >= 80 ORDER BY raw_tokens DESC, avoided_tokens DESC, id LIMIT 8", "obs")
def notable_rows(spark, d):
    return analytics.notable(observations(spark, d))


@query("SELECT id, tool_type, created_at FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY tool_type ORDER BY created_at DESC, id DESC) <= 4) ORDER BY created_at DESC, id DESC LIMIT 12", "obs")
def capped_feed(spark, d):
    return analytics.capped_feed(observations(spark, d))


@query("SELECT * FROM (SELECT id, session_id, CAST(sum(delivered_tokens) OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM obs) WHERE used <= 4000", "obs")
def budget_fill(spark, d):
    return analytics.budget_fill(observations(spark, d), 4000)


@query("""SELECT id, CAST(list_extract(list_sort(list(raw_tokens) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)),
  (len(list(raw_tokens) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 127 PRECEDING AND CURRENT ROW)) + 1) // 2) AS BIGINT) AS median_raw FROM obs""", "obs")
def sliding_median(spark, d):
    return analytics.sliding_median(observations(spark, d))


@query(""", m AS (SELECT *, CASE WHEN lag(model) OVER w IS NOT DISTINCT FROM model THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id)),
  e AS (SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM m)
  SELECT session_id, epoch, model, min(created_at) AS started_at, count(*) AS n FROM e GROUP BY 1, 2, 3""", "obs")
def epochs(spark, d):
    return analytics.epochs(observations(spark, d))


@query("SELECT session_id, string_agg(tool_type || ':' || raw_tokens, chr(10) ORDER BY created_at, id) AS body FROM obs GROUP BY 1", "obs")
def journal_text(spark, d):
    return analytics.journal(observations(spark, d))


FRESH = "CASE WHEN harness = 'codex' THEN greatest(input_tokens - greatest(cache_read_tokens, 0) - cache_write_5m - cache_write_1h, 0) ELSE input_tokens END"
LEDGER = f"""count(*) AS turns, CAST(coalesce(sum({FRESH}), 0) AS BIGINT) AS fresh, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output, CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS "read",
  CAST(coalesce(sum(cache_write_5m + cache_write_1h), 0) AS BIGINT) AS written, CAST(coalesce(sum(reasoning_tokens), 0) AS BIGINT) AS reasoning,
  CAST(coalesce(sum(CAST(is_compaction AS BIGINT)), 0) AS BIGINT) AS compactions, CAST(coalesce(sum(CASE WHEN cache_read_tokens = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS misses,
  round(sum(cache_read_tokens)::DOUBLE / (sum({FRESH}) + sum(cache_read_tokens) + sum(cache_write_5m + cache_write_1h))::DOUBLE * 1e6) / 1e6 AS hit_rate"""


@query(f"SELECT {LEDGER} FROM turns", "turns")
def ledger_kpis(spark, d):
    return analytics.ledger(turns(spark, d))


@query(f"SELECT model, harness, {LEDGER} FROM turns GROUP BY 1, 2", "turns")
def cache_hit_rate(spark, d):
    return analytics.ledger(turns(spark, d), "model", "harness")


@query(f"SELECT h.harness, coalesce(turns, 0) AS turns, hit_rate FROM (VALUES ('claude'), ('codex'), ('cursor')) h(harness) LEFT JOIN (SELECT harness, {LEDGER} FROM turns GROUP BY 1) l ON h.harness = l.harness", "turns")
def ledger_sources(spark, d):
    return analytics.ledger_by_domain(turns(spark, d), ["claude", "codex", "cursor"])


def _rate(i: int) -> str:
    """A family's multiple of the input price, by words in the model id."""
    cases = " ".join(f"WHEN regexp_matches(model, '{'|'.join(words)}') THEN {rates[i]}::DOUBLE" for words, rates in FAMILIES if words)
    return f"CASE {cases} ELSE {FAMILIES[-1][1][i]}::DOUBLE END"


CANON = "CASE model " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE model END"
PRICE = f"CASE {CANON} " + " ".join(f"WHEN '{m}' THEN {p}::DOUBLE" for m, p in INPUT_USD.items()) + " END"
USD = f"""round(({FRESH} + output_tokens * {_rate(0)} + cache_read_tokens * {_rate(1)} + cache_write_5m * {_rate(2)} + cache_write_1h * {_rate(3)}
  + CASE WHEN harness = 'codex' THEN 0.0::DOUBLE ELSE reasoning_tokens * {_rate(4)} END) * ({PRICE}) / 1e6 * 1e6) / 1e6"""


@query(f"SELECT session, count(*) AS turns, sum(CAST(round(usd * 1e6) AS BIGINT))::DOUBLE / 1e6 AS usd FROM (SELECT *, {USD} AS usd FROM turns) GROUP BY 1", "turns")
def turn_cost(spark, d):
    return analytics.costs(turns(spark, d), "session")


@query(f"SELECT model, harness, count(*) AS turns, sum(CAST(round(usd * 1e6) AS BIGINT))::DOUBLE / 1e6 AS usd FROM (SELECT *, {USD} AS usd FROM turns) GROUP BY 1, 2", "turns")
def model_cost(spark, d):
    return analytics.costs(turns(spark, d), "model", "harness")


@query(f"SELECT model AS model_id, avoided, round(avoided / 1e6::DOUBLE * ({PRICE}) * 1e6) / 1e6 AS usd FROM (SELECT {CANON} AS model, CAST(sum(avoided_tokens) AS BIGINT) AS avoided FROM obs GROUP BY 1)", "obs")
def avoided_usd(spark, d):
    return analytics.avoided_usd(observations(spark, d))


@query(""", p AS (SELECT *, lag(input_tokens) OVER (PARTITION BY session ORDER BY ts, turn_key, input_tokens) AS prev FROM turns),
  c AS (SELECT *, prev IS NULL OR input_tokens * 100 < prev * 85 AS cold FROM p)
  SELECT ts, turn_key, session, input_tokens, CASE WHEN cold THEN 0 ELSE least(prev, input_tokens) END AS "read", CASE WHEN cold THEN input_tokens ELSE greatest(input_tokens - prev, 0) END AS written FROM c""", "turns")
def inferred_cache(spark, d):
    return analytics.inferred_cache(turns(spark, d))


@query(f"""SELECT model_id, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(turns) AS BIGINT) AS turns FROM (
  SELECT {CANON} AS model_id, count(*) AS calls, 0 AS turns FROM obs WHERE model <> '' GROUP BY 1 UNION ALL SELECT {CANON}, 0, count(*) FROM turns GROUP BY 1) GROUP BY 1""", "obs turns")
def union_models(spark, d):
    return analytics.union_models(observations(spark, d), turns(spark, d))


WORDS = "regexp_extract_all(text, '[^ \\t\\n\\f\\r]+')"


@query(f"""SELECT doc_id, CAST(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(round(greatest(length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / 4.2::DOUBLE
  + (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) / 1.1::DOUBLE, len({WORDS}) * 1.3::DOUBLE)), 1) END AS BIGINT) AS tokens FROM documents""")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    return texts.exact_groups(table(spark, d, "documents"))


@query(f"SELECT sha256(array_to_string({WORDS}, ' ')) AS hash, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def normalized_dups(spark, d):
    return texts.exact_groups(table(spark, d, "documents"), normalize=True)


@query("""SELECT sha256(regexp_replace(text, '[0-9]+', '#', 'g')) AS hash, count(*) AS n, count(DISTINCT array_to_string(regexp_extract_all(text, '[0-9]+'), ',')) AS variants, min(doc_id) AS first_id
  FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT array_to_string(regexp_extract_all(text, '[0-9]+'), ',')) > 1""")
def digit_veto(spark, d):
    return texts.digit_variants(table(spark, d, "documents"))


@query("""WITH o AS (SELECT doc_id, source, list_distinct(string_split(coalesce(text, ''), chr(10))) AS own FROM documents),
  p AS (SELECT doc_id, lag(doc_id) OVER w AS prev_id, own, lag(own) OVER w AS prev FROM o WINDOW w AS (PARTITION BY source ORDER BY doc_id))
  SELECT doc_id, prev_id, len(own) AS n_lines, len(list_intersect(own, prev)) AS shared FROM p WHERE prev_id IS NOT NULL""")
def line_overlap_ratio(spark, d):
    return texts.line_overlap(table(spark, d, "documents"))


@query()
def simhash_pairs(spark, d):
    return texts.simhash_class_links(texts.simhash_trigrams(table(spark, d, "documents")))


@query()
def simhash_members(spark, d):
    return texts.simhash_members(texts.simhash_trigrams(table(spark, d, "documents")))


@query()
def cdc_reuse(spark, d):
    return texts.chunk_reuse(table(spark, d, "documents"))


TERMS_SQL = ", ".join(f"('{t}')" for t in TERMS)
HITS = f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM documents),
  h AS (SELECT doc_id, len(ts) AS len, q.term, len(list_filter(ts, lambda x: x = q.term)) AS tf FROM t, (VALUES {TERMS_SQL}) q(term)),
  hits AS (SELECT * FROM h WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM hits GROUP BY 1), s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)::DOUBLE) AS mean FROM t)"""


@query(f"""{HITS} SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) * 1e6) / 1e6 AS score
  FROM hits JOIN df USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 16""")
def bm25_search(spark, d):
    return texts.bm25(table(spark, d, "documents"), TERMS)


@query(f"""{HITS} SELECT doc_id, round(sum(tf::DOUBLE / len * greatest(ln((n + 1) / (df + 1)), 0)) * 1e9) / 1e9 AS score
  FROM hits JOIN df USING (term), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 16""")
def tfidf_rank(spark, d):
    return texts.tfidf(table(spark, d, "documents"), TERMS)


@query()
def tfidf_rank_containing(spark, d):
    return texts.tfidf_containing(table(spark, d, "documents"), TERMS)


@query("""SELECT doc_id, CAST(2 * contains(b, 'idiot')::INT + 2 * contains(b, 'the')::INT + 2 * contains(b, 'and')::INT + 3 * contains(b, 'menteau')::INT AS BIGINT) AS score
  FROM (SELECT doc_id, lower(coalesce(text, '')) AS b FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 16""")
def overlap_rank(spark, d):
    return texts.overlap(table(spark, d, "documents"), TERMS)


@query("SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(lower(x), 'fail|error|panic|exception'))) AS signals FROM documents WHERE signals > 0")
def signal_lines(spark, d):
    return texts.signal_counts(table(spark, d, "documents"))


@query("""SELECT doc_id, pos, length(line) AS size FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(line) DESC, pos) <= 3""")
def top_lines_per_doc(spark, d):
    return texts.top_lines(table(spark, d, "documents"))


@query()
def frames(spark, d):
    return texts.frames(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query()
def reduced_payloads(spark, d):
    return texts.reduce_payloads(table(spark, d, "documents"))


@query("""WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS name, CAST(o_orderkey % 900 AS BIGINT) AS first, CAST(o_orderkey % 900 + 5 + o_orderkey % 170 AS BIGINT) AS last FROM orders),
  h AS (SELECT DISTINCT user_id AS doc_id, event_id % 1000 AS line FROM events),
  b AS (SELECT h.doc_id, h.line, f.name FROM h JOIN f ON h.doc_id = f.doc_id AND h.line BETWEEN f.first AND f.last
        QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.line ORDER BY f.last - f.first, f.first, f.name) = 1)
  SELECT h.doc_id, h.line, b.name FROM h LEFT JOIN b USING (doc_id, line)""")
def enclosing_frames(spark, d):
    key = F.col("o_orderkey")
    spans = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("name"), (key % 900).alias("first"), (key % 900 + 5 + key % 170).alias("last"))
    hits = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 1000).alias("line")).distinct()
    return analytics.enclosing(hits, spans)
