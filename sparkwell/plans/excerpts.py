"""Queries over budgeted excerpts: guards, previews, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions import excerpts as X
from sparkwell.operators import guards
from sparkwell.plans.payloads import PAYLOAD_SQL, payloads
from sparkwell.plans.queries import query
from sparkwell.sources.model import observations, table


def tokens_sql(x: str, ascii_: float = 3.9, other: float = 1.1) -> str:
    """The token estimate of a text column."""
    plain = f"length(regexp_replace({x}, '[^\\x00-\\x7F]', '', 'g'))"
    words = f"len(regexp_extract_all({x}, '[^ \\t\\n\\f\\r]+'))"
    by = f"greatest({plain} / {ascii_}::DOUBLE + (length({x}) - {plain}) / {other}::DOUBLE, {words} * 1.3::DOUBLE)"
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE CAST(greatest(round({by}), 1) AS BIGINT) END)"


DIAGNOSTIC = X.DIAGNOSTIC_LINE.replace("'", "''")
LINES = r"CASE WHEN t = '' THEN [] ELSE list_transform(string_split(regexp_replace(t, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) END"
IS_DIAGNOSTIC = rf"regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '{DIAGNOSTIC}')"
SHOWN = "array_to_string(list_transform(kept, lambda i, j: CASE WHEN j > 1 AND i > kept[j - 1] + 1 THEN '…' || chr(10) ELSE '' END || ls[i + 1] || chr(10)), '')"
#: Texts with their kind of text, tokens and cap.
CAPPED_SQL = f"""s AS (SELECT doc_id, coalesce(text, '') AS t, left(coalesce(text, ''), 4000) AS h, lang, source FROM documents),
  kd AS (SELECT *, CASE WHEN length(h) > 0 AND (length(h) - length(regexp_replace(h, '[^\\x00-\\x7F]', '', 'g'))) * 100 >= length(h) * 20 THEN 'cjk' WHEN regexp_matches(h, '^[ \\t\\n\\r]*[{{\\[]') AND contains(h, ':') THEN 'json'
    WHEN length(h) > 80 AND (length(h) - length(regexp_replace(h, '[A-Za-z0-9+/=]', '', 'g'))) * 100 // length(h) > 92 THEN 'binary' ELSE 'prose' END AS kind FROM s),
  rw AS (SELECT *, CASE kind WHEN 'cjk' THEN {tokens_sql("t", 3.8, 0.9)} WHEN 'json' THEN {tokens_sql("t", 2.9)} WHEN 'binary' THEN {tokens_sql("t", 3.0)} ELSE {tokens_sql("t", 4.2)} END AS raw,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), 'fail|error|panic|exception'))) AS sig FROM kd),
  cp AS (SELECT * REPLACE (regexp_replace(t, '{guards.CONTROL}', '', 'g') AS t), CAST(least(greatest(least(greatest(raw * 15 // 100, 180), 512) + least(sig, 12) * 10, 160), 640) AS BIGINT) AS cap FROM rw WHERE raw >= {guards.GENERIC_LEAST})"""


def tasked(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", F.lit("generic").alias("tool"), F.array(F.coalesce("lang", F.lit("")), F.lit("ION")).alias("task"))


@query(f"""WITH {CAPPED_SQL}, ln AS (SELECT *, {LINES} AS ls, [coalesce(lang, ''), 'ion'] AS task FROM cp),
  pt AS (SELECT *, list_sort(list_transform(ls, lambda x, i: {{'p': -(CASE WHEN {IS_DIAGNOSTIC} THEN 24 ELSE 0 END + 8 * len(list_filter(task, lambda w: w <> '' AND contains(lower(x), w)))
    + CASE WHEN i <= 8 OR i + 8 > len(ls) THEN 2 ELSE 0 END + CASE WHEN contains(x, '^^^') OR contains(x, '-----') THEN 6 ELSE 0 END), 'i': i - 1, 'c': {tokens_sql("x")} + 1}})) AS ranked FROM ln),
  ft AS (SELECT *, list_sort(list_reduce(ranked, lambda had, x: CASE WHEN CASE WHEN x.p <= -24 THEN had.used + x.c <= greatest(cap, 80) OR len(had.kept) = 0 ELSE had.used + x.c <= greatest(cap, 80) AND (x.p < 0 OR len(had.kept) = 0) END
    THEN {{'used': had.used + x.c, 'kept': list_append(had.kept, x.i)}} ELSE had END, {{'used': 0::BIGINT, 'kept': []::BIGINT[]}}).kept) AS kept FROM pt),
  ex AS (SELECT doc_id, raw, cap, CASE WHEN len(ls) <= 40 THEN t ELSE len(kept) || '/' || len(ls) || ' lines' || chr(10) || chr(10) || {SHOWN} END AS text FROM ft)
  SELECT * FROM (SELECT *, {tokens_sql("text")} AS delivered FROM ex) WHERE delivered + {guards.GENERIC_GAIN} < raw""")
def generic_excerpts(spark, d):
    """Long documents cut to the lines that their budget buys."""
    return guards.generic_guard(tasked(spark, d))


@query(f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), ln AS (SELECT *, {LINES} AS ls FROM s),
  k AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(range(len(ls)), lambda i: i < 12 OR i >= len(ls) - 16), (list_filter(list_transform(ls, lambda x, i: CASE WHEN {IS_DIAGNOSTIC} THEN i - 1 END), lambda i: i IS NOT NULL))[1:8]))) AS kept FROM ln)
  SELECT doc_id, len(kept) AS n_kept, CASE WHEN len(ls) <= 40 THEN t ELSE len(kept) || '/' || len(ls) || ' lines' || chr(10) || chr(10) || {SHOWN} END AS text FROM k""")
def diagnostic_previews(spark, d):
    """Head, tail and first diagnostics of each document of more than 40 lines; shorter ones whole."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", text.alias("t"), X.lines_of(text).alias("ls"))
    rows = rows.withColumn("kept", X.previewed_lines(F.col("ls"), 8))
    return rows.select("doc_id", F.size("kept").cast("long").alias("n_kept"), X.preview(F.col("ls"), F.col("kept"), F.col("t"), 40).alias("text"))


@query(f"""WITH s AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), ln AS (SELECT *, {LINES} AS ls FROM s),
  h AS (SELECT *, CASE WHEN regexp_replace(coalesce(ls[1], ''), '\\s+$', '') = '' THEN '' ELSE regexp_replace(ls[1], '\\s+$', '') || chr(10) END AS head FROM ln),
  f AS (SELECT doc_id, list_reduce(list_transform(ls[2:], lambda x: regexp_replace(x, '\\s+$', '')), lambda had, x: CASE WHEN had.full_ OR x = '' THEN had
    WHEN had.used + {tokens_sql("x")} + 1 > 120 THEN {{'text': had.text, 'used': had.used, 'full_': true}} ELSE {{'text': had.text || x || chr(10), 'used': had.used + {tokens_sql("x")} + 1, 'full_': false}} END,
    {{'text': head, 'used': {tokens_sql("head")}::BIGINT, 'full_': {tokens_sql("head")} >= 120}}).text AS text FROM h)
  SELECT doc_id, text FROM f""")
def locked_fills(spark, d):
    """Each document's first line whole, and those after it as long as 120 tokens last."""
    lines = X.lines_of(F.coalesce(F.col("text"), F.lit("")))
    rows = table(spark, d, "documents").select("doc_id", lines.alias("ls"))
    rest = F.when(F.size("ls") > 1, F.slice("ls", F.lit(2), F.size("ls"))).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", X.lock_fill(F.get("ls", F.lit(0)), rest, F.lit(120)).alias("text"))


@query("""SELECT r.id, session_id, r.used FROM (SELECT session_id, unnest(list_reduce(list({'id': id, 'c': delivered_tokens} ORDER BY created_at DESC, id DESC), lambda had, x: CASE WHEN had.used + x.c <= 4000
    THEN {'used': CAST(had.used + x.c AS BIGINT), 'out': list_append(had.out, {'id': x.id, 'used': CAST(had.used + x.c AS BIGINT)})} ELSE had END, {'used': 0::BIGINT, 'out': []::STRUCT(id BIGINT, used BIGINT)[]}).out) AS r FROM obs GROUP BY session_id)""", "obs")
def budget_fill_skipping(spark, d):
    """The newest calls of each session that a budget buys; what is too dear is passed over and later ones may fit."""
    rows = observations(spark, d).select("id", "session_id", "delivered_tokens", (-F.col("created_at")).alias("age"), (-F.col("id")).alias("tie"))
    return guards.filled(rows, "session_id", ["age", "tie"], "delivered_tokens", 4000).select("id", "session_id", "used")


@query(f""", {PAYLOAD_SQL}, t AS (SELECT pay.doc_id, text, k, 'run ' || tool_type AS command, CASE k % 4 WHEN 0 THEN NULL ELSE k % 4 - 1 END AS code, CASE k % 3 WHEN 0 THEN 'cargo test' WHEN 1 THEN 'search' ELSE 'generic' END AS kind, CASE k % 3
    WHEN 0 THEN 'running ' || (k % 30 + 10) || ' tests' || chr(10) || 'test result: FAILED. ' || (k % 30 + 10) || ' passed; 1 failed' || chr(10) || '---- ' || tool_type || '::bad stdout ----' || chr(10) || 'thread panicked at src/' || tool_type || '.rs:' || k || chr(10) || '  left: 401' || chr(10) || ' right: 200' || chr(10)
    WHEN 1 THEN (k % 30 + 10) || ' hits in 1 files' || chr(10) || 'src/' || tool_type || '.rs' || chr(10) || '  1: let x = 1;' || chr(10) || '  2: let x = 1;' || chr(10) || '  3: let x = 1;' || chr(10) || '  4: let x = 1;' || chr(10) || '  … ' || (k % 30 + 6) || ' more'
    ELSE text END AS body FROM pay JOIN obs ON pay.doc_id = obs.id),
  h AS (SELECT *, {tokens_sql("text")} AS raw, '$ ' || command || chr(10) || coalesce('exit ' || code || chr(10), '') || chr(10) || body AS out FROM t)
  SELECT doc_id, kind, raw, {tokens_sql("out")} AS delivered, out AS text FROM h WHERE raw >= {guards.SHELL_LEAST} AND {tokens_sql("out")} + {guards.SHELL_GAIN} < raw""", "obs")
def shell_guarded(spark, d):
    """Payloads that their tool's reduced form replaces."""
    code = F.when(F.col("k") % 4 != 0, F.col("k") % 4 - 1)
    rows = payloads(spark, d).withColumn("exit_code", code)
    return guards.shell_guard(rows.withColumn("command", F.concat(F.lit("run "), F.col("tool_type"))))
