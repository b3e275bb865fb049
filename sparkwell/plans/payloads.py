"""Queries over payload texts: logs made from events, reduced by tool."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwell.operators import reducers, texts
from sparkwell.plans.queries import query
from sparkwell.sources.model import observations


def repeated(line: Column, n: Column) -> Column:
    """``line`` n times, with %d as the number of the line."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.replace(line, F.lit("%d"), i.cast("string"))), "\n")


def payloads(spark, d):
    """(doc_id, command, text): a test run, a search or plain output for each observation."""
    k, name = F.col("k"), F.col("tool_type")
    n = (k % 30 + 10).cast("int")
    ok = F.concat(F.lit("test "), name, F.lit("::case_%d ... ok"))
    failure = F.concat(F.lit("\n---- "), name, F.lit("::bad stdout ----\nthread panicked at src/"), name, F.lit(".rs:"), k.cast("string"), F.lit("\n  left: 401\n right: 200\n\nfailures:\n"))
    test = F.concat(F.lit("running "), n.cast("string"), F.lit(" tests\n"), repeated(ok, n), failure, F.lit("test result: FAILED. "), n.cast("string"), F.lit(" passed; 1 failed"))
    hits = repeated(F.concat(F.lit("src/"), name, F.lit(".rs:%d:let x = 1;")), n)
    text = F.when(k % 3 == 0, test).when(k % 3 == 1, hits).otherwise(repeated(F.lit("plain output %d"), n))
    # Rows of a few bytes become payloads of hundreds, so they are dealt to all tasks first: a small file is read by one or two.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = observations(spark, d).select("id", "k", "tool_type", "session_id").repartition(parts, "id")
    return rows.select(F.col("id").alias("doc_id"), F.lit("").alias("command"), text.alias("text"), "k", "tool_type", "session_id")


@query("""SELECT id AS doc_id, CASE k % 3 WHEN 0 THEN 'cargo test' WHEN 1 THEN 'search' ELSE 'generic' END AS kind, CASE k % 3
  WHEN 0 THEN 'running ' || (k % 30 + 10) || ' tests' || chr(10) || 'test result: FAILED. ' || (k % 30 + 10) || ' passed; 1 failed' || chr(10) || '---- ' || tool_type || '::bad stdout ----' || chr(10) || 'thread panicked at src/' || tool_type || '.rs:' || k || chr(10) || '  left: 401' || chr(10) || ' right: 200' || chr(10)
  WHEN 1 THEN (k % 30 + 10) || ' hits in 1 files' || chr(10) || 'src/' || tool_type || '.rs' || chr(10) || '  1: let x = 1;' || chr(10) || '  2: let x = 1;' || chr(10) || '  3: let x = 1;' || chr(10) || '  4: let x = 1;' || chr(10) || '  … ' || (k % 30 + 6) || ' more'
  ELSE list_aggregate(list_transform(range(1, k % 30 + 11), lambda i: 'plain output ' || i), 'string_agg', chr(10)) END AS reduced FROM obs""", "obs")
def tool_payloads(spark, d):
    return reducers.reduce_by_tool(payloads(spark, d))


@query("""SELECT id AS doc_id, CASE WHEN k % 5 = 0 THEN 'guard' WHEN (k % 7) * 40 - raw_tokens // 4 >= 40 - raw_tokens // 8 THEN 'ranked' ELSE 'plain' END AS name FROM obs
  WHERE raw_tokens - CASE WHEN k % 5 = 0 THEN raw_tokens // 2 WHEN (k % 7) * 40 - raw_tokens // 4 >= 40 - raw_tokens // 8 THEN raw_tokens // 4 ELSE raw_tokens // 8 END > 40""", "obs")
def best_reducers(spark, d):
    raw = F.col("raw_tokens")
    part = lambda n: F.floor(raw / n)
    one = lambda name, pos, terminal, signal, delivered: F.struct(F.lit(name).alias("name"), F.lit(pos).alias("pos"), terminal.alias("terminal"), signal.cast("long").alias("signal"), delivered.cast("long").alias("delivered"))
    found = F.array(one("guard", 0, F.lit(True), F.lit(0), part(2)), one("ranked", 1, F.lit(False), F.col("k") % 7, part(4)), one("plain", 2, F.lit(False), F.lit(1), part(8)))
    rows = observations(spark, d).select(F.col("id").alias("doc_id"), raw.alias("raw"), F.inline(F.when(F.col("k") % 5 == 0, found).otherwise(F.slice(found, 2, 2))))
    return reducers.best_result(rows)


#: The same payloads in SQL.
PAYLOAD_SQL = """pay AS (SELECT id AS doc_id, CASE k % 3
  WHEN 0 THEN 'running ' || n || ' tests' || chr(10) || list_aggregate(list_transform(range(1, n + 1), lambda i: 'test ' || tool_type || '::case_' || i || ' ... ok'), 'string_agg', chr(10))
    || chr(10) || '---- ' || tool_type || '::bad stdout ----' || chr(10) || 'thread panicked at src/' || tool_type || '.rs:' || k || chr(10) || '  left: 401' || chr(10) || ' right: 200' || chr(10) || chr(10) || 'failures:' || chr(10) || 'test result: FAILED. ' || n || ' passed; 1 failed'
  WHEN 1 THEN list_aggregate(list_transform(range(1, n + 1), lambda i: 'src/' || tool_type || '.rs:' || i || ':let x = 1;'), 'string_agg', chr(10))
  ELSE list_aggregate(list_transform(range(1, n + 1), lambda i: 'plain output ' || i), 'string_agg', chr(10)) END AS text FROM (SELECT *, k % 30 + 10 AS n FROM obs))"""


@query(f", {PAYLOAD_SQL} SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(lower(x), 'fail|error|panic|exception'))) AS BIGINT) AS signals FROM pay WHERE regexp_matches(lower(text), 'fail|error|panic|exception')", "obs")
def payload_signals(spark, d):
    return texts.signal_counts(payloads(spark, d))


@query(f""", {PAYLOAD_SQL} SELECT sha256(regexp_replace(text, '[0-9]+', '#', 'g')) AS hash, count(*) AS n, count(DISTINCT array_to_string(regexp_extract_all(text, '[0-9]+'), ',')) AS variants, min(doc_id) AS first_id
  FROM pay GROUP BY 1 HAVING count(DISTINCT array_to_string(regexp_extract_all(text, '[0-9]+'), ',')) > 1""", "obs")
def payload_digit_variants(spark, d):
    return texts.digit_variants(payloads(spark, d))


@query(None)
def payload_frames(spark, d):
    return texts.frames(payloads(spark, d))
