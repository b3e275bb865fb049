"""Queries over symbols, frames and recipes between versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.operators import deltas, symbols, texts
from sparkwell.plans.payloads import payloads
from sparkwell.plans.queries import query
from sparkwell.sources.model import observations


def sources(spark, d):
    """(doc_id, text): a source text with braces in strings and comments for each observation."""
    k, tool = F.col("k"), F.col("tool_type")
    body = F.array_join(F.transform(F.sequence(F.lit(1), (k % 5 + 1).cast("int")), lambda i: F.concat(F.lit('    call("}", '), i.cast("string"), F.lit("); // }\n"))), "")
    text = F.concat(F.lit("pub fn "), tool, F.lit("_"), k.cast("string"), F.lit("(x: u32) {\n"), body, F.lit("}\nfree;\npub(crate) fn tiny_"), F.col("id").cast("string"), F.lit("() -> u8 { 1 }\nclass Big {\n  function inner()\n  {\n  }\n}\n"))
    return observations(spark, d).select(F.col("id").alias("doc_id"), text.alias("text"))


@query(""", s AS (SELECT id, k % 5 + 1 AS n, [{'name': tool_type || '_' || k, 'keyword': 'fn', 'first': 1, 'last': 2 + (k % 5 + 1), 'signature': 'pub fn ' || tool_type || '_' || k || '(x: u32)'},
    {'name': 'tiny_' || id, 'keyword': 'fn', 'first': 4 + (k % 5 + 1), 'last': 4 + (k % 5 + 1), 'signature': 'pub(crate) fn tiny_' || id || '() -> u8'},
    {'name': 'Big', 'keyword': 'class', 'first': 5 + (k % 5 + 1), 'last': 9 + (k % 5 + 1), 'signature': 'class Big'},
    {'name': 'inner', 'keyword': 'function', 'first': 6 + (k % 5 + 1), 'last': 8 + (k % 5 + 1), 'signature': 'function inner()'}] AS l FROM obs)
  SELECT id AS doc_id, x.name, x.keyword, CAST(x.first AS BIGINT) AS first, CAST(x.last AS BIGINT) AS last, x.signature FROM (SELECT id, unnest(l) AS x FROM s)""", "obs")
def source_symbols(spark, d):
    return symbols.symbols(sources(spark, d))


@query(""", f AS (SELECT session_id AS doc_id, tool_type AS name, CASE WHEN k % 2 = 0 THEN 'fail' ELSE 'error' END AS kind, id % 1000 AS first, id % 1000 + k % 7 AS last, CASE WHEN k % 3 = 0 THEN '' ELSE 'h' || id END AS hint FROM obs),
  g AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY doc_id, name, kind ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 THEN 0 ELSE 1 END AS fresh FROM f),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, name, kind ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM g)
  SELECT doc_id, name, kind, min(first) AS first, max(last) AS last FROM r GROUP BY doc_id, name, kind, run""", "obs")
def frames_merged(spark, d):
    k, i = F.col("k"), F.col("id")
    rows = observations(spark, d).select(F.col("session_id").alias("doc_id"), F.col("tool_type").alias("name"), F.when(k % 2 == 0, "fail").otherwise("error").alias("kind"), (i % 1000).alias("first"), (i % 1000 + k % 7).alias("last"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("h"), i.cast("string"))).alias("hint"))
    return symbols.merged_frames(rows).drop("hint")


@query()
def payload_recipes(spark, d):
    """Payloads told by what they keep of the one before of the same tool."""
    rows = payloads(spark, d)
    return deltas.version_deltas(rows, texts.previous_ids(rows.withColumnRenamed("tool_type", "source")), file=False)
