"""Queries over task tokens and over what changed between versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions.tasks import MOST, RUN, STOP, task_tokens, token_overlap
from sparkwell.operators import deltas, texts
from sparkwell.plans.payloads import payloads
from sparkwell.plans.queries import query
from sparkwell.sources.model import table
from sparkwell.sources.stored import stored

#: (doc_id, tok, spot): the first task tokens of each text.
TOKENS_SQL = rf"""runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RUN}')) AS run, generate_subscripts(regexp_extract_all(text, '{RUN}'), 1) AS i FROM documents),
  parts AS (SELECT *, string_split(regexp_replace(regexp_replace(run, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ') AS pieces FROM runs),
  toks AS (SELECT doc_id, i, CASE WHEN NOT regexp_matches(run, '^[A-Za-z0-9]') THEN list_concat(CASE WHEN length(run) <= 6 THEN [run] ELSE [] END, list_transform(range(1, length(run)), lambda j: substr(run, j, 2)))
    WHEN len(pieces) > 1 THEN list_concat([lower(run)], list_filter(list_transform(pieces, lambda p: lower(p)), lambda p: length(p) >= 2)) ELSE [lower(run)] END AS t FROM parts),
  flat AS (SELECT doc_id, i, unnest(t) AS tok, generate_subscripts(t, 1) AS j FROM toks),
  firsts AS (SELECT doc_id, tok, min(i * 1000000 + j) AS spot FROM flat WHERE (length(tok) >= 3 OR (length(tok) = 2 AND NOT regexp_full_match(tok, '[\x00-\x7F]*')) OR regexp_full_match(tok, 'e[0-9]?')) AND tok NOT IN {STOP} GROUP BY 1, 2),
  top AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY spot) <= {MOST})"""


def tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", task_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, string_agg(tok, ' ' ORDER BY spot) AS tokens FROM top GROUP BY 1")
def text_task_tokens(spark, d):
    # A filter isn't moved before an explode, so tokens are worked out once, not for the filter again.
    named = tokens(spark, d).select("doc_id", F.explode(F.array("tokens")).alias("tokens"))
    return named.where(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {TOKENS_SQL}, p AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev_id FROM documents),
  hit AS (SELECT DISTINCT p.doc_id, prev_id, q.tok FROM p JOIN top q ON q.doc_id = p.doc_id JOIN top w ON w.doc_id = prev_id
    AND (w.tok = q.tok OR (length(w.tok) >= 2 AND length(q.tok) >= 2 AND (contains(w.tok, q.tok) OR contains(q.tok, w.tok)))))
  SELECT doc_id, prev_id, CAST(sum(CASE WHEN length(tok) <= 2 THEN 1 WHEN length(tok) <= 5 THEN 2 ELSE 3 END) AS BIGINT) AS score FROM hit GROUP BY 1, 2""")
def related_texts(spark, d):
    """How much each text's task tokens have in common with those of the text before it from the same source."""
    own = stored(tokens(spark, d), "task-tokens")  # read for both texts of a pair
    pairs = texts.previous_ids(table(spark, d, "documents")).join(own, "doc_id").join(own.select(F.col("doc_id").alias("prev_id"), F.col("tokens").alias("page")), "prev_id")
    return pairs.select("doc_id", "prev_id", token_overlap(F.col("page"), F.col("tokens")).cast("long").alias("score")).where("score > 0")


@query()
def payload_deltas(spark, d):
    """Line diffs of payloads against the one before of the same tool."""
    rows = payloads(spark, d)
    return deltas.line_deltas(rows, texts.previous_ids(rows.withColumnRenamed("tool_type", "source")))
