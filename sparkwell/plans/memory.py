"""Queries over what has been seen before."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions.columns import digit_runs, normalized_hash
from sparkwell.functions.excerpts import let
from sparkwell.operators import remember
from sparkwell.plans.payloads import PAYLOAD_SQL, payloads
from sparkwell.plans.queries import query
from sparkwell.sources.model import table


def payload_arrivals(spark, d):
    """Payloads in the order of their ids, some with spaces at the end; the simhash is made from columns, so that SQL has it too."""
    # All in one projection: a join of the payloads with their own observations would send one of the two whole to every task.
    simhash = F.shiftleft(F.col("k") % 7 + 1, 40) + F.expr("shiftleft(1L, cast(session_id % 5 as int))")
    rows = payloads(spark, d).select("doc_id", F.concat("text", F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int"))).alias("text"), simhash.alias("simhash"))
    keys = lambda t: F.struct(F.sha2(t, 256).alias("hash"), normalized_hash(t).alias("norm"), F.sha2(F.array_join(digit_runs(t), ","), 256).alias("digits"))
    return rows.select(F.col("doc_id").alias("at"), "simhash", let(F.col("text"), keys).alias("x")).select("at", "x.hash", "x.norm", "simhash", "x.digits")


@query(rf""", {PAYLOAD_SQL}, pt AS (SELECT obs.id AS "at", text || repeat(' ', CAST(obs.id % 3 AS INTEGER)) AS t, (obs.k % 7 + 1) * 1099511627776 + (1::BIGINT << (session_id % 5)) AS simhash FROM pay JOIN obs ON pay.doc_id = obs.id),
  arr AS (SELECT "at", sha256(t) AS hash, sha256(array_to_string(regexp_extract_all(t, '[^ \t\n\f\r]+'), ' ')) AS norm, simhash, sha256(array_to_string(regexp_extract_all(t, '[0-9]+'), ',')) AS digits FROM pt),
  e AS (SELECT *, min("at") OVER (PARTITION BY hash) AS h1, min("at") OVER (PARTITION BY norm) AS n1 FROM arr),
  near AS (SELECT p."at", x."at" AS match, bit_count(xor(p.simhash, x.simhash)) AS distance FROM e p JOIN e x ON p.digits = x.digits AND x."at" < p."at" AND bit_count(xor(p.simhash, x.simhash)) <= 3
    WHERE p."at" = p.n1 AND x."at" = x.h1 QUALIFY row_number() OVER (PARTITION BY p."at" ORDER BY distance, x."at") = 1),
  told AS (SELECT e."at", CASE WHEN e."at" <> h1 THEN 'exact' WHEN e."at" <> n1 THEN 'normalized' WHEN near."at" IS NOT NULL THEN 'near' ELSE 'new' END AS kind,
    CASE WHEN e."at" <> h1 THEN h1 WHEN e."at" <> n1 THEN n1 ELSE near.match END AS match, CASE WHEN e."at" = n1 THEN coalesce(distance, 0) ELSE 0 END AS distance FROM e LEFT JOIN near ON e."at" = near."at"),
  runs AS (SELECT "at", hash, row_number() OVER (PARTITION BY hash ORDER BY "at") AS nth FROM arr)
  SELECT told."at", kind, match, CASE WHEN match IS NULL THEN 1 ELSE 1 + coalesce((SELECT max(nth) FROM runs WHERE runs.hash = m.hash AND runs."at" < told."at"), 0) END AS count, CAST(distance AS INTEGER) AS distance
  FROM told LEFT JOIN arr m ON m."at" = told.match""", "obs")
def payloads_remembered(spark, d):
    return remember.remembered(payload_arrivals(spark, d))


@query()
def documents_remembered(spark, d):
    """Whole documents in the order of their ids, by their own simhashes."""
    return remember.remembered(remember.arrivals_of(table(spark, d, "documents").select("doc_id", "text")))
