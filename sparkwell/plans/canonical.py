"""Queries over canonical forms and the epochs that they begin."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions.canonical import canonical, prefix_hash
from sparkwell.operators import dashboard
from sparkwell.plans.queries import query
from sparkwell.sources.model import observations, table


def prefixes(spark, d):
    """Observations with two parts of a prompt prefix: JSON whose keys come in either order with an id and a clock, and a text."""
    k, i = F.col("k").cast("string"), F.col("id")
    n = (F.col("k") % 3).cast("string")
    one = F.concat(F.lit('{"b": [1, {"now": 5, "x": "at 2026-01-05T10:00:'), F.lpad((i % 60).cast("string"), 2, "0"), F.lit('Z"}], "request_id": "r'), i.cast("string"), F.lit('", "a": "v'), n, F.lit('"}'))
    two = F.concat(F.lit('{"a":"v'), n, F.lit('","uuid":"'), k, F.lit('",\r\n"b":[1,{"x":"at 2026-02-05T10:00:00"}]}'))
    return observations(spark, d).select("*", F.when(i % 2 == 0, one).otherwise(two).alias("system"), F.concat(F.lit("run 0f8fad5b-d9cb-469f-a165-"), F.lpad(i.cast("string"), 12, "0"), F.lit(" now\r")).alias("tools"))


HASH = """sha256('{"a":"v' || k % 3 || '","b":[1,{"x":"at <ts>"}]}' || chr(10) || chr(30) || chr(10) || 'run <id> now' || chr(10))"""


@query(f"SELECT id, {HASH} AS prefix_hash FROM obs", "obs")
def prefix_hashes(spark, d):
    return prefixes(spark, d).select("id", prefix_hash(F.col("system"), F.col("tools")).alias("prefix_hash"))


@query(f"""SELECT session_id, epoch, min(created_at) AS started_at, count(*) AS n FROM (
  SELECT *, CAST(sum(new) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM (
    SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(model) OVER w IS NOT DISTINCT FROM model AND lag({HASH}) OVER w = {HASH} THEN 0 ELSE 1 END AS new FROM obs WINDOW w AS (PARTITION BY session_id ORDER BY created_at, id))) GROUP BY 1, 2""", "obs")
def prefix_epochs(spark, d):
    """A new epoch wherever a session's model or prompt prefix changes."""
    rows = prefixes(spark, d).withColumn("prefix", prefix_hash(F.col("system"), F.col("tools")))
    return dashboard.epochs(rows, "session_id", ["created_at", "id"], ["model", "prefix"])


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS props FROM events WHERE json_valid(props) AND json_extract_string(props, '$.k') IS NOT NULL""")
def canonical_props(spark, d):
    """The properties of events in their normal form."""
    return table(spark, d, "events").where("get_json_object(props, '$.k') IS NOT NULL").select("event_id", canonical(F.col("props")).alias("props"))
