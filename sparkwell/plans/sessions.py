"""Queries over sessions and their events."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.operators import sessions
from sparkwell.plans.queries import NOW, query
from sparkwell.sources.model import observations

#: Time runs 20 times as fast, so that some events come before the idle limit and some after.
UNTIL = NOW // 20
EVENT_SQL = """sev AS (SELECT session_id AS session, id AS seq, created_at // 20 AS "at", CASE k % 10 WHEN 0 THEN 'session.start' WHEN 1 THEN 'session.end' WHEN 2 THEN 'prompt.submit' WHEN 3 THEN 'prompt.submit' WHEN 4 THEN 'compact'
    WHEN 5 THEN 'file.read' ELSE 'tool.output' END AS event, CASE WHEN k % 9 = 0 THEN 'cursor' ELSE 'claude' END AS harness, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'default' WHEN 2 THEN 'gpt-5' WHEN 3 THEN 'auto' ELSE 'grok-4.5' END AS model,
    CASE WHEN k % 4 = 0 THEN '/w/' || k END AS cwd, k % 3 = 0 AS keep, k % 8 = 0 AS hour_cache FROM obs)"""


def session_input(spark, d):
    k = F.col("k")
    event = F.when(k % 10 == 0, "session.start").when(k % 10 == 1, "session.end").when((k % 10).isin(2, 3), "prompt.submit").when(k % 10 == 4, "compact").when(k % 10 == 5, "file.read").otherwise("tool.output")
    model = F.when(k % 5 == 0, "").when(k % 5 == 1, "default").when(k % 5 == 2, "gpt-5").when(k % 5 == 3, "auto").otherwise("grok-4.5")
    return observations(spark, d).select(
        F.col("session_id").alias("session"), F.col("id").alias("seq"), F.expr("created_at div 20").alias("at"), event.alias("event"), F.when(k % 9 == 0, "cursor").otherwise("claude").alias("harness"),
        model.alias("model"), F.when(k % 4 == 0, F.concat(F.lit("/w/"), k.cast("string"))).alias("cwd"), (k % 3 == 0).alias("keep"), (k % 8 == 0).alias("hour_cache"),
    )


@query(f""", {EVENT_SQL}, n AS (SELECT *, lead("at") OVER w AS next_at, "at" + CASE WHEN hour_cache THEN 3300 ELSE 270 END AS lost,
    coalesce(max(CASE WHEN event = 'compact' THEN ("at", seq) END) OVER b > coalesce(max(CASE WHEN event = 'prompt.submit' THEN ("at", seq) END) OVER b, (-1::BIGINT, -1::BIGINT)), false) AS remap,
    coalesce(last_value(CASE WHEN model NOT IN ('', 'default', 'auto') THEN model END IGNORE NULLS) OVER u, last_value(nullif(model, '') IGNORE NULLS) OVER u, '') AS named
    FROM sev WINDOW w AS (PARTITION BY session ORDER BY "at", seq), b AS (PARTITION BY session ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), u AS (PARTITION BY session ORDER BY "at", seq ROWS UNBOUNDED PRECEDING))
  SELECT session, seq, "at", event, event = 'session.start' OR (event = 'compact' AND keep) OR (event = 'prompt.submit' AND remap) AS greets, named AS model FROM n
  UNION ALL SELECT session, seq, lost, 'idle', false, named FROM n WHERE event <> 'session.end' AND coalesce(next_at, {UNTIL}) > lost""", "obs")
def session_timeline(spark, d):
    return sessions.timeline(session_input(spark, d), UNTIL)


@query(f""", {EVENT_SQL} SELECT session, arg_max(harness, ("at", seq)) AS harness, coalesce(arg_max(model, ("at", seq)) FILTER (model NOT IN ('', 'default', 'auto')), arg_max(model, ("at", seq)) FILTER (model IN ('default', 'auto')), '') AS model,
  arg_max(cwd, ("at", seq)) FILTER (cwd IS NOT NULL) AS cwd, min("at") AS started_at, max("at") FILTER (event = 'session.end') AS ended_at, count(*) AS events,
  coalesce(max(("at", seq)) FILTER (event = 'compact') > coalesce(max(("at", seq)) FILTER (event = 'prompt.submit'), (-1::BIGINT, -1::BIGINT)), false) AS remap FROM sev GROUP BY 1""", "obs")
def session_states(spark, d):
    return sessions.states(session_input(spark, d))
