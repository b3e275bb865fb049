"""Sessions from their events: what each event finds and leaves, idle spells, and the table of sessions.

Events are rows (``session``, ``seq``, ``at`` in seconds, ``event``, ``harness``, ``model``, ``cwd``, ``keep``, ``hour_cache``); an
event of a session comes after another by (at, seq). As in streaming.ingest, which keeps the same by key:

* ``greets``: the mapped pages are shown at a session's start, at a compaction with ``keep``, and once at the first prompt after a
  compaction.
* ``model``: the last that names one; ``default`` and ``auto`` count only as long as none did, an empty one never.
* an ``idle`` row is put ``TTL`` seconds after an event that no other follows by then (``TTL_HOUR`` if it left an hour's cache); none
  after a session's end.

Defined cases: null events, models and harnesses are empty; a null ``keep`` or ``hour_cache`` is false; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds until a cached prefix is lost, and if it is kept for an hour.
TTL, TTL_HOUR = 270, 3300
VAGUE = ("default", "auto")


def clean(events: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return events.select("session", "seq", "at", text("event"), text("harness"), text("model"), "cwd", flag("keep"), flag("hour_cache"))


def timeline(events: DataFrame, now: int) -> DataFrame:
    """(session, seq, at, event, greets, model): all events and, up to ``now``, the idle rows between and after them (with the seq of the event before)."""
    rows = clean(events)
    w = Window.partitionBy("session").orderBy("at", "seq")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_n", F.row_number().over(w))
    last = lambda event: F.coalesce(F.max(F.when(F.col("event") == event, F.col("_n"))).over(before), F.lit(0))
    remap = last("compact") > last("prompt.submit")
    greets = (F.col("event") == "session.start") | ((F.col("event") == "compact") & F.col("keep")) | ((F.col("event") == "prompt.submit") & remap)
    named = lambda ok: F.last(F.when(ok, F.col("model")), ignorenulls=True).over(so_far)
    model = F.coalesce(named(~F.col("model").isin("", *VAGUE)), named(F.col("model").isin(*VAGUE)), F.lit(""))
    lost = F.col("at") + F.when(F.col("hour_cache"), TTL_HOUR).otherwise(TTL)
    idle = (F.col("event") != "session.end") & (F.coalesce(F.lead("at").over(w), F.lit(now)) > lost)
    told = rows.select("session", "seq", "at", "event", greets.alias("greets"), model.alias("model"), F.when(idle, lost).alias("_idle"))
    spells = told.where("_idle IS NOT NULL").select("session", "seq", F.col("_idle").alias("at"), F.lit("idle").alias("event"), F.lit(False).alias("greets"), "model")
    return told.drop("_idle").unionByName(spells)


def states(events: DataFrame) -> DataFrame:
    """(session, harness, model, cwd, started_at, ended_at, remap, events): the table of sessions after all events.

    One pass of aggregates that combine before the shuffle; no window over a session's events.
    """
    place = F.struct("at", "seq")
    last = lambda value, ok=F.lit(True): F.max_by(value, F.when(ok, place))
    at_last = lambda event: F.max(F.when(F.col("event") == event, place))
    named = ~F.col("model").isin("", *VAGUE)
    model = F.coalesce(last(F.col("model"), named), last(F.col("model"), F.col("model").isin(*VAGUE)), F.lit(""))
    remap = F.when(F.col("_compact").isNull(), False).otherwise(F.col("_prompt").isNull() | (F.col("_compact") > F.col("_prompt")))
    by = clean(events).groupBy("session").agg(
        last(F.col("harness")).alias("harness"),
        model.alias("model"),
        last(F.col("cwd"), F.col("cwd").isNotNull()).alias("cwd"),
        F.min("at").alias("started_at"),
        F.max(F.when(F.col("event") == "session.end", F.col("at"))).alias("ended_at"),
        at_last("compact").alias("_compact"),
        at_last("prompt.submit").alias("_prompt"),
        F.count("*").alias("events"),
    )
    return by.select("session", "harness", "model", "cwd", "started_at", "ended_at", remap.alias("remap"), "events")


