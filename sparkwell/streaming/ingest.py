"""Event-at-a-time ingest: each event goes through the state of its session, and each micro-batch into several tables at once.

State for each session: harness, model, working directory, start and end, the one-shot flag to map pages again, and a timer on event
time for the idle spell. A micro-batch's rows go to the tables ``events``, ``observations``, ``blobs``, ``pages``,
``frames`` and ``sessions``, each in a folder for that batch; the batch counts from the moment its folder in ``commits``
is there. A replay after a crash overwrites the folders of its batch, and readers see whole batches only.

Events of a session arrive in their order; those later than ``late`` behind the newest are dropped. The rules are those
of operators.sessions, and so are the results, however events are dealt to files and files to micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from sparkwell.functions.columns import estimated_tokens
from sparkwell.operators import texts
from sparkwell.operators.sessions import TTL, TTL_HOUR, VAGUE
from sparkwell.streaming.remember import ROCKS

EVENT = "session string, seq long, at long, event string, harness string, model string, cwd string, keep boolean, hour_cache boolean, tool string, payload string"
STATE = "harness string, model string, cwd string, started_at long, ended_at long, remap boolean, events long, idle_at long, seq long"
OUT = "session string, seq long, at long, event string, greets boolean, tool string, payload string, harness string, model string, cwd string, started_at long, ended_at long, remap boolean, events long"
NAMES = [f.split()[0] for f in OUT.split(", ")]
KEPT = [f.split()[0] for f in STATE.split(", ")]
TABLES = ("events", "observations", "blobs", "pages", "frames", "sessions")
#: Events whose payload is stored.
PAYLOADS = ("tool.output", "file.read")


class Session(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def _idle(self, s: dict) -> dict:
        """The row of an idle spell; it is told once."""
        row = {"seq": s["seq"], "at": s["idle_at"], "event": "idle", "greets": False, "tool": None, "payload": None}
        s["idle_at"] = None
        return row | {k: s[k] for k in ("harness", "model", "cwd", "started_at", "ended_at", "remap", "events")}

    def _step(self, s: dict | None, e: dict) -> tuple[dict, dict]:
        s = s or dict.fromkeys(KEPT) | {"model": "", "remap": False, "events": 0, "started_at": e["at"]}
        event, model = e["event"] or "", e["model"] or ""
        greets = event == "session.start" or (event == "compact" and bool(e["keep"])) or (event == "prompt.submit" and s["remap"])
        if model and (model not in VAGUE or s["model"] in ("", *VAGUE)):
            s["model"] = model
        s |= {"harness": e["harness"] or "", "cwd": e["cwd"] if e["cwd"] is not None else s["cwd"], "events": s["events"] + 1, "seq": e["seq"]}
        s["remap"] = event == "compact" or (s["remap"] and event != "prompt.submit")
        s["ended_at"] = e["at"] if event == "session.end" else s["ended_at"]
        s["idle_at"] = None if event == "session.end" else e["at"] + (TTL_HOUR if e["hour_cache"] else TTL)
        row = {"seq": e["seq"], "at": e["at"], "event": event, "greets": greets, "tool": e["tool"], "payload": e["payload"]}
        return s, row | {k: s[k] for k in ("harness", "model", "cwd", "started_at", "ended_at", "remap", "events")}

    def _frame(self, key, rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=NAMES[1:])
        out.insert(0, "session", key[0])
        whole = {c: "Int64" for c in ("seq", "at", "started_at", "ended_at", "events")}
        return out.astype(whole | {"greets": "boolean", "remap": "boolean"})

    def _keep(self, s: dict) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if s["idle_at"] is not None:
            self.handle.registerTimer(s["idle_at"] * 1000)
        self.state.update(tuple(s[k] for k in KEPT))

    def _load(self) -> dict | None:
        return dict(zip(KEPT, self.state.get())) if self.state.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["at", "seq"])
        plain = some.astype(object).where(some.notna(), None).to_dict("records")
        s, out = self._load(), []
        for e in plain:
            if s and s["idle_at"] is not None and e["at"] > s["idle_at"]:
                out.append(self._idle(s))
            s, row = self._step(s, e)
            out.append(row)
        self._keep(s)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        if s and s["idle_at"] is not None:
            row = self._idle(s)
            self.state.update(tuple(s[k] for k in KEPT))
            yield self._frame(key, [row])

    def close(self) -> None:
        pass


def _committed(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame | None:
    """The rows of a table in whole batches, with their ``batch``; None before the first."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return None
    done = spark.read.schema("rows long, batch long").parquet(f"{folder}/commits").select("batch")
    return spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")


def put(batch: DataFrame, number: int, folder: str) -> None:
    """All tables of one micro-batch, then its commit; repeating it gives the same."""
    spark = batch.sparkSession

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}/batch={number}")

    rows = write(batch, "events")
    stored = rows.where(F.col("event").isin(*PAYLOADS)).withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("hash", F.sha2("payload", 256))
    uri = F.concat(F.coalesce("tool", F.lit("generic")), F.lit("/"), F.left("hash", F.lit(12)))
    tokens = estimated_tokens(F.col("payload"))
    write(stored.select("session", "seq", "at", uri.alias("uri"), "hash", tokens.alias("raw_tokens"), "model"), "observations")
    fresh = stored.where("payload <> ''").groupBy("hash").agg(F.first("payload").alias("payload"))
    known = _committed(spark, folder, "blobs")
    if known is not None:
        fresh = fresh.join(known.where(F.col("batch") < number).select("hash"), "hash", "left_anti")  # a replay must not see itself
    blobs = write(fresh, "blobs")
    pages = stored.groupBy(uri.alias("uri")).agg(F.max_by(F.struct("hash", tokens.alias("raw_tokens"), F.col("at").alias("created_at")), F.struct("at", "seq")).alias("p"))
    write(pages.select("uri", "p.*"), "pages")
    write(texts.frames(blobs.select(F.col("hash").alias("doc_id"), F.col("payload").alias("text"))).withColumnRenamed("doc_id", "hash"), "frames")
    place = F.struct("events", (F.col("event") == "idle").cast("int"))
    state = F.struct("harness", "model", "cwd", "started_at", "ended_at", "remap", "events")
    write(rows.groupBy("session").agg(F.max_by(state, place).alias("s")).select("session", "s.*"), "sessions")
    rows.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/commits/batch={number}")


def sync(spark: SparkSession, inbox: str, folder: str, late: str = "1 minute", files: int = 100) -> None:
    """Take in what is new in ``inbox`` (Parquet files of events), ``files`` of them at a time, and stop."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(inbox)
    timed = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    out = timed.groupBy("session").transformWithStateInPandas(Session(), OUT, "append", "eventtime")
    out.writeStream.foreachBatch(lambda batch, number: put(batch, number, folder)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table as of the last whole batch: pages and sessions as they now are, the others in all their rows."""
    rows = _committed(spark, folder, name)
    key = {"pages": "uri", "sessions": "session"}.get(name)
    if rows is None or key is None:
        return rows and rows.drop("batch")
    latest = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch"))))
    return latest.where("_r = 1").drop("_r", "batch")
