"""The chain of look-ups of operators.remember as a stream: arrivals in files, state for each key, results that agree with the batch.

Two streams, one behind the other. The first keeps, for each normalized hash, its first payload and the hashes seen (exact and
normalized matches). What it can't place, with every payload new by its hash, goes to the second, which keeps the
simhashes of each key of operators.remember.near_keys and finds the nearest earlier one. Files arrive in the order
of ``at``; how arrivals are dealt to files and files to micro-batches makes no difference. A batch is
written to a folder of its own, which a replay after a crash overwrites.

State: an entry for each distinct hash, and 20 for each distinct pair of simhash and digits. It is never forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkwell.operators.remember import RADIUS, concluded, near_keys

ARRIVAL = "at long, hash string, norm string, simhash long, digits string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACED = ARRIVAL + ", kind string, match long, entry boolean"


class Placing(StatefulProcessor):
    """For one normalized hash: its first arrival, and the first arrival of each of its hashes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "at long")
        self.hashes = handle.getMapState("hashes", "hash string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["at", "hash"], ignore_index=True)
        out = []
        for at, hash_ in zip(some["at"].tolist(), some["hash"].tolist()):
            name = (hash_ or "",)
            if self.hashes.containsKey(name):
                out.append(("exact", self.hashes.getValue(name)[0], False))
                continue
            self.hashes.updateValue(name, (at,))
            if self.first.exists():
                out.append(("normalized", self.first.get()[0], True))
            else:
                self.first.update((at,))
                out.append(("open", None, True))
        some["kind"], match, some["entry"] = zip(*out)
        some["match"] = pd.array(match, "Int64")
        yield some[[f.split()[0] for f in PLACED.split(", ")]]

    def close(self) -> None:
        pass


class Nearing(StatefulProcessor):
    """For one key of near_keys and one set of digits: the first arrival of each simhash."""

    def __init__(self, radius: int):
        self.radius = radius

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "simhash long", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values("at")
        known = {int(k[0]): int(v[0]) for k, v in self.seen.iterator()}
        found = []
        for at, simhash, asks in zip(some["at"].tolist(), some["simhash"].tolist(), some["asks"].tolist()):
            near = [((simhash ^ other) & (2**64 - 1)).bit_count() for other in known] if asks else []
            best = min(((d, first) for d, first in zip(near, known.values()) if d <= self.radius), default=None)
            if best:
                found.append((at, best[1], best[0]))
            if simhash not in known:
                known[simhash] = at
                self.seen.updateValue((simhash,), (at,))
        yield pd.DataFrame(found, columns=["at", "match", "distance"]).astype({"at": "int64", "match": "int64", "distance": "int32"})

    def close(self) -> None:
        pass


def _run(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Write each micro-batch to ``path``/batch=<its number>, replacing what a broken run left there, until nothing new is there."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sync(spark: SparkSession, inbox: str, folder: str, files: int = 100, radius: int = RADIUS) -> None:
    """Take in what is new in ``inbox`` (Parquet files of arrivals), ``files`` of them at a time, and stop. ``folder`` holds state and results."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    arrivals = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files).parquet(inbox)
    placed = arrivals.withColumn("_norm", F.coalesce("norm", F.lit(""))).groupBy("_norm").transformWithStateInPandas(Placing(), PLACED, "append", "none")
    _run(placed, f"{folder}/placed", f"{folder}/placed-state")
    entries = spark.readStream.schema(PLACED + ", batch int").parquet(f"{folder}/placed").where("entry AND simhash <> 0")
    keyed = entries.select("at", "simhash", "digits", (F.col("kind") == "open").alias("asks"), near_keys(F.col("simhash")))
    near = keyed.groupBy("digits", "choice", "value").transformWithStateInPandas(Nearing(radius), "at long, match long, distance int", "append", "none")
    _run(near, f"{folder}/near", f"{folder}/near-state")


def outcome(spark: SparkSession, folder: str) -> DataFrame:
    """(at, kind, match, count, distance) of all arrivals taken in so far."""
    placed = spark.read.schema(PLACED + ", batch int").parquet(f"{folder}/placed").drop("batch")
    near = spark.read.schema("at long, match long, distance int, batch int").parquet(f"{folder}/near")
    best = near.groupBy("at").agg(F.min(F.struct("distance", "match")).alias("m")).select("at", "m.match", "m.distance")
    return concluded(placed, best)
