"""Event-at-a-time ingest: the stream against the batch, in any split into files, and after a crash."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkwell.operators import sessions
from sparkwell.streaming import ingest

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State is kept for each partition; two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


KINDS = ["session.start", "session.end", "prompt.submit", "prompt.submit", "compact", "tool.output", "file.read", "tool.input", None]


def events(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    at, out = 1_700_000_000, []
    for seq in range(n):
        at += rng.choice([0, 1, 30, 100, 200])
        kind = rng.choice(KINDS)
        payload = rng.choice([None, "", "def f():\n    return 1\n", f"error: case {rng.randrange(4)} failed\n" * 3]) if kind in ingest.PAYLOADS else None
        out.append((f"s{rng.randrange(4)}", seq, at, kind, rng.choice(["claude", "cursor", None]), rng.choice(["", None, "default", "auto", "gpt-5", "grok-4.5"]), rng.choice([None, "/a", "/b"]), rng.choice([True, False, None]), rng.random() < 0.2, "shell", payload))
    return out


def told(rows) -> list[tuple]:
    return sorted(tuple(r[c] for c in ("session", "seq", "at", "event", "greets", "model")) for r in rows.collect())


def agree(spark, folder: str, rows: list[tuple], late: int) -> None:
    """The tables of a stream that has taken in ``rows`` equal what the batch gives."""
    frame = spark.createDataFrame(rows, ingest.EVENT)
    now = max(r[2] for r in rows) - late
    got = ingest.table(spark, folder, "events")
    assert told(got) == told(sessions.timeline(frame, now))
    columns = ["session", "harness", "model", "cwd", "started_at", "ended_at", "remap", "events"]
    both = [sorted(tuple(r[c] for c in columns) for r in t.collect()) for t in (ingest.table(spark, folder, "sessions"), sessions.states(frame))]
    assert both[0] == both[1]
    stored = [r for r in rows if r[3] in ingest.PAYLOADS]
    assert ingest.table(spark, folder, "observations").count() == len(stored)
    blobs = [r["payload"] for r in ingest.table(spark, folder, "blobs").collect()]
    assert sorted(blobs) == sorted({r[10] for r in stored if r[10]})
    pages = {r["uri"]: (r["hash"], r["created_at"]) for r in ingest.table(spark, folder, "pages").collect()}
    assert len(pages) == len({r[10] or "" for r in stored}) and all(u.startswith("shell/") and h.startswith(u[6:]) for u, (h, _) in pages.items())
    assert {r["name"] for r in ingest.table(spark, folder, "frames").where("kind = 'symbol'").collect()} == {"f"}


def deliver(spark, inbox: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, ingest.EVENT).coalesce(1).write.mode("append").parquet(inbox)


@pytest.mark.parametrize("cuts", [(1, 90), (60, 61, 120)])
def test_stream_agrees_with_batch(spark, tmp_path, cuts):
    rows, inbox, folder = events(160, 5), str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in zip((0, *cuts), (*cuts, len(rows))):
        deliver(spark, inbox, rows[a:b])
        ingest.sync(spark, inbox, folder)
    agree(spark, folder, rows, 60)


def test_a_crash_between_tables_leaves_whole_batches(spark, tmp_path, monkeypatch):
    rows, inbox, folder = events(120, 6), str(tmp_path / "in"), str(tmp_path / "out")
    assert ingest.table(spark, folder, "events") is None
    deliver(spark, inbox, rows[:70])
    ingest.sync(spark, inbox, folder)
    before = ingest.table(spark, folder, "observations").count()
    deliver(spark, inbox, rows[70:])
    frames = ingest.texts.frames
    monkeypatch.setattr(ingest.texts, "frames", lambda *_: 1 / 0)  # after three tables have been written
    with pytest.raises(Exception, match="ZeroDivision|division"):
        ingest.sync(spark, inbox, folder)
    assert ingest.table(spark, folder, "observations").count() == before
    monkeypatch.setattr(ingest.texts, "frames", frames)
    ingest.sync(spark, inbox, folder)
    agree(spark, folder, rows, 60)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], ingest.EVENT)
    assert sessions.timeline(none, 0).count() == sessions.states(none).count() == 0
    one = spark.createDataFrame([(None, 1, 10, None, None, None, None, None, None, None, None)], ingest.EVENT)
    assert told(sessions.timeline(one, 10_000)) == [(None, 1, 10, "", False, ""), (None, 1, 280, "idle", False, "")]
    assert sessions.states(one).select(F.col("events")).collect()[0][0] == 1
