"""The chain of look-ups: batch fold against plain Python, and the stream against the batch in any split into files."""

from __future__ import annotations

import random

import pytest

from sparkwell.operators import remember
from sparkwell.streaming import remember as stream

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State is kept for each partition; two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


COLUMNS = ["at", "kind", "match", "count", "distance"]


def one_by_one(rows: list[tuple], radius: int = 3) -> list[tuple]:
    """rows: (at, hash, norm, simhash, digits) in order of arrival."""
    first, times, norms, entries, out = {}, {}, {}, [], []
    for at, h, n, s, d in rows:
        near = min(((((s ^ x) & (2**64 - 1)).bit_count(), m) for m, x, e in entries if e == d and ((s ^ x) & (2**64 - 1)).bit_count() <= radius), default=None) if s else None
        if h in first:
            kind, match, distance = "exact", first[h], 0
        elif n in norms:
            kind, match, distance = "normalized", norms[n], 0
        elif near:
            kind, match, distance = "near", near[1], near[0]
        else:
            kind, match, distance = "new", None, 0
        hash_of = {m: k for k, m in first.items()}
        out.append((at, kind, match, times[hash_of[match]] + 1 if match is not None else 1, distance))
        if h not in first:
            first[h], times[h] = at, 0
            norms.setdefault(n, at)
            if s:
                entries.append((at, s, d))
        times[h] += 1
    return out


def arrivals(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    out = []
    for at in range(n):
        b = rng.randrange(4)
        s = base[b]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            s ^= 1 << rng.randrange(64)
        s = rng.choice([s, s, s, 0])
        s = s - (1 << 64) if s >> 63 else s
        h = f"h{rng.randrange(n)}"
        out.append((at * 3, h, f"n{hash(h) % (n // 2)}" if rng.random() < 0.5 else f"own {h}", s, f"d{rng.randrange(2)}"))
    seen = {}
    return [(at, h, *seen.setdefault(h, (n_, s, d))) for at, h, n_, s, d in out]  # equal payloads have equal keys


def test_batch_is_as_one_by_one(spark):
    rows = arrivals(400, 1)
    want = one_by_one(rows)
    assert {k for _, k, *_ in want} == {"exact", "normalized", "near", "new"} and any(c > 2 for *_, c, _ in want)
    got = remember.remembered(spark.createDataFrame(rows, stream.ARRIVAL))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want)


def test_texts_and_nulls(spark):
    docs = spark.createDataFrame([(1, "job 7 done"), (2, "job  7 done"), (3, "job 8 done"), (4, None), (5, ""), (6, "job 7 done"), (7, "job 7 done")], "doc_id long, text string")
    got = {r["at"]: (r["kind"], r["match"], r["count"]) for r in remember.remembered(remember.arrivals_of(docs)).collect()}
    assert got == {1: ("new", None, 1), 2: ("normalized", 1, 2), 3: ("new", None, 1), 4: ("new", None, 1), 5: ("exact", 4, 2), 6: ("exact", 1, 2), 7: ("exact", 1, 3)}
    assert remember.remembered(spark.createDataFrame([], stream.ARRIVAL)).count() == 0


@pytest.mark.parametrize(("cuts", "files"), [((50, 51, 160), 100), ((120,), 1)])
def test_stream_agrees_with_batch(spark, tmp_path, cuts, files):
    rows = arrivals(200, 2)
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for i, (a, b) in enumerate(zip((0, *cuts), (*cuts, len(rows)))):
        spark.createDataFrame(rows[a:b], stream.ARRIVAL).coalesce(1).write.mode("append").parquet(inbox)
        if i != 1:  # two files meet in one call
            stream.sync(spark, inbox, folder, files)
    stream.sync(spark, inbox, folder, files)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in stream.outcome(spark, folder).collect())
    assert got == sorted(one_by_one(rows))


def test_a_broken_run_is_made_good(spark, tmp_path, monkeypatch):
    rows = arrivals(120, 3)
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows[:60], stream.ARRIVAL).coalesce(1).write.parquet(inbox)
    stream.sync(spark, inbox, folder)
    spark.createDataFrame(rows[60:], stream.ARRIVAL).coalesce(1).write.mode("append").parquet(inbox)
    whole = stream._run

    def dies(frame, path, checkpoint):
        """Writes its batch, and ends before the stream can note that it did."""

        def put(batch, number):
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            raise RuntimeError("lost")

        frame.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    monkeypatch.setattr(stream, "_run", dies)
    with pytest.raises(Exception, match="lost"):
        stream.sync(spark, inbox, folder)
    monkeypatch.setattr(stream, "_run", whole)
    stream.sync(spark, inbox, folder)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in stream.outcome(spark, folder).collect()) == sorted(one_by_one(rows))


def test_each_payload_is_built_once(spark):
    """No join builds payloads twice or sends them whole to every task, and the chain reads what it hashed, not the texts again."""
    from sparkwell.plans.memory import payload_arrivals

    plan = payload_arrivals(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    rows = spark.range(50).selectExpr("id AS at", "sha2(string(id % 20), 256) AS hash", "sha2(string(id % 10), 256) AS norm", "id % 5 + 1 AS simhash", "'' AS digits")
    assert remember.remembered(rows.mapInPandas(counted, rows.schema)).count() == 50
    assert calls.value == 50
