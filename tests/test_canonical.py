"""Normal forms: equal for permuted and restamped documents, unequal for others."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from sparkwell.functions.canonical import VOLATILE, canonical, prefix_hash


def permuted(value: object, rng: random.Random) -> object:
    """The same document with its keys in another order, other clocks, and volatile keys strewn in."""
    if isinstance(value, dict):
        items = [(k, permuted(v, rng)) for k, v in value.items()] + [(k, rng.random()) for k in rng.sample(VOLATILE, 2)]
        rng.shuffle(items)
        return dict(items)
    if isinstance(value, list):
        return [permuted(v, rng) for v in value]
    return value.replace("<at>", f"2026-0{rng.randrange(1, 9)}-05T10:00:0{rng.randrange(9)}.{rng.randrange(99)}Z") if isinstance(value, str) else value


def test_permuted_documents_have_one_hash(spark):
    rng = random.Random(5)
    docs = [{"tools": [{"name": f"t{i}", "n": i, "at": "seen <at>"}, None, True], "é": {"z": 1.5, "a": [1, [2, {"k": "v"}]]}} for i in range(5)]
    rows = [(i, json.dumps(permuted(d, rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i, d in enumerate(docs) for _ in range(4)]
    got = spark.createDataFrame(rows, "i long, t string").groupBy("i").agg(F.collect_set(prefix_hash(F.col("t"))).alias("h")).collect()
    assert len(got) == 5 and all(len(r["h"]) == 1 for r in got) and len({r["h"][0] for r in got}) == 5


def test_texts(spark):
    pairs = {
        "a\r\nb\rc": "a\nb\nc",
        "at 2026-01-05T10:00:00.123Z, id 0f8fad5b-d9cb-469f-a165-70867728950e!": "at <ts>, id <id>!",
        '{"b":1,"a":{"now":2}}': '{"a":{},"b":1}',
        '{"b":1': '{"b":1',
        " 12 ": "12",
        '"x"': '"x"',
        "": "",
        None: None,
        "[" * 3000: "[" * 3000,
        '{"a":1,"a":2}': '{"a":2}',
    }
    rows = spark.createDataFrame(list(enumerate(pairs)), "i long, t string").select("i", canonical(F.col("t")).alias("c")).collect()
    assert {r["i"]: r["c"] for r in rows} == dict(enumerate(pairs.values()))
    parts = spark.createDataFrame([("a", "b"), ("a\nb", ""), (None, "b"), ("", "b")], "x string, y string").select(prefix_hash(F.col("x"), F.col("y")).alias("h")).collect()
    assert parts[0] != parts[1] and parts[2] == parts[3]
