"""SimHash links put out once, by many tasks."""

from __future__ import annotations

import random
from itertools import combinations

from sparkwell.operators import texts


def test_links_come_once_from_many_tasks(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    hashes = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(3))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [h - (1 << 64) if h >> 63 else h for h in sorted(hashes)]
    links = texts.simhash_class_links(spark.createDataFrame(list(enumerate(signed)), "doc_id long, simhash long"))
    want = sorted((min(a, b), max(a, b), ((a ^ b) & (2**64 - 1)).bit_count()) for a, b in combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert sorted((r["a"], r["b"], r["distance"]) for r in links.collect()) == want
    assert links.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
