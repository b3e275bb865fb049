"""Large-star and small-star steps against plain Python."""

from __future__ import annotations

import random

import pytest

from sparkwell.llm.simhash import components


def plain(edges: list[tuple]) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


RNG = random.Random(1)
GRAPHS = {
    "chain": [(i, i + 1) for i in range(40)],
    "shuffled chain": [(min(a, b), max(a, b)) for a, b in (lambda p: zip(p, p[1:]))(RNG.sample(range(-50, 50), 60))],
    "stars that meet": [(0, i) for i in range(1, 30)] + [(i, 100) for i in range(31, 60)] + [(29, 100)],
    "random": [(a, b) for a, b in (sorted(RNG.sample(range(300), 2)) for _ in range(170))],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_roots_are_the_smallest_reached(spark, name):
    rows = components(spark.createDataFrame(GRAPHS[name], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == plain(GRAPHS[name]) and len(rows) == len(plain(GRAPHS[name]))
