"""Frame search against plain Python, where the first frames tell enough and where they don't."""

from __future__ import annotations

import random

from sparkwell.operators import facade, needles


def test_first_and_later_frames(spark, monkeypatch):
    monkeypatch.setattr(facade, "FIRST_FRAMES", 20)
    frames = [(i, f"n{i % 7}", ("fail", "error", "symbol")[i % 3], i % 4 + 1, f"Common hint {i} {'rare' if i > 90 else ''} 😀x") for i in range(100)]
    needles = [(1, "common"), (2, "COMMON"), (3, "rare"), (4, "n3"), (5, "x"), (6, None), (7, "nowhere"), (8, "😀x")]
    got = facade.search_frames(spark.createDataFrame(needles, "query_id long, needle string"), spark.createDataFrame(frames, "uri long, name string, kind string, start_line int, hint string"), 5)
    want = []
    for q, needle in needles:
        held = [f for f in frames if needle and len(needle) >= 2 and (needle.lower() in f[1].lower() or needle.lower() in f[4].lower())]
        held.sort(key=lambda f: (("fail", "error", "symbol").index(f[2]), f[3], f[0], f[1]))
        want += [(q, r + 1, f[0], f[1], f[2], f[4]) for r, f in enumerate(held[:5])]
    assert sorted(map(tuple, got.collect())) == want


def test_rows_are_not_shuffled_by_pair(spark):
    needles, rows = spark.createDataFrame([(1, "ab")], "query_id long, needle string"), spark.createDataFrame([(1, "xaby")], "uri long, body string")
    found = facade.holding(needles, rows, "body")
    assert "strategy=broadcast" in found._jdf.queryExecution().analyzed().toString() or "ResolvedHint" in found._jdf.queryExecution().analyzed().toString()
    assert [r["uri"] for r in found.collect()] == [1]


def test_needles_are_found_in_one_pass_over_the_texts(spark, monkeypatch):
    """Needles of all lengths, in blocks, with letters of four bytes; none reaches over two texts; texts are not taken apart into rows of pairs."""
    monkeypatch.setattr(needles, "BLOCK", 40)
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcé😀 ", k=rng.choice([0, 1, 3, 20, 60]))) for _ in range(300)]
    asked = sorted({t[i : i + n] for t in texts[:60] for n in (2, 3, 4, 5, 9) for i in range(0, max(len(t) - n, 0), 5)} | {"zz", "abcabcabcabc"})
    assert len(asked) > 120
    rows = spark.createDataFrame(list(enumerate(texts)), "uri long, body string")
    got = needles.found(spark.createDataFrame([(x,) for x in asked], "_needle string"), rows, "body", "found").collect()
    assert sorted((r["_needle"], r["uri"]) for r in got) == sorted((x, i) for x in asked for i, t in enumerate(texts) if x in t)


def test_later_frames_are_not_joined_by_pair(spark, monkeypatch):
    """Rare needles met every frame that has their rarest pair of letters, a number of rows that grew with both tables."""
    monkeypatch.setattr(facade, "FIRST_FRAMES", 20)
    held = []
    monkeypatch.setattr(facade, "holding", lambda asked, rows, body, own=facade.holding: held.append(rows.count()) or own(asked, rows, body))
    frames = spark.createDataFrame([(i, "n", "fail", 1, f"hint {i}") for i in range(500)], "uri long, name string, kind string, start_line int, hint string")
    got = facade.search_frames(spark.createDataFrame([(1, "hint 499"), (2, "hint")], "query_id long, needle string"), frames, 5)
    assert sorted((r["query_id"], r["uri"]) for r in got.collect()) == [(1, 499), *((2, i) for i in range(5))]
    assert held == [20]
