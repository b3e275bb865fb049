"""Ledger sources on small hand-made inputs."""

from __future__ import annotations

import json

from sparkwell.functions.columns import grid, resolve_window
from sparkwell.operators import dashboard
from sparkwell.plans.queries import QUERIES
from sparkwell.sources import ledgers
from sparkwell.sources.model import observations, turns

FOLDER = "/root/testdata/sf0.01"


def lines(spark, *rows):
    return spark.createDataFrame([(f, i, v if isinstance(v, str) else json.dumps(v)) for i, (f, v) in enumerate(rows)], "file string, pos long, value string")


def test_message_turns(spark):
    usage = {"input_tokens": 5, "output_tokens": 7, "cache_read_input_tokens": 11, "cache_creation_input_tokens": 13}
    split = usage | {"cache_creation": {"ephemeral_5m_input_tokens": 3, "ephemeral_1h_input_tokens": 10}, "output_tokens_details": {"thinking_tokens": 2}, "service_tier": "standard"}
    rows = lines(spark, ("a", {"timestamp": "2024-01-02T03:04:05+02:00", "type": "assistant", "message": {"model": "m", "usage": usage}}), ("a", "not json"), ("a", {"type": "user"}), ("a", {"timestamp": "2024-01-02T03:04:05Z", "message": {"model": "m", "usage": split}}))
    got = [(r["ts"], r["cache_write_5m"], r["cache_write_1h"], r["reasoning_tokens"], r["plan_type"]) for r in ledgers.message_turns(rows).orderBy("pos").collect()]
    assert got == [(1704164645, 13, 0, 0, ""), (1704164645, 3, 10, 2, "standard")]


def test_counted_turns_carry_the_model(spark):
    count = lambda n: {"timestamp": "2024-01-02T03:04:05Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "cached_input_tokens": 1}, "model_context_window": 9}, "rate_limits": {"primary": {"used_percent": 4.5}, "plan_type": "plus"}}}
    rows = lines(spark, ("a", count(1)), ("a", {"payload": {"model": "gpt-5"}}), ("a", count(2)), ("b", count(3)), ("a", {"model": "o3"}), ("a", "{"), ("a", count(4)))
    seeds = spark.createDataFrame([("a", "seeded")], "file string, seed string")
    got = {r["input_tokens"]: (r["model"], r["cache_read_tokens"], r["quota_used_pct"], r["plan_type"]) for r in ledgers.counted_turns(rows, seeds).collect()}
    assert got == {1: ("seeded", 1, 4.5, "plus"), 2: ("gpt-5", 1, 4.5, "plus"), 3: ("", 1, 4.5, "plus"), 4: ("o3", 1, 4.5, "plus")}


def test_read_lines(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.jsonl").write_text('{"payload":{"model":"m"}}\n{"payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":5}}}}\n')
    (tmp_path / "y.txt").write_text("no")
    got = ledgers.counted_turns(ledgers.read_lines(spark, str(tmp_path))).collect()
    assert [(r["model"], r["input_tokens"], r["ts"]) for r in got] == [("m", 5, None)]


def test_key_values(spark):
    pairs = spark.createDataFrame([
        ("composerData:s1", json.dumps({"lastUpdatedAt": 1704164645000, "contextTokensUsed": 90, "contextTokenLimit": 200, "modelConfig": {"modelName": "m"}})),
        ("composerData:s2", json.dumps({"createdAt": 1704164645, "contextTokensUsed": 0})), ("bubbleId:s1:b1", json.dumps({"tokenCount": {"inputTokens": 3, "outputTokens": 0}})), ("bubbleId:s1:b2", "{}"), ("other", "x"),
    ], "key string, value string")
    entries = ledgers.composers(pairs)
    assert [tuple(r) for r in entries.collect()] == [("s1", 1704164645, 90, 200, "m")]
    assert [tuple(r) for r in ledgers.bubbles(pairs).collect()] == [("s1", "b1", 3, 0)]
    assert ledgers.changed(entries, entries.limit(0)).count() == 1 and ledgers.changed(entries, entries).count() == 0
    assert ledgers.changed(entries, entries.selectExpr("session", "ts", "context_tokens - 1 as context_tokens")).count() == 1


def test_prices(spark):
    table = spark.createDataFrame([("| Name | Input |",), ("|---|---|",), ("| **GPT-5 Mini** (new) | $0.25 | $2 |",), ("text",), ("| Claude 4.6 Opus | 5 |",)], "value string")
    assert {tuple(r) for r in ledgers.markdown_prices(table).collect()} == {("gpt-5-mini", 0.25), ("claude-4.6-opus", 5.0)}
    catalogue = spark.createDataFrame([(json.dumps({"p": {"models": {"GPT-5": {"cost": {"input": 1.25}}, "free": {}, "z": {"cost": {"input": 1}}}}}),)], "value string")
    listed = spark.createDataFrame([("gpt-5",), ("free",)], "model_id string")
    assert [tuple(r) for r in ledgers.catalog_prices(catalogue, listed).collect()] == [("gpt-5", 1.25)]


def test_windows():
    now, day = 1_704_164_645, 86400
    assert resolve_window("7d", now, 0) == ("7d", now - 7 * day, now, day) == resolve_window("nonsense", now, 0)
    assert resolve_window("24h", now, 0) == ("1d", now - day, now, 3600) and resolve_window("today", now, now - 100) == ("today", now - 100, now, 3600)
    assert resolve_window("custom", now, 0, now + 5, now - 60 * day) == ("custom", now - 60 * day, now, 7 * day)
    assert grid(now - 2 * day, now, 3600)[2] == 7200 and grid(0, 100 * day, day)[2] == 4 * day


def test_tunes(spark):
    """The clamped fold against plain Python."""
    rows = observations(spark, FOLDER).orderBy("created_at", "id").select("session_id", "tool_type", "refetched_tokens").collect()
    state: dict = {}
    for s, t, refetched in rows:
        n, total, tune = state.get((s, t), (0, 0, 1.0))
        n, total = n + 1, total + refetched
        if n % 3 == 0:
            tune = min(tune + 0.05, 1.4) if total / n > 0.2 else max(tune - 0.05, 0.75) if total / n < 0.05 else tune
        state[s, t] = (n, total, tune)
    got = {(r["session_id"], r["tool_type"]): (r["intercepts"], r["tune"]) for r in QUERIES["optimizer_tunes"](spark, FOLDER).collect()}
    assert got == {k: (n, round(t, 6)) for k, (n, _, t) in state.items()} and len({t for _, t in got.values()}) > 2


def test_advice(spark):
    """Reasons in their order of precedence, and the costs of a hand-computed turn."""
    got = QUERIES["keep_or_rotate"](spark, FOLDER).collect()
    assert len(got) == turns(spark, FOLDER).select("session").distinct().count()
    one = turns(spark, FOLDER).limit(1).selectExpr("*").collect()[0].asDict() | {"session": 1, "ts": 1000, "harness": "claude", "model": "claude-sonnet-4", "is_compaction": False, "input_tokens": 1_000_000, "output_tokens": 0, "cache_read_tokens": 0, "cache_write_5m": 0, "cache_write_1h": 0, "reasoning_tokens": 0}
    rows = [one, one | {"session": 2, "cache_read_tokens": 5}, one | {"session": 2, "ts": 2000}, one | {"session": 3, "is_compaction": True}, one | {"session": 4, "cache_read_tokens": 10, "cache_write_1h": 1}]
    from sparkwell.plans.dashboard import _usd

    table = spark.createDataFrame(rows, turns(spark, FOLDER).schema)
    advice = {r["session"]: r for r in dashboard.advice(table, 3, 1100, _usd, lambda t: _usd(dashboard.cold_turn(t))).collect()}
    assert {s: r["reason"] for s, r in advice.items()} == {1: "keep-hot-prefix", 2: "cache-miss-window", 3: "already-compacted", 4: "keep-hot-prefix"}
    assert (advice[1]["keep_cost"], advice[1]["rotate_cost"]) == (9.0, round(3 + 3.75 + 2 * 1.2, 6))
