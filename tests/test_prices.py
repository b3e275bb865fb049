"""Names and prices: aliases, endings, a loop's end, and turns costed by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwell.functions import prices as P
from sparkwell.functions.catalog import ALIASES, CATALOG
from sparkwell.functions.columns import uncached_input

ASKED = {
    "claude-sonnet-4-5": ("claude-sonnet-4", "claude-sonnet-4", "Claude Sonnet 4"),
    "Anthropic/Claude-Opus-4-1-thinking-max": ("claude-opus-4", "claude-opus-4", "Claude Opus 4"),
    "cursor-grok-4.5-high-fast": ("grok-4.5", "grok-4.5", "Grok 4.5"),  # its fast form is listed, but the ending goes before the prefix
    "cursor-gpt-5": ("gpt-5", "gpt-5", "GPT-5"),
    "x:o3": ("o3", "o3", "o3"),
    "gpt-5-low-low-low-low-low-low-low": ("gpt-5", "gpt-5", "GPT-5"),
    "gpt-5-low-low-low-low-low-low-low-low-low": (None, "gpt-5-low", "gpt-5-low-low-low-low-low-low-low-low-low"),
    "cursor-new-model-high": (None, "new-model", "new-model"),
    " Auto ": (None, "default", "Auto"),
    "": (None, "__unknown__", "Other"),
    None: (None, "__unknown__", "Other"),
    "-fast": (None, "-fast", "-fast"),
}


def test_names(spark):
    rows = spark.createDataFrame([(m,) for m in ASKED] + [(a,) for a in ALIASES] + [(i,) for i, _, _ in CATALOG], "model string")
    told = rows.select("model", P.canonical_id(F.col("model")).alias("c"), P.display_name(F.col("model")).alias("d")).distinct()
    got = {r["model"]: (r["matched"], r["c"], r["d"]) for r in P.resolved(rows, P.catalog(spark)).join(told.withColumnRenamed("model", "m"), F.col("model").eqNullSafe(F.col("m"))).collect()}
    assert {m: got[m] for m in ASKED} == ASKED
    assert all(got[a][0] == to for a, to in ALIASES.items())
    assert all(got[i][0] == i and got[i][2] == n for i, _, n in CATALOG)


def test_own_prices_lead_and_aliases_may_lead_on(spark):
    mine = spark.createDataFrame([("composer-2.5", 1.0), ("cursor-mine", 2.0)], "model_id string, usd double")
    rows = spark.createDataFrame([("cursor-composer-2.5",), ("composer-2",), ("cursor-mine",), ("mine",), ("cursor-grok-4.6",)], "model string")
    assert {r["model"]: r["matched"] for r in P.resolved(rows, mine).collect()} == {"cursor-composer-2.5": "composer-2.5", "composer-2": "composer-2.5", "cursor-mine": "cursor-mine", "mine": None, "cursor-grok-4.6": None}


@pytest.mark.parametrize(
    ("model", "harness", "want"),
    [
        ("claude-sonnet-4-5", "claude", 1.0 * 3 + 0.1 * 15 + 0.2 * 0.3 + 0.04 * 3.75 + 0.02 * 6 + 0.01 * 15),
        ("gpt-5-high", "codex", (1.0 - 0.2 - 0.04 - 0.02) * 1.25 + 0.1 * 10 + 0.2 * 0.3125 + 0.06 * 1.25),
        ("cursor-composer-2.5", "cursor", 1.0 * 0.5 + 0.1 * 1.5 + 0.2 * 0.05 + 0.06 * 0.5 + 0.01 * 1.5),
        ("deepseek-v4-pro", "claude", 1.0 * 0.435 + 0.1 * 0.87 + 0.2 * 0.003625 + 0.06 * 0.435 + 0.01 * 0.87),
        ("gemini-2.5-pro", "claude", 1.0 * 1.25 + 0.1 * 5 + 0.2 * 0.125 + 0.06 * 1.25 + 0.01 * 5),
        ("default", "claude", None),
    ],
)
def test_turns_by_hand(spark, model, harness, want):
    kind = "model string, harness string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_5m long, cache_write_1h long, reasoning_tokens long"
    rows = spark.createDataFrame([(model, harness, 1_000_000, 100_000, 200_000, 40_000, 20_000, 10_000)], kind)
    fresh = uncached_input(F.col("harness"), F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_5m") + F.col("cache_write_1h"))
    (row,) = P.priced(rows, P.catalog(spark), fresh).collect()
    assert row["usd"] == (pytest.approx(want, abs=1e-6) if want is not None else None)


def test_turns_do_not_meet_by_model(spark):
    """Most turns have one of few models: joined by model they would be a few large groups."""
    from sparkwell.operators.analytics import costs
    from sparkwell.sources.model import turns

    plan = costs(turns(spark, "/root/testdata/sf0.001"), "session")._jdf.queryExecution().executedPlan().toString()
    assert next(line for line in plan.splitlines() if "Join" in line).strip(" +-:").startswith("BroadcastHashJoin")
