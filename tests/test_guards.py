"""Guards read each payload once."""

from __future__ import annotations

from sparkwell.operators import guards

DOCS = "doc_id long, text string, tool string, task array<string>, command string, exit_code int"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_reduced_once(spark):
    log = "running 30 tests\n" + "\n".join(f"test a::case_{i} ... ok" for i in range(30)) + "\ntest result: ok. 30 passed; 0 failed"
    rows = spark.createDataFrame([(1, log, "shell", [], "run a", 0), (1, log, "shell", [], "run b", 1), (2, None, "shell", [], None, None)], DOCS)
    told = guards.shell_guard(rows)
    assert "Join" not in plan(told)
    got = told.collect()
    # Two payloads of one id are two rows, each under its own command.
    assert sorted(r["text"].split("\n")[0] for r in got) == ["$ run a", "$ run b"]


def test_excerpts_are_worked_out_once(spark):
    rows = spark.createDataFrame([(1, "error: here\n" + "plain words of a long log\n" * 400, "generic", ["error"], None, None), (2, None, "generic", [], None, None)], DOCS)
    told = guards.generic_guard(rows)
    assert plan(told).count("lines") <= 1 + plan(told).count("Generate")
    assert [r["doc_id"] for r in told.collect()] == [1]
