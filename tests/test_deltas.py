"""Task tokens and line diffs on small cases and against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkwell.functions.columns import estimated_tokens
from sparkwell.functions.tasks import merged_tokens, task_tokens, token_overlap
from sparkwell.operators import deltas
from sparkwell.plans.queries import QUERIES


def test_task_tokens(spark):
    cases = {
        "fix the oauth redirect in auth login": ["oauth", "redirect", "auth", "login"],
        "src/auth.rs auth::login E0308 e1 x": ["auth", "login", "e0308", "e1"],
        "authLogin HTTPServer2 aB": ["authlogin", "auth", "login", "httpserver2", "http", "server2"],
        "refresh_token 12 123": ["refresh", "token", "123"],
        "请修复登录和 oauth": ["请修复登录和", "请修", "修复", "复登", "登录", "录和", "oauth"],
        "这个请求很久都没有反应": ["个请", "请求", "求很", "很久", "久都", "都没", "没有", "有反", "反应"],
        "": [],
        None: [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i long, text string")
    got = {r["i"]: r["t"] for r in rows.select("i", task_tokens(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_merge_and_overlap(spark):
    rows = spark.createDataFrame([([f"old{i:02}xx" for i in range(16)], ["billing", "invoice"])], "old array<string>, new array<string>")
    merged = rows.select(merged_tokens(F.col("old"), F.col("new"))).first()[0]
    assert merged[:2] == ["billing", "invoice"] and len(merged) == 16 and "old15xx" not in merged
    pairs = [(["auth", "login"], ["auth"], 2), (["auth"], ["authority", "unrelated"], 3), (["登录失败"], ["登录"], 1), ([], ["auth"], 0), (["auth"], [], 0), (["x"], ["xy"], 0)]
    got = spark.createDataFrame(pairs, "page array<string>, asked array<string>, want int").select(token_overlap(F.col("page"), F.col("asked")).alias("n"), "want").collect()
    assert all(r["n"] == r["want"] for r in got)


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        row, last = [0], row
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def test_edits_are_shortest():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        script = deltas.edits(a, b)
        assert [a[i] for s, i, _ in script if s != "+"] == a and [b[j] for s, _, j in script if s != "-"] == b
        assert all(a[i] == b[j] for s, i, j in script if s == " ")
        assert sum(s != " " for s, _, _ in script) == len(a) + len(b) - 2 * common(a, b)
    assert deltas.edits(["x"] * 200, ["y"] * 200) is None and len(deltas.edits(["x"] * 128, ["y"] * 128)) == 256


def test_line_delta():
    base = [f"line {i} shared" for i in range(40)]
    text = "\n".join(base)
    out = deltas.line_delta(text, text.replace("line 20 shared", "line 20 CHANGED"), 400)
    assert out == "line diff\n@@ -19,5 +19,5 @@\n line 18 shared\n line 19 shared\n-line 20 shared\n+line 20 CHANGED\n line 21 shared\n line 22 shared\n"
    comment = "\n".join(base[:20] + ["// old"] + base[20:])
    assert deltas.line_delta(comment, comment.replace("old", "new"), 400) is None
    assert deltas.line_delta("alpha\n" * 50, "beta\n" * 50, 400) is None and deltas.line_delta(text, text, 400) is None
    assert deltas.line_delta("a\n" * 7, "a\n" * 7 + "b\n", 400) is None and deltas.line_delta("", "", 400) is None
    longer = [f"line {i} shared" for i in range(200)]
    far = [x.replace("shared", "other") if i in (5, 10, 16, 100) else x for i, x in enumerate(longer)]
    whole, cut = (deltas.line_delta("\n".join(longer), "\n".join(far), budget) for budget in (400, 1))
    assert whole.count("@@ -") == 3 and "more hunks" not in whole
    assert cut.count("@@ -") == 1 and cut.endswith("… 2 more hunks\n") and whole.startswith(cut[: cut.index("…")])


def test_payload_deltas(spark):
    rows = QUERIES["payload_deltas"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["prev_id"] < r["doc_id"] and r["delta"].startswith("line diff\n@@ -") for r in rows)
    texts = ["", "a", "one two three", "é" * 9, "a b " * 50]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", estimated_tokens(F.col("text")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: deltas.tokens(t) for i, t in enumerate(texts)}
