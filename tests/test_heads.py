"""Task tokens from the first characters of a text."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkwell.functions import tasks


def test_heads_change_no_token(spark, monkeypatch):
    rng = random.Random(1)
    words = ["the", "fooBar", "HTTPServer", "x1", "數據庫連接", "日志", "漢字仮名交じり文", "e0", "retry", "kernel"] + [f"word{i}" for i in range(20)]
    bodies = [rng.choice(["", " ", "-"]).join(rng.choices(words[: rng.choice([4, 30])], k=rng.choice([1, 40, 900]))) for _ in range(200)]
    bodies += [None, "", "a" * 5000, "a " * 3000 + "lastWord", "x" * 255 + "Yz tail", "漢" * 300 + "ab"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string").repartition(8)
    got = {r[0]: r[1] for r in rows.select("doc_id", tasks.task_tokens(F.col("text"))).collect()}
    monkeypatch.setattr(tasks, "HEADS", ())
    assert got == {r[0]: r[1] for r in rows.select("doc_id", tasks.task_tokens(F.col("text"))).collect()}
    assert got[len(bodies) - 3] == ["lastword", "last", "word"]
