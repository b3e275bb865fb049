"""The pipeline stage by stage against plain Python: each stage is judged on its own input."""

from __future__ import annotations

import duckdb

import corpus_pipeline
from sparkwell.llm import quality_rules
from tests.llm import brute
from tests.llm.test_contracts import SMALL, cell_wise, check_packing
from tests.llm.test_near_copies import kept


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    (_, quality), (_, lines), (_, near), (_, benchmark), (_, pack) = corpus_pipeline.STAGES
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    after, given = [], docs
    for stage in (quality, lines, near, benchmark):
        given = spark.createDataFrame(stage(spark, given, SMALL).collect(), docs.schema)
        assert given.columns == docs.columns
        assert all(r["n_chars"] == len(r["text"] or "") for r in given.collect() if r["text"])
        after.append(pairs(given))
    judged = quality_rules.judge(docs).select("doc_id", "kept", "cleaned", "base_failed").collect()
    assert {r["doc_id"]: r["base_failed"] for r in judged} == {r["doc_id"]: brute.quality(r["text"])["base_failed"] for r in docs.collect()}
    assert after[0] == sorted((r["doc_id"], r["cleaned"]) for r in judged if r["kept"]) and len(after[0]) > 100
    assert after[1] == sorted((d, t) for d, _, _, t in brute.line_dedup(after[0]))
    stay = kept(after[1])
    assert after[2] == [p for p in after[1] if p[0] in stay]
    leaky = {d for d, _ in cell_wise(after[2], items)}
    assert after[3] == [p for p in after[2] if p[0] not in leaky]
    check_packing(after[3], pack(spark, given, SMALL).collect())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "length", "ids_crc32").collect()))[0][0] == after[3][0][0]
