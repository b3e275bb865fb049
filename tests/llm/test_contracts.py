"""Every registered query against plain Python, on the awkward fixture, on an empty table and on a small driver table."""

from __future__ import annotations

import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from sparkwell.llm import decontaminate
from tests.llm import brute, fixtures

SMALL = "/root/testdata/sf0.001"
QUERIES = {k: f for k, f in __spark_entry__.queries().items() if re.match(r"op\d|pipeline", k)}
ITEMS = [(1, fixtures.prose(31, 60)), (2, fixtures.prose(32, 40)), (3, None), (None, "no id here at all"), (4, "too short"), (5, fixtures.prose(33, 300)), (1, fixtures.prose(31, 60)), (6, "")]


def leaky() -> list[tuple]:
    w = fixtures.prose(32, 40).split()
    return [
        (50, fixtures.prose(41, 100) + "\n" + fixtures.prose(31, 60) + "\n" + fixtures.prose(42, 100)),
        (51, fixtures.edited(fixtures.prose(31, 60), 6, 3)),
        (52, " ".join(w[:10] + ["added", "words"] + w[10:24] + w[26:]).upper()),
        (53, " ".join(fixtures.prose(31, 60).split()[:20])),
        (54, "z " * 3000 + fixtures.prose(33, 300).replace(".", "!")),
    ]


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.org/es/x?y"), (5, "https://a.example.org/en/12#f"), (6, "http://example.com/de/1"), (7, "http://example.com/fr/"), (8, "x://notexample.org"), (9, "http://example.org"), (10, "http://big-casino.net/"), (11, "a://b://c/d"), (12, "http://com/de/"), (12, "http://com/de/"), (13, "http://exampleXorg/"), (14, "http://münchen.org/ä?"), (None, "http://e.com/FR/"), (15, "http://org?/es/")]
    labels = [(d, 1 if d is None or d % 3 else 0, 1 if d in (10, 13) else 0) for d in (None, 10, 11, 13, 13, 19, 20, 21, 99)]
    return fixtures.write(folder, fixtures.texts() + leaky(), ITEMS, labels, urls)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return fixtures.write(str(tmp_path_factory.mktemp("empty")), [])


def docs_of(folder: str) -> list[tuple]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()


def bag(rows) -> Counter:
    return Counter(map(tuple, rows))


def run(spark, name: str, folder: str, *columns: str):
    return QUERIES[name](spark, folder).select(*columns).collect()


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("where", ["awkward", "small"])
def test_line_dedup(spark, awkward, where):
    folder = awkward if where == "awkward" else SMALL
    got = run(spark, "op2_line_dedup", folder, "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert bag(got) == bag((d, n, k, brute.sha(t.encode())) for d, n, k, t in brute.line_dedup(docs_of(folder)))


@pytest.mark.parametrize("where", ["awkward", "small"])
def test_simhash(spark, awkward, where):
    folder = awkward if where == "awkward" else SMALL
    docs = docs_of(folder)
    fps = [brute.fingerprint(t) for _, t in docs]
    of = brute.components(fps)
    least = defaultdict(list)
    for (d, _), c in zip(docs, of):
        least[c] += [d] if d is not None else []
    want = bag((d, f"{fp:016x}", min(least[c], default=None)) for (d, _), fp, c in zip(docs, fps, of))
    assert bag(run(spark, "op3_simhash", folder, "doc_id", "fingerprint", "component_id")) == want


def cell_wise(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc_id, item_id) whose alignment over the whole text reaches the threshold; no seeds."""
    table = decontaminate._PLAIN
    plain = lambda t: [w.decode("utf-8", "replace") for w in (t or "").encode().translate(table).split()]
    out = set()
    for i, text in items:
        w = plain(text)
        starts = range(0, max(1, len(w) - decontaminate.LEAST_WORDS + 1), decontaminate.PASSAGE)
        parts = [w[k : k + decontaminate.PASSAGE if k < starts[-1] else len(w)] for k in starts] if i is not None and len(w) >= decontaminate.LEAST_WORDS else []
        for p in parts:
            for d, t in docs:
                words = plain(t)
                if len(set(p) & set(words)) * 2 >= len(set(p)) * decontaminate.THRESHOLD and brute.alignment(p, words, decontaminate.MATCH, decontaminate.MISMATCH, decontaminate.GAP) >= decontaminate.THRESHOLD * len(p):
                    out.add((d, i))
    return out


def test_decontamination(spark, awkward):
    docs = [(d, t) for d, t in docs_of(awkward) if d != 26]
    got = run(spark, "op5_decontaminate", awkward, "doc_id", "item_id")
    assert max(bag(got).values()) == 1
    assert {tuple(r) for r in got} == cell_wise(docs, ITEMS) == {(50, 1), (51, 1), (52, 2), (54, 5)}


def test_decontamination_in_blocks(spark, awkward):
    """Any number of blocks gives the same hits."""
    docs, items = spark.read.parquet(f"{awkward}/documents.parquet"), spark.read.parquet(f"{awkward}/benchmark.parquet")
    rows = lambda b: bag(decontaminate.contaminated(docs, items, block_bytes=b).select("doc_id", "item_id").collect())
    assert rows(200) == rows(8_000_000)
    ids = lambda b: bag(decontaminate.clean(docs, items, block_bytes=b).select("doc_id").collect())
    assert ids(200) == ids(8_000_000) == bag((d,) for d, _ in docs_of(awkward) if d not in (50, 51, 52, 54))


def test_decontamination_small_table(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    got = {tuple(r) for r in run(spark, "op5_decontaminate", SMALL, "doc_id", "item_id")}
    assert got == cell_wise(docs_of(SMALL), items)


@pytest.mark.parametrize("where", ["awkward", "small"])
def test_suffix_dedup(spark, awkward, where):
    folder = awkward if where == "awkward" else SMALL
    docs = docs_of(folder)
    bodies = [(t or "").encode() for _, t in docs]
    want = []
    for (d, _), body, gone in zip(docs, bodies, brute.repeated(bodies, 400)):
        want.append((d, len(body), sum(gone), brute.runs(gone), brute.sha(bytes(b for b, g in zip(body, gone) if not g))))
    assert bag(run(spark, "op7_suffix_dedup", folder, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == bag(want)


@pytest.mark.parametrize("where", ["awkward", "small"])
def test_substring_dedup(spark, awkward, where):
    folder = awkward if where == "awkward" else SMALL
    docs = docs_of(folder)
    split = [brute.words(t) for _, t in docs]
    want = [(d, len(w), sum(g), brute.sha(" ".join(x for x, y in zip(w, g) if not y).encode())) for (d, _), w, g in zip(docs, split, brute.repeated(split, 35))]
    assert bag(run(spark, "op10_substring_dedup", folder, "doc_id", "n_words", "n_removed", "kept_sha256")) == bag(want)


@pytest.mark.parametrize("where", ["awkward", "small"])
def test_packing(spark, awkward, where):
    folder = awkward if where == "awkward" else SMALL
    check_packing(docs_of(folder), run(spark, "op8_packing", folder, "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))


def check_packing(docs: list[tuple], pieces: list) -> None:
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    total = 0
    for d, rows in defaultdict(list, {d: [t for e, t in docs if e == d] for d in {e for e, _ in docs}}).items():
        ids = [np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for t in rows]
        total += sum(map(len, ids))
        assert sum(p["length"] for p in by_doc[d]) == sum(map(len, ids))
        if len(ids) == 1:
            own, at = sorted(by_doc[d], key=lambda p: p["start"]), 0
            for p in own:
                assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[0])
                assert p["ids_crc32"] == zlib.crc32(ids[0][at : at + p["length"]].tobytes())
                at += p["length"]
    padded = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.02 * total


def test_quality_rules(spark, awkward):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for folder in (awkward, SMALL):
        want = [(d, *(brute.quality(t)[c] for c in columns[1:])) for d, t in docs_of(folder)]
        assert bag(run(spark, "op9_quality_rules", folder, *columns)) == bag(want)


def judge_url(url: str | None) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(brute.LOWER)
    fits = [(len(h + p), h + p, a) for a, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")) if f".{host}".endswith(f".{h}") and path.startswith(p)]
    if fits:
        return (host, path, *max(fits)[1:])
    return (host, path, None, "block" if "casino" in host else "allow")


def test_urls(spark, awkward):
    urls = duckdb.sql(f"SELECT page_id, url FROM '{awkward}/pages.parquet'").fetchall()
    assert bag(run(spark, "op6_url_filter", awkward, "page_id", "host", "path", "rule", "verdict")) == bag((i, *judge_url(u)) for i, u in urls)


@pytest.mark.parametrize("name,label,n,held", [("op1_toxicity", "toxic", 5, 0), ("op4_quality_classifier", "quality", 3, 1)])
def test_classifiers(spark, name, label, n, held):
    """Held-out documents are told apart; the split is the contract's."""
    folder = "/root/testdata/sf0.1"
    rows = run(spark, name, folder, "doc_id", "held_out", "score", "predicted")
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall())
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (brute.remainder(r["doc_id"], n) == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    tests = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    high, low = [s for s, y in tests if y], [s for s, y in tests if not y]
    area = sum((a > b) + 0.5 * (a == b) for a in high for b in low) / (len(high) * len(low))
    assert area > 0.93 and sum((s >= 0.5) == y for s, y in tests) / len(tests) > 0.95


@pytest.mark.parametrize("name", ["op1_toxicity", "op4_quality_classifier"])
def test_classifiers_score_awkward_rows(spark, awkward, name):
    rows = run(spark, name, awkward, "doc_id", "score", "predicted")
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in docs_of(awkward))
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_one_of_each(spark, awkward):
    """Each component keeps the row with its smallest id, with all columns; rows without id come last."""
    from sparkwell.llm import simhash

    docs = docs_of(awkward)
    of = brute.components([brute.fingerprint(t) for _, t in docs])
    first = {}
    for (d, t), c in zip(docs, of):
        first[c] = min(first.get(c, (True, 0)), (d is None, d or 0)) if c in first else (d is None, d or 0)
    source = spark.read.parquet(f"{awkward}/documents.parquet")
    kept = simhash.one_of_each(source)
    assert kept.columns == source.columns
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == Counter(first.values())


def test_rows_without_id_are_told_apart(spark):
    """Texts whose 32-bit hashes collide stay two documents."""
    from sparkwell.llm import line_dedup, simhash, substring_dedup, suffix_dedup

    pair = ["a line number 125468", "a line number 55606"]
    assert len({spark.range(1).select(F.hash(F.lit(True), F.lit(t))).first()[0] for t in pair}) == 1
    docs = spark.createDataFrame([(None, t) for t in pair] + [(None, pair[0] + "\n" + fixtures.prose(1, 200)), (7, pair[0]), (7, pair[1])], "doc_id long, text string")
    lost = {(r["doc_id"], r["text"]): r["n_dropped"] for r in line_dedup.drop_lines(docs).collect()}
    assert lost[None, pair[0]] == lost[None, pair[1]] == 1 and lost[7, pair[0]] == lost[7, pair[1]] == 0
    assert simhash.one_of_each(docs.where("doc_id is null"), max_distance=0).count() == 3
    for drop in (suffix_dedup.drop_repeats, substring_dedup.drop_repeats):
        assert drop(docs).count() == 5 and drop(docs).agg(F.sum("n_removed")).first()[0] == 0


def test_long_url(spark):
    from sparkwell.llm.queries import URL_RULES
    from sparkwell.llm.url_filter import filter_urls

    urls = [(i, f"http://example.com/fr/{i}") for i in range(2000)] + [(-1, "http://example.com/de/" + "x" * 300_000), (-2, "http://" + "a" * 200_000 + ".casino.net")]
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(urls, "page_id long, url string"), URL_RULES).select("page_id", "verdict").collect()}
    assert got.pop(-1) == got.pop(-2) == "block" and set(got.values()) == {"allow"} and len(got) == 2000


def test_other_tokenizers_are_refused():
    from sparkwell.llm.packing import WordTokenizer

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        WordTokenizer(f.read()).check()


def test_workers_need_no_package(awkward, tmp_path):
    """The package is on the driver's path only."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from pyspark.sql import SparkSession
from sparkwell.llm import decontaminate
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs, items = (spark.read.parquet({awkward!r} + f"/{{t}}.parquet") for t in ("documents", "benchmark"))
print("rows", decontaminate.contaminated(docs, items).count(), docs.count() - decontaminate.clean(docs, items).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 4 4" in done.stdout, done.stderr[-3000:]
