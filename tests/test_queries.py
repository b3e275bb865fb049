"""Every query with SQL against DuckDB on the small driver tables; the others against plain Python."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import duckdb
import pytest

from sparkwell.operators import texts
from sparkwell.plans.queries import QUERIES, SQL
from sparkwell.streaming import ledger

FOLDER = "/root/testdata/sf0.01"
#: The small tables hold no such texts; see test_signals_and_digits.
EMPTY = ("digit_veto", "signal_lines")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    ours = Counter(tuple(r[c] for c in columns) for r in got.collect())
    theirs = Counter(want.fetchall())
    assert ours == theirs and (ours or name in EMPTY)


def test_simhash_pairs(spark):
    docs = spark.createDataFrame([(1, "job 12 failed at step 9 of the build"), (2, "job 77 failed at step 1 of the build"), (3, "something else entirely, with other words"), (4, ""), (5, None)], "doc_id long, text string")
    hashes = {r["doc_id"]: r["simhash"] for r in texts.simhash_trigrams(docs).collect()}
    assert hashes[1] == hashes[2] != hashes[3] and hashes[4] == hashes[5] == 0
    near = spark.createDataFrame([(h,) for h in (0b1011, 0b1000, -1, 0)], "simhash long")
    assert [tuple(r) for r in texts.simhash_links(near).collect()] == [(0b1000, 0b1011, 2)]


def test_simhash_links_find_all(spark):
    rows = [r["simhash"] for r in texts.simhash_trigrams(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()]
    distinct = sorted({h for h in rows if h})
    want = {(a, b) for a in distinct for b in distinct if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    source = spark.createDataFrame([(h,) for h in rows], "simhash long")
    assert {(r["a"], r["b"]) for r in texts.simhash_links(source).collect()} == want


def test_chunks(spark):
    rows = [r for r in QUERIES["cdc_reuse"](spark, "/root/testdata/sf0.001").collect()]
    sizes = dict(duckdb.sql("SELECT doc_id, strlen(coalesce(text, '')) FROM '/root/testdata/sf0.001/documents.parquet'").fetchall())
    assert all(r["n_bytes"] == sizes[r["doc_id"]] >= r["reused"] for r in rows) and len(rows) == sum(n > 0 for n in sizes.values())
    long = "".join(f"line {i} of a file that changes in one place\n" for i in range(900))
    docs = spark.createDataFrame([(1, long), (2, long[:20000] + "edit!" + long[20005:])], "doc_id long, text string")
    assert all(len(r) for r in texts.chunks(docs).collect())
    reuse = {r["doc_id"]: r["reused"] for r in texts.chunk_reuse(docs).collect()}
    assert reuse[1] == 0 and reuse[2] > 0.6 * len(long)


def test_reduced_keeps_diagnostics(spark):
    log = "\n".join(f"test t{i} ... ok" for i in range(400)) + "\ntest auth ... FAILED\n\x1b[31merror: expected 200, got 401\x1b[0m\n" + "noise\n" * 50 + "\n".join(f"x {i}" for i in range(200))
    out = texts.reduce_payloads(spark.createDataFrame([(1, log), (2, "short"), (3, None)], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["reduced"] for r in out}
    assert "error: expected 200, got 401" in by[1] and "FAILED" in by[1] and "t7 ... ok" not in by[1] and "noise  ×50" in by[1]
    assert len(by[1]) * 4 < len(log) and by[2] == "short" and by[3] == ""


def test_frames(spark):
    code = "class Store:\n    def get(self):\n        return 1\n\n    def put(self):\n        pass\n\ndef main():\n    pass\nerror: it broke\n"
    rows = texts.frames(spark.createDataFrame([(1, code), (2, None)], "doc_id long, text string")).collect()
    assert {(r["name"], r["first"], r["last"]) for r in rows if r["kind"] == "symbol"} == {("Store", 1, 7), ("get", 2, 4), ("put", 5, 7), ("main", 8, 10)}
    assert ("it broke", 10, 10) in {(r["name"], r["first"], r["last"]) for r in rows}


def test_ledger_stream(spark, tmp_path):
    def turn(second: int, output: int) -> str:
        return json.dumps({"timestamp": f"2026-01-05T10:00:{second:02d}+09:00", "type": "assistant", "session": "s", "message": {"model": "m", "usage": {"input_tokens": 5, "output_tokens": output}}})

    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join([turn(1, 10), turn(2, 20), "{broken", '{"type":"user"}']))
    ledger.sync(ledger.read_turns(spark, inbox), out, mark)
    (tmp_path / "in/b.jsonl").write_text("\n".join([turn(2, 20), turn(3, 30)]))
    ledger.sync(ledger.read_turns(spark, inbox), out, mark)
    rows = spark.read.parquet(out)
    assert sorted(r["output_tokens"] for r in rows.collect()) == [10, 20, 30]
    assert [(r["turns"], r["output"], r["hour"].hour) for r in ledger.hourly(rows).collect()] == [(3, 60, 10)]


def test_signals_and_digits(spark):
    docs = spark.createDataFrame([(1, "All fine\nERROR 12"), (2, "All fine\nERROR 13"), (3, "no digits"), (4, None), (5, "no digits")], "doc_id long, text string")
    assert [tuple(r) for r in texts.signal_counts(docs).orderBy("doc_id").collect()] == [(1, 1), (2, 1)]
    assert [(r["n"], r["variants"], r["first_id"]) for r in texts.digit_variants(docs).collect()] == [(2, 2, 1)]
    assert [(r["doc_id"], r["pos"], r["line"]) for r in texts.lines(docs).where("doc_id = 2").orderBy("pos").collect()] == [(2, 0, "All fine"), (2, 1, "ERROR 13")]


def test_simhash_folds_as_the_reference():
    pairs = {
        "at 12:30:05.7 id 3fa9-bc x1f ox": "at # id # # ox",
        "GET /a/b.c?d=1 then /.x or / y": "GET /path then /path or / y",
        "a \t\n b\x0bc": "a b\x0bc",
        "0xffz x9": "#z #",
    }
    assert {t: texts.folded(t).decode() for t in pairs} == pairs
    assert texts.folded("é") == "é".encode().decode("latin-1").encode()


def test_simhash_pairs_name_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    members = {r["doc_id"]: r for r in QUERIES["simhash_members"](spark, "/root/testdata/sf0.001").collect()}
    assert len(members) == rows.count()
    least = {}
    for d, r in members.items():
        least[r["simhash"]] = min(d, least.get(r["simhash"], d))
    assert all(r["class_id"] == least[r["simhash"]] for r in members.values())
    links = QUERIES["simhash_pairs"](spark, "/root/testdata/sf0.001").collect()
    assert all((r["a_class"], r["b_class"]) == (least[r["a"]], least[r["b"]]) for r in links)
    again = spark.createDataFrame([(1, "ran at 12:30:05 in /tmp/a"), (2, "ran at 9:15:59 in /var/b"), (3, "ok"), (4, "no"), (5, None)], "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in texts.simhash_members(texts.simhash_trigrams(again)).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_chunks_cut_as_byte_by_byte(spark):
    rng = random.Random(3)
    letters = "abcdefghij klmnop\né"
    docs = [(i, "".join(rng.choices(letters, k=n))) for i, n in enumerate([1, 511, 512, 513, 2047, 2049, 8191, 8193, 60_000, 60_000, 200_000])]
    docs += [(100, "a" * 30_000)] + duckdb.sql("SELECT doc_id + 1000, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    want, by_middle = [], 0
    for d, text in docs:
        body = (text or "").encode()
        start = h = 0
        for i, b in enumerate(body):
            h = ((h << 1) + (b + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)
            size = i - start + 1
            middle = size >= 2048 and h & 1023 == 0
            if size >= 8192 or (size >= 512 and h & 2047 == 0) or middle or i + 1 == len(body):
                by_middle += middle and h & 2047 != 0 and size < 8192
                want.append((d, start, size))
                start, h = i + 1, 0
    got = texts.chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert by_middle and sorted((r["doc_id"], r["offset"], r["len"]) for r in got) == sorted(want)


def test_tfidf_counts_tokens_that_contain(spark):
    docs = [(1, "idiots all around"), (2, "idiotic idiotic words and more"), (3, "men spoke"), (4, None), (5, "other words only"), (6, "ment a q")]
    query = ["idiot", "and", "menteau", "q"]
    tokens = {d: re.findall(r"\w+", (t or "").lower()) for d, t in docs}
    match = lambda t, q: t == q or (min(len(t), len(q)) >= 2 and (q in t or t in q))
    df = Counter(t for ts in tokens.values() for t in set(ts))
    want = {}
    for d, ts in tokens.items():
        for q in query:
            if hits := sum(match(t, q) for t in ts):
                of = df.get(q) or max(n for t, n in df.items() if match(t, q))
                want[d] = want.get(d, 0) + hits / len(ts) * max(math.log((len(docs) + 1) / (of + 1)), 0) * (0.6 if len(q) <= 2 else 1 if len(q) <= 5 else 1.3)
    got = texts.tfidf_containing(spark.createDataFrame(docs, "doc_id long, text string"), query).collect()
    assert {r["doc_id"]: r["score"] for r in got} == {d: pytest.approx(s, abs=1e-8) for d, s in want.items()} and set(want) == {1, 2, 3, 6}
    assert len(QUERIES["tfidf_rank_containing"](spark, FOLDER).collect()) == 16
