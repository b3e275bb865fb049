"""Scaled sketches, the Merkle manifest and phrase mining against plain Python, on the awkward fixture and a small driver table."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
from sparkwell.llm import collocations, merkle, sketches
from tests.llm import brute, fixtures

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    return fixtures.write(str(tmp_path_factory.mktemp("awkward")), fixtures.texts())


def rows_of(folder: str, columns: str) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/documents.parquet'").fetchall()


def bag(rows) -> Counter:
    return Counter(map(tuple, rows))


# Sketches


def shingles(text: str | None) -> set[str]:
    w = brute.words((text or "").translate(LOWER))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def share(a: set, b: set) -> float:
    a, b = sorted((a, b), key=len)
    return len(a & b) / len(a) if a else float(not b)


def in_order(docs: list[tuple]) -> list[list[tuple]]:
    """Groups of rows that share an id; their order is the operator's own."""
    groups: dict = {}
    for d, t in docs:
        groups.setdefault(d, []).append(t or "")
    return [(d, groups[d]) for d in sorted(groups, key=lambda d: (d is None, d))]


@pytest.mark.parametrize("where", ["awkward", "small"])
@pytest.mark.parametrize("scale", [1, 4])
def test_sketches(spark, awkward, where, scale):
    folder = awkward if where == "awkward" else SMALL
    docs = rows_of(folder, "doc_id, text")
    got = sketches.against_next(spark.read.parquet(f"{folder}/documents.parquet"), scale).collect()
    assert bag((r["doc_id"], r["n_chars"]) for r in got) == bag((d, len(t or "")) for d, t in docs)
    groups = in_order(docs)
    flat = {(i, t): (d, t) for i, (d, ts) in enumerate(groups) for t in ts}
    want: dict = {}
    for i, (d, ts) in enumerate(groups):
        nexts = set(ts) | set(groups[(i + 1) % len(groups)][1]) if len(ts) > 1 else set(groups[(i + 1) % len(groups)][1])
        for t in ts:
            for n in nexts:
                cut = len(t) // 4
                new = t[: len(t) - cut] + n[:cut]
                want.setdefault((d, len(t), hashlib.sha256(new.encode()).hexdigest()), []).append((share(shingles(t), shingles(new)), share(shingles(t), shingles(n)), len(shingles(t))))
    assert flat
    off = []
    for r in got:
        near = want[r["doc_id"], r["n_chars"], r["edited_sha256"]]
        best = min(near, key=lambda w: abs(w[0] - r["near_edited"]) + abs(w[1] - r["near_next"]))
        if scale == 1:
            assert (r["near_edited"], r["near_next"]) == pytest.approx(best[:2], abs=1e-9)
        elif best[2] > 100:
            off.append(abs(best[0] - r["near_edited"]))
    assert scale == 1 or np.mean(off) < 0.08


def test_sketch_properties(spark):
    a, b = fixtures.prose(1, 900), fixtures.prose(2, 400)
    whole = a + "\n" + b
    assert sketches.encode(sketches.sketch(a)) == sketches.encode(sketches.sketch(a.upper().replace(" ", "  ")))
    both = sketches.union(sketches.sketch(a), sketches.sketch(b))
    seam = " ".join(a.split()[-4:] + b.split()[:4])
    assert set(sketches.sketch(whole)) - set(both) <= set(sketches.sketch(seam, scale=1)) and set(both) <= set(sketches.sketch(whole))
    kept = sketches.sketch(whole)
    assert (sketches.decode(sketches.encode(kept)) == kept).all() and kept.max() < 2**48 / 4
    assert sketches.containment(sketches.sketch(b), kept) == 1.0 > sketches.containment(kept, sketches.sketch(b))
    assert len(sketches.sketch("one")) == 1 and len(sketches.sketch(None)) == 0
    docs = spark.createDataFrame([("x", a), ("x", b), ("x", None), ("y", b), ("z", "one")], "source string, text string")
    merged = sketches.merged(sketches.sketched(docs, "source"), "source")
    of = lambda s: {r["hash"] for r in merged.where(f"source = '{s}'").collect()}
    assert of("x") == set(both.tolist()) and of("y") == set(sketches.sketch(b).tolist()) and len(of("z")) == 1
    found = sketches.containments(merged.withColumnRenamed("source", "a"), merged.withColumnRenamed("source", "b"), "a", "b").where("a <> b")
    got = {(r["a"], r["b"]): r["containment"] for r in found.collect()}
    assert got == {("y", "x"): 1.0, ("x", "y"): pytest.approx(len(of("y")) / len(of("x")))}


# Manifest


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """rows: (doc_id, source, lang, n_chars, text)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))

    def climb(nodes: list[str]) -> tuple[str, list[list[list[str]]]]:
        """The root, and for each node the siblings' levels."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
            for p, i in zip(paths, at):
                p.append((runs[i // 8][: i % 8], runs[i // 8][i % 8 + 1 :]))
            at, nodes = [i // 8 for i in at], [sha("".join(r)) for r in runs]
        return nodes[0], paths

    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (own, *climb([leaf(r) for r in own]))
    root, upper = climb([trees[n][1] for n in names])
    out = []
    for name, up in zip(names, upper):
        own, subroot, paths = trees[name]
        for r, path in zip(own, paths):
            path = path + up
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf((*r[:4], r[4].translate(LOWER) if changed and r[4] is not None else r[4]))
            for before, after in path:
                node = sha("".join(before) + node + "".join(after))
            out.append((r[0], leaf(r), subroot, root, sha("".join("".join(b + a) for b, a in path)), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("where", ["awkward", "small"])
def test_manifest(spark, awkward, where):
    folder = awkward if where == "awkward" else SMALL
    want = plain_manifest(rows_of(folder, "doc_id, source, lang, n_chars, text"))
    assert bag(QUERIES["op12_merkle_manifest"](spark, folder).select(*COLUMNS).collect()) == bag(want)
    assert {v for *_, v in want} == {True, False}
    assert bag(duckdb.sql(SQL["op12_merkle_manifest"].replace("FROM documents", f"FROM '{folder}/documents.parquet'")).select(*COLUMNS).fetchall()) == bag(want)


@pytest.mark.parametrize("sizes", [(1,), (1, 8), (9, 64, 65), (513, 7)])
def test_manifest_shapes(spark, sizes):
    rows = [(i * 7 % 1000 + 1000 * k, f"s{i}", f"l{k}", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    out = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    got = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["verified"]) for r in out.collect()]
    assert bag(got) == bag((*w[:4], True) for w in plain_manifest(rows))


def test_forests_merge_in_any_order():
    rng = random.Random(4)
    trees = merkle.Trees({0: 100, 1: 9, 2: 1})
    leaves = {(t, 0, i): merkle.digest(f"{t} {i}") for t, n in {0: 100, 1: 9, 2: 1}.items() for i in range(n)}
    whole = trees.merge(leaves, {})
    for _ in range(5):
        keys = rng.sample(sorted(leaves), len(leaves))
        cuts = sorted(rng.sample(range(1, len(keys)), 6))
        parts = [trees.merge({k: leaves[k] for k in keys[a:b]}, {}) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        while len(parts) > 1:
            a, b = (parts.pop(rng.randrange(len(parts))) for _ in range(2))
            parts.append(trees.merge(a, b))
        assert parts[0] == whole and whole[trees.root(merkle.TOP)]


# Phrases


def plain_phrases(docs: list[tuple], least: int, top: int) -> list[tuple]:
    """docs: (lang, text)."""
    f, n, out = {}, Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        rows.sort()
        out += [(lang, i + 1, p.decode(), a, l, r, n[lang], -s) for i, (s, _, p, a, l, r) in enumerate(rows[:top])]
    return out


@pytest.mark.parametrize("where", ["awkward", "small"])
def test_phrases(spark, awkward, where, monkeypatch):
    folder = awkward if where == "awkward" else SMALL
    docs = rows_of(folder, "lang, text")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for least, top in ((30, 2000), (3, 40)):
        got = collocations.phrases(spark.read.parquet(f"{folder}/documents.parquet"), least=least, top=top)
        want = plain_phrases(docs, least, top)
        assert bag(got.select(*columns).collect()) == bag(want) and want
    monkeypatch.setattr(collocations, "FLAGS", 32768)  # so few that many hashes collide
    got = collocations.phrases(spark.read.parquet(f"{folder}/documents.parquet"), least=2, top=50)
    assert bag(got.select(*columns).collect()) == bag(plain_phrases(docs, 2, 50))


def test_scores_are_whole_quotients(spark):
    text = "a b. " * 31 + "a c. " * 3 + "d b. " * 7 + "% _ \\ x. " * 40
    (row,) = [r for r in collocations.phrases(spark.createDataFrame([(None, text)], "lang string, text string")).collect() if r["phrase"] == "a b"]
    assert (row["lang"], row["score"]) == ("und", math.floor(2_000_000 * 31 / (34 + 38)))
