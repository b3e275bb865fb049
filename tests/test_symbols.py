"""Symbols against a parser that reads character by character, merging against plain Python, and recipes that rebuild."""

from __future__ import annotations

import random

import pytest

from sparkwell.operators import deltas, symbols

HEADS = ["fn alpha() {", "pub fn beta(x: u32) -> u8 {", "class Gamma {", "impl Delta {", "fn eps()", "func zeta() { return }", "type Eta = u8;", "interface Theta {"]
BODY = ["x = 1;", "}", "{", "", 'say("}{");', 'say("\\"}");', "// } not this {", "call(); } // {", 'open("unclosed {', "} else {"]


def braces_by_character(text: str) -> list[tuple[str, int, int]]:
    """(name, first, last): one character at a time."""
    lines = text.removesuffix("\n").split("\n")
    depth, open_, out = 0, [], []
    for n, line in enumerate(lines, 1):
        before, quoted, escaped, seen, last = depth, False, False, False, ""
        for i, c in enumerate(line):
            if escaped:
                escaped = False
            elif quoted:
                escaped, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif line[i : i + 2] == "//":
                break
            else:
                depth += (c == "{") - (c == "}")
                seen |= c == "{"
                last = c if c.strip() else last
        depth = max(depth, 0)
        for s in [s for s in open_ if depth <= s[2]]:
            out.append((s[0], s[1], n))
            open_.remove(s)
        if m := symbols.SYMBOL.match(line.strip()):
            if depth > before or (not seen and last != ";"):
                open_.append((m[2], n, before))
            else:
                out.append((m[2], n, n))
    return sorted(out + [(name, n, len(lines)) for name, n, _ in open_], key=lambda s: s[1])


@pytest.mark.parametrize("seed", range(30))
def test_braces(seed):
    rng = random.Random(seed)
    text = "\n".join(" " * rng.randrange(3) + rng.choice(HEADS if rng.random() < 0.3 else BODY) for _ in range(60)) + "\n" * rng.randrange(2)
    assert [(s[0], s[2], s[3]) for s in symbols.symbol_spans(text)] == braces_by_character(text)


def test_indentation_and_rows(spark):
    code = "class Store:\n    def get(self):\n        return 1\n\n    async def put(self):\n\tpass\n\n# end\ndef main():\n    pass\n\n"
    rows = symbols.symbols(spark.createDataFrame([(1, code), (2, None), (3, ""), (4, "fn x() {\n}")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["name"], r["keyword"], r["first"], r["last"]) for r in rows] == [(1, "Store:", "class", 1, 6), (1, "get", "def", 2, 3), (1, "put", "def", 5, 5), (1, "main", "def", 9, 10)]
    assert symbols.symbol_spans("pub(crate) fn long_" + "n" * 90 + "() {\n}")[0][4].endswith("n…")


def test_merging(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), rng.choice("ab"), "fail", f := rng.randrange(60), f + rng.randrange(5), rng.choice([None, "", f"h{f}"])) for _ in range(60)]
    want = []
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[4])):
        if want and want[-1][:2] == r[:2] and r[3] <= want[-1][4] + 2:
            want[-1] = (*want[-1][:4], max(want[-1][4], r[4]))
        else:
            want.append((r[0], r[1], r[2], r[3], r[4]))
    got = symbols.merged_frames(spark.createDataFrame(rows, "doc_id long, name string, kind string, first long, last long, hint string"))
    assert sorted((r["doc_id"], r["name"], r["kind"], r["first"], r["last"]) for r in got.collect()) == sorted(want)


def versions() -> dict[str, tuple[str, str, bool]]:
    big = "".join(f"line {i} of a file, with é and words {i * i}\n" for i in range(900))
    code = "".join(f"fn part_{i}() {{\n" + "".join(f"    step({j + i});\n" for j in range(12)) + "}\n\n" for i in range(12))
    log = "".join(f"test case_{i} ... ok\n" for i in range(120)) + "error: case_3 failed\n" + "".join(f"test more_{i} ... ok\n" for i in range(60))
    plain = "".join(f"row {i} of plain words\n" for i in range(300))
    shuffled = plain.split("\n")[:-1]
    random.Random(2).shuffle(shuffled)
    return {
        "chunks": (big, big[:20_000] + "edit!" + big[20_005:], True),
        "failures": (log, log + "error: case_7 failed\n  left: 1\n" + log[:400], False),
        "symbols": (code, code.replace("step(9);", "step(99);", 2), False),
        "line diff": (plain, plain.replace("row 7 of", "row seven of").replace("row 70 of", "row"), False),
        "lines": (plain, "\n".join([*shuffled[:10], "a new row", *shuffled[200:], plain[: 22 * 120].rstrip("\n")]), False),
    }


def test_recipes_rebuild_the_new_version():
    for kind, (prev, text, file) in versions().items():
        found = deltas.version_delta(prev, text, file)
        assert found and deltas.rebuilt(prev, found[1]) == text, kind
        assert found[0] == kind
        for cut in (deltas.by_chunks, deltas.by_failures, deltas.by_symbols, deltas.by_lines):
            assert "".join(cut(text)) in (text, "")
            assert cut(prev) == [] or deltas.rebuilt(prev, deltas.recipe(cut(prev), cut(text))) in (text, "")
    assert deltas.version_delta("a", "a", True) is None and deltas.version_delta("", "b", True) is None and deltas.version_delta("a\n", "b\n", True) is None


def test_rows_of_recipes(spark):
    texts = [t for prev, text, _ in versions().values() for t in (prev, text)] + [None, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(i + 1, i) for i in range(0, len(texts) - 1, 2)], "doc_id long, prev_id long")
    rows = deltas.version_deltas(docs, pairs).collect()
    assert len(rows) >= 4 and all(deltas.rebuilt(texts[r["prev_id"]], [(s["start"], s["end"], s["new"]) for s in r["steps"]]) == texts[r["doc_id"]] for r in rows)
    assert all(r["cost"] < r["raw"] for r in rows) and {r["kind"] for r in rows} >= {"chunks"}
