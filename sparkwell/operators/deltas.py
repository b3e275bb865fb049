"""What changed between a text and the version before it: versions meet by id in Spark, each pair is compared in its task."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.functions.columns import DIVISORS, WORD
from sparkwell.operators.symbols import symbol_spans
from sparkwell.operators.texts import DIAGNOSTIC, chunk_ends

#: Lines of context, most edits and lines, least lines, least share of known lines, most hunks, least gain in tokens.
CONTEXT, MOST_EDITS, MOST_LINES, LEAST_LINES, LEAST_SHARED, MOST_HUNKS, LEAST_GAIN = 2, 256, 16_000, 8, 0.72, 24, 80
#: Lines whose change says nothing: blank ones and comments.
TRIVIA = re.compile(r"\s*($|//|#|/\*|\*|<!--)")


def tokens(text: str) -> int:
    """As functions.columns.estimated_tokens for prose."""
    ascii_, other = DIVISORS["prose"]
    plain = sum(c < "\x80" for c in text)
    best = max(plain / ascii_ + (len(text) - plain) / other, len(re.findall(WORD, text)) * 1.3)
    return max(math.floor(best + 0.5), 1) if text else 0


def text_lines(text: str) -> list[str]:
    rows = text.split("\n")
    return [x.removesuffix("\r") for x in (rows if rows[-1] else rows[:-1])]


def edits(a: list[str], b: list[str], most: int = MOST_EDITS) -> list[tuple[str, int, int]] | None:
    """A shortest script of (" ", "-" or "+", line of a, line of b) from a to b, or None if it needs more than ``most`` edits.

    The common start is kept. For each number of edits the furthest point on each diagonal is kept with the chain of its edits.
    """
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    n, m = len(a), len(b)
    reached: dict[int, tuple[int, tuple | None]] = {}
    for d in range(most + 1):
        nearer, reached = reached, {}
        for k in range(-d, d + 1, 2):
            if d == 0:
                x, chain = head, None
            else:
                ways = []
                if (after := nearer.get(k + 1)) and after[0] - (k + 1) < m:
                    ways.append((after[0], 1, ("+", after[0], after[0] - k - 1, after[1])))
                if (before := nearer.get(k - 1)) and before[0] < n:
                    ways.append((before[0] + 1, 0, ("-", before[0], before[0] - k + 1, before[1])))
                if not ways:
                    continue
                x, _, chain = max(ways, key=lambda w: w[:2])
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            if x == n and x - k == m:
                return _script(chain, len(a), len(b))
            reached[k] = (x, chain)
    return None


def _script(chain: tuple | None, n: int, m: int) -> list[tuple[str, int, int]]:
    """The whole script of a chain of edits (last one first): the lines between them are kept."""
    changes = []
    while chain:
        changes.append(chain[:3])
        chain = chain[3]
    out: list[tuple[str, int, int]] = []
    x = y = 0
    for sign, i, j in [*reversed(changes), ("", n, m)]:
        out += [(" ", x + s, y + s) for s in range(i - x)]
        if sign:
            out.append((sign, i, j))
        x, y = i + (sign == "-"), j + (sign == "+")
    return out


def hunks(a: list[str], b: list[str], script: list[tuple[str, int, int]]) -> list[tuple[str, bool]]:
    """(text, whether only trivia changes) of each run of changes with its context; runs up to twice the context apart are one."""
    runs: list[list[int]] = []
    for i, (sign, _, _) in enumerate(script):
        if sign != " ":
            if runs and i - runs[-1][1] - 1 <= 2 * CONTEXT:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    out = []
    for first, last in runs:
        part = script[max(first - CONTEXT, 0) : last + CONTEXT + 1]
        old, new = [i for s, i, _ in part if s != "+"], [j for s, _, j in part if s != "-"]
        rows = [(s, b[j] if s == "+" else a[i]) for s, i, j in part]
        top = f"@@ -{(old[0] if old else len(a)) + 1},{len(old)} +{(new[0] if new else len(b)) + 1},{len(new)} @@\n"
        out.append((top + "".join(f"{s}{x}\n" for s, x in rows), all(s == " " or TRIVIA.match(x) for s, x in rows)))
    return out


def comparable(a: list[str], b: list[str], least: int = LEAST_LINES) -> bool:
    """Whether two versions are long and alike enough for a line diff, and short enough for one."""
    known = set(a)
    return min(len(a), len(b)) >= least and len(a) + len(b) <= MOST_LINES and sum(x in known for x in b) >= LEAST_SHARED * len(b)


def line_delta(prev: str, text: str, budget: int) -> str | None:
    """The hunks that turn ``prev`` into ``text``; None if the two share little, only trivia changes, or the gain is small."""
    a, b = text_lines(prev), text_lines(text)
    script = edits(a, b) if comparable(a, b) else None
    found = hunks(a, b, script) if script else []
    told = [block for block, trivia in found if not trivia][: MOST_HUNKS + 1]
    # The first hunk is shown whatever it costs, then as many as the budget holds.
    sums = list(accumulate((tokens(x) + 1 for x in told), initial=tokens("line diff\n")))[1:]
    fit = max(sum(s <= max(budget, 80) for s in sums), 1)
    shown = told[: min(fit, MOST_HUNKS)]
    cut = fit < min(len(told), MOST_HUNKS)
    out = "line diff\n" + "".join(shown) + f"… {len(found) - len(shown)} more hunks\n" * cut
    return out if shown and tokens(out) + LEAST_GAIN < tokens(text) else None


def line_deltas(docs: DataFrame, pairs: DataFrame, budget: int = 400) -> DataFrame:
    """(doc_id, prev_id, delta) for the pairs (doc_id, prev_id) whose delta is worth sending. Texts meet by id."""
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pairs.join(own, "doc_id").join(own.select(F.col("doc_id").alias("prev_id"), F.col("text").alias("prev")), "prev_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            delta = [line_delta(p, t, budget) for p, t in zip(pdf["prev"], pdf["text"])]
            yield pdf[["doc_id", "prev_id"]].assign(delta=delta).dropna(subset=["delta"])

    return both.select("doc_id", "prev_id", "prev", "text").mapInPandas(work, f"doc_id {kind}, prev_id {kind}, delta string")


# Recipes: a version told by what it keeps of the one before.

#: Tokens that a recipe of chunks must save; lines that a set of lines needs.
CHUNK_GAIN, SET_LINES = 40, 40
#: Tokens that a kept run costs to name.
KEEP_COST = 8


def by_chunks(text: str) -> list[str]:
    """Content-defined chunks, moved to the next character's start."""
    body = text.encode()
    ends = [e + next(i for i in range(5) if e + i >= len(body) or body[e + i] & 0xC0 != 0x80) for e in chunk_ends(body)]
    return [body[a:b].decode() for a, b in zip([0, *ends], ends) if a < b]


def cut_at(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """A text in pieces: each outermost span of lines (from 1), and what lies between."""
    lines = by_lines(text)
    out, at = [], 0
    for first, last in sorted(spans):
        if first - 1 >= at:
            out += ["".join(lines[at : first - 1]), "".join(lines[first - 1 : last])]
            at = last
    return [x for x in [*out, "".join(lines[at:])] if x]


def by_failures(text: str) -> list[str]:
    """Blocks of lines that tell of failures, and what lies between."""
    hits = [i for i, x in enumerate(text.split("\n"), 1) if DIAGNOSTIC.search(x)]
    runs: list[tuple[int, int]] = []
    for i in hits:
        if runs and i <= runs[-1][1] + 2:
            runs[-1] = (runs[-1][0], i)
        else:
            runs.append((i, i))
    return cut_at(text, runs) if runs else []


def by_symbols(text: str) -> list[str]:
    spans = [(first, last) for _, _, first, last, _ in symbol_spans(text)]
    return cut_at(text, spans) if len(spans) > 1 else []


def by_lines(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+$", text)


def recipe(prev: list[str], now: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, "") for a run that stands in the version before at these characters, (-1, -1, text) for a new one."""
    ends = list(accumulate(map(len, prev)))
    place = {p: (e - len(p), e) for p, e in reversed(list(zip(prev, ends)))}
    out: list[tuple[int, int, str]] = []
    for piece in now:
        start, end = place.get(piece, (-1, -1))
        if out and start >= 0 and out[-1][1] == start:
            out[-1] = (out[-1][0], end, "")
        elif out and start < 0 and out[-1][0] < 0:
            out[-1] = (-1, -1, out[-1][2] + piece)
        else:
            out.append((start, end, "" if start >= 0 else piece))
    return out


def diff_recipe(prev: str, text: str) -> list[tuple[int, int, str]]:
    """The recipe of a shortest line script, empty where two versions are not comparable."""
    a, b = by_lines(prev), by_lines(text)
    script = edits(a, b) if comparable(a, b) else None
    ends = [0, *accumulate(map(len, a))]
    out: list[tuple[int, int, str]] = []
    for sign, i, j in script or []:
        if sign == " " and out and out[-1][1] == ends[i]:
            out[-1] = (out[-1][0], ends[i + 1], "")
        elif sign == " ":
            out.append((ends[i], ends[i + 1], ""))
        elif sign == "+" and out and out[-1][0] < 0:
            out[-1] = (-1, -1, out[-1][2] + b[j])
        elif sign == "+":
            out.append((-1, -1, b[j]))
    return out


def rebuilt(prev: str, steps: list[tuple[int, int, str]]) -> str:
    return "".join(prev[a:b] if a >= 0 else new for a, b, new in steps)


def recipe_cost(steps: list[tuple[int, int, str]]) -> int:
    return sum(tokens(new) + 1 if a < 0 else KEEP_COST for a, _, new in steps)


def version_delta(prev: str, text: str, file: bool) -> tuple[str, list[tuple[int, int, str]]] | None:
    """(kind, recipe) of the first way that saves enough: chunks (files only), failures, symbols, line diff, known lines; None if none does or nothing changed."""
    if prev == text or not prev or not text:
        return None
    shared = set(by_lines(prev))
    rows = by_lines(text)
    alike = min(len(rows), len(by_lines(prev))) >= SET_LINES and sum(x in shared for x in rows) >= LEAST_SHARED * len(rows)
    ways = [("chunks", CHUNK_GAIN, lambda: recipe(by_chunks(prev), by_chunks(text)))] * file
    ways += [(name, LEAST_GAIN, lambda cut=cut: recipe(cut(prev), cut(text)) if cut(prev) else []) for name, cut in (("failures", by_failures), ("symbols", by_symbols))]
    ways += [("line diff", LEAST_GAIN, lambda: diff_recipe(prev, text)), ("lines", LEAST_GAIN, lambda: recipe(by_lines(prev), rows) if alike else [])]
    for name, gain, make in ways:
        steps = make()
        if any(a >= 0 for a, _, _ in steps) and recipe_cost(steps) + gain < tokens(text):
            return name, steps
    return None


def version_deltas(docs: DataFrame, pairs: DataFrame, file: bool = True) -> DataFrame:
    """(doc_id, prev_id, kind, raw, cost, steps) for the pairs (doc_id, prev_id) that a recipe tells for fewer tokens. Texts meet by id."""
    kind = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = pairs.join(own, "doc_id").join(own.select(F.col("doc_id").alias("prev_id"), F.col("text").alias("prev")), "prev_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, p, prev, text in zip(pdf["doc_id"], pdf["prev_id"], pdf["prev"], pdf["text"]):
                if found := version_delta(prev, text, file):
                    steps = [{"start": a, "end": b, "new": new} for a, b, new in found[1]]
                    rows.append((d, p, found[0], tokens(text), recipe_cost(found[1]), steps))
            yield pd.DataFrame(rows, columns=["doc_id", "prev_id", "kind", "raw", "cost", "steps"])

    return both.select("doc_id", "prev_id", "prev", "text").mapInPandas(work, f"doc_id {kind}, prev_id {kind}, kind string, raw long, cost long, steps array<struct<start:long,end:long,new:string>>")
