"""Budgeted excerpts as columns: which lines of a text are worth their tokens. Folds over arrays of lines, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.functions.columns import estimated_tokens, token_kind

#: What a line that decides the next edit starts with, contains, or (in any case) starts with or contains.
STARTS = ("--> ", "error[", "error: ", "error TS", "FAILED ", "FAIL ", "--- FAIL:", "FAIL\t", "warning:", "AssertionError", "Error: expect", "× ", "✖ ", "thread '", "assertion ", "assert ", "E   ")
HOLDS = ("error TS", "panicked at", "^^^^^")
ANY_CASE = ("left:", "right:", "^expected:", "^received:", "expected `", "expected:.*found", "found.*expected:", "assertionerror", "assert .*==", "==.*assert ", "mismatched types", "cannot find")
#: Points of a diagnostic, of each task word, of the first and last lines, and of a marked line.
DIAGNOSTIC, TASK, EDGE, MARKED = 24, 8, 2, 6
EDGE_LINES, WHOLE_LINES, LEAST_BUDGET = 8, 40, 80
#: Lines of a preview's head and tail.
HEAD, TAIL = 12, 16


def _plain(text: str) -> str:
    return "".join("\\" + c if c in "[^$.|?*+(){}\\" else c for c in text)


#: One pattern for all rules; Java and RE2 read it alike.
DIAGNOSTIC_LINE = f"^(?:{'|'.join(map(_plain, STARTS))})|{'|'.join(map(_plain, HOLDS))}|(?i:{'|'.join(ANY_CASE)})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where the optimizer copies an expression into another one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sifted(rows: DataFrame, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with the fields of a struct, where ``keep`` holds of it. The struct is worked out once a row; a filter above a
    projection would be moved below it with a copy of the whole expression."""
    return rows.select("*", F.inline(F.filter(F.array(value), keep)))


def lines_of(text: Column) -> Column:
    """The lines of a text; a line end at its end opens no further one, and carriage returns before line ends go."""
    rows = F.split(F.regexp_replace(text, "\n$", ""), "\n", -1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(rows, lambda x: F.regexp_replace(x, "\r$", "")))


def is_diagnostic(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "").rlike(DIAGNOSTIC_LINE)


def cost(line: Column) -> Column:
    """Tokens of a line and its end."""
    return estimated_tokens(line, "shell") + 1


def shown(lines: Column, kept: Column) -> Column:
    """The kept lines (positions from 0, ascending), each with its end; a gap between two is marked."""
    before = lambda j: F.get(kept, j - 1)
    row = lambda i, j: F.concat(F.when((j > 0) & (i > before(j) + 1), F.lit("…\n")).otherwise(F.lit("")), F.get(lines, i), F.lit("\n"))
    return F.array_join(F.transform(kept, row), "")


def _headed(lines: Column, kept: Column) -> Column:
    return F.concat(F.size(kept).cast("string"), F.lit("/"), F.size(lines).cast("string"), F.lit(" lines\n\n"), shown(lines, kept))


def line_points(line: Column, i: Column, n: Column, task: Column) -> Column:
    points = F.when(is_diagnostic(line), DIAGNOSTIC).otherwise(0)
    points += F.size(F.filter(task, lambda t: (t != "") & F.lower(line).contains(F.lower(t)))) * TASK
    points += F.when((i < EDGE_LINES) | (i + EDGE_LINES >= n), EDGE).otherwise(0)
    return points + F.when(line.contains("^^^") | line.contains("-----"), MARKED).otherwise(0)


def ranked_lines(lines: Column, task: Column, budget: Column) -> Column:
    """Positions of the lines that a budget of tokens buys: the most points first, then the earliest; what is too dear is skipped.

    Diagnostics come first, and the first of them is taken whatever it costs. Lines without points are taken only if nothing else was.
    """
    points = lambda n: F.transform(lines, lambda x, i: F.struct((-line_points(x, i, n, task)).alias("p"), i.alias("i"), cost(x).cast("long").alias("c")))
    ranked = F.array_sort(let(F.size(lines), points))
    most = F.greatest(budget, F.lit(LEAST_BUDGET))

    def take(had: Column, x: Column) -> Column:
        none, fits = F.size(had["kept"]) == 0, had["used"] + x["c"] <= most
        good = F.when(x["p"] <= -DIAGNOSTIC, fits | none).otherwise(fits & ((x["p"] < 0) | none))
        more = F.struct((had["used"] + x["c"]).alias("used"), F.concat(had["kept"], F.array(x["i"])).alias("kept"))
        return F.when(good, more).otherwise(had)

    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))
    return F.array_sort(F.aggregate(ranked, start, take)["kept"])


def ranked_excerpt(text: Column, task: Column, budget: Column) -> Column:
    """The lines that a budget buys under their number; a text of up to 40 lines whole."""
    of = lambda lines: F.when(F.size(lines) <= WHOLE_LINES, text).otherwise(let(ranked_lines(lines, task, budget), lambda kept: _headed(lines, kept)))
    return let(lines_of(text), of)


def previewed_lines(lines: Column, most: int) -> Column:
    """Positions of the first and last lines and of the first ``most`` diagnostics."""
    n = F.size(lines)
    places = F.transform(lines, lambda x, i: F.when(is_diagnostic(x), i))
    found = F.slice(F.filter(places, lambda i: i.isNotNull()), 1, most)
    edges = F.filter(F.transform(lines, lambda x, i: i), lambda i: (i < HEAD) | (i >= n - TAIL))
    return F.array_sort(F.array_distinct(F.concat(edges, found)))


def preview(lines: Column, kept: Column, text: Column, whole_below: int) -> Column:
    return F.when(F.size(lines) <= whole_below, text).otherwise(_headed(lines, kept))


def lock_fill(lock: Column, fill: Column, budget: Column) -> Column:
    """``lock`` whole, then lines of ``fill`` in order until the first that the budget does not hold; empty ones are passed over."""
    bare = F.regexp_replace(F.coalesce(lock, F.lit("")), r"\s+$", "")
    head = F.when(bare == "", bare).otherwise(F.concat(bare, F.lit("\n")))
    start = F.struct(head.alias("text"), estimated_tokens(head, "shell").alias("used"), (estimated_tokens(head, "shell") >= budget).alias("full"))

    def add(had: Column, line: Column) -> Column:
        x = F.regexp_replace(line, r"\s+$", "")
        used = had["used"] + cost(x)
        full = F.struct(had["text"].alias("text"), had["used"].alias("used"), F.lit(True).alias("full"))
        more = F.struct(F.concat(had["text"], x, F.lit("\n")).alias("text"), used.alias("used"), F.lit(False).alias("full"))
        return F.when(had["full"] | (F.coalesce(x, F.lit("")) == ""), had).when(used > budget, full).otherwise(more)

    return F.aggregate(fill, start, add)["text"]


def raw_tokens(tool: Column, text: Column) -> Column:
    """Tokens of a payload by the kind of text that it is."""

    def of(kind: Column) -> Column:
        out = estimated_tokens(text, "prose")
        for name in ("shell", "json", "code", "binary", "cjk"):
            out = F.when(kind == name, estimated_tokens(text, name)).otherwise(out)
        return out

    return let(token_kind(tool, text), of)


def command_header(command: Column, exit_code: Column, body: Column) -> Column:
    """The command (80 characters at most) and its exit code, where the body does not show them itself."""
    bare = F.trim(F.coalesce(command, F.lit("")))
    short = F.when(F.char_length(bare) > 80, F.concat(F.left(bare, F.lit(79)), F.lit("…"))).otherwise(bare)
    first = F.when((bare == "") | body.startswith("$ "), F.lit("")).otherwise(F.concat(F.lit("$ "), short, F.lit("\n")))
    second = F.when(exit_code.isNull() | body.rlike("(?m)^exit "), F.lit("")).otherwise(F.concat(F.lit("exit "), exit_code.cast("string"), F.lit("\n")))
    head = F.concat(first, second)
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n"), body))
