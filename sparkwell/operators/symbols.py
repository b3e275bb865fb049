"""Symbols of source texts with the lines that they span, and frames of one name that lie close together as one.

A text with a line that begins with ``def`` or ``async def`` is read by indentation, any other by braces: the depth after a line is the sum of
its braces and those before, never below 0; braces in strings and comments don't count. A symbol ends on the first later line where the depth is
back to what it was before it, or at the text's end; one that opens no brace on its line, and ends it with neither brace nor
semicolon, may open it on the next.

Defined cases: null and empty texts have no symbols; names have two characters at least,
and a colon after a name belongs to it; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a symbol's line begins with, in order; visibility that goes before it.
PREFIXES = (
    "pub async fn ", "pub fn ", "async fn ", "fn ", "async def ", "def ", "class ", "export async function ", "export function ", "export class ",
    "function ", "pub struct ", "pub enum ", "pub trait ", "impl ", "func ", "interface ", "type ",
)
VISIBILITY = ("pub(crate) ", "pub(super) ", "pub(self) ")
#: Characters of a signature; lines between frames of one name that make one frame.
SIGNATURE, GAP = 80, 2
SYMBOL = re.compile(f"(?:{'|'.join(map(re.escape, VISIBILITY))})?({'|'.join(map(re.escape, PREFIXES))})([A-Za-z0-9_:]{{2,}})")
#: A string, also an open one, or a comment to the line's end.
SILENT = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?$)|//.*')
TAB = 4


def _signature(line: str) -> str:
    bare = line.strip()
    cut = next((bare.index(c) for c in "{:" if c in bare), len(bare))
    head = bare[:cut].strip()
    return head if len(head) <= SIGNATURE else head[: SIGNATURE - 1] + "…"


def _ends_by_braces(lines: list[str], starts: list[int]) -> list[int]:
    """The last line (from 0) of each symbol that starts on ``starts``."""
    code = [SILENT.sub("", x) for x in lines]
    depth = list(accumulate((x.count("{") - x.count("}") for x in code), lambda d, x: max(d + x, 0), initial=0))  # depth[i]: before line i
    ends, waiting = dict.fromkeys(starts, len(lines) - 1), []
    begins = set(starts)
    for i in range(len(lines)):
        while waiting and depth[i + 1] <= depth[waiting[-1]]:
            ends[waiting.pop()] = i
        if i in begins:
            opens = depth[i + 1] > depth[i] or ("{" not in code[i] and not code[i].rstrip().endswith(";"))
            if opens:
                waiting.append(i)
            else:
                ends[i] = i
    return [ends[i] for i in starts]


def _ends_by_indent(lines: list[str], starts: list[int]) -> list[int]:
    """Up to the last line with content before one that is indented no deeper."""
    content = [i for i, x in enumerate(lines) if x.strip() and not x.strip().startswith(("#", "//"))]
    margin = lambda x: sum(TAB if c == "\t" else 1 for c in x[: len(x) - len(x.lstrip(" \t"))])
    ends, waiting, last = {}, [], 0
    begins = set(starts)
    for i in content:
        while waiting and margin(lines[i]) <= margin(lines[waiting[-1]]):
            ends[waiting.pop()] = last
        last = i
        if i in begins:
            waiting.append(i)
    return [max(ends.get(i, last), i) for i in starts]


def symbol_spans(text: str) -> list[tuple[str, str, int, int, str]]:
    """(name, keyword, first, last, signature), lines from 1, by first line."""
    lines = [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")] if text else []
    by_indent = any(x.strip().startswith(("def ", "async def ")) for x in lines)
    found = {i: m for i, x in enumerate(lines) if (m := SYMBOL.match(x.strip())) and not (by_indent and x.strip().startswith(("#", "//")))}
    ends = (_ends_by_indent if by_indent else _ends_by_braces)(lines, list(found))
    return [(m[2], m[1].split()[-1], i + 1, end + 1, _signature(lines[i])) for (i, m), end in zip(found.items(), ends)]


def symbols(docs: DataFrame) -> DataFrame:
    """(doc_id, name, keyword, first, last, signature) of texts (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *s) for d, t in zip(pdf["doc_id"], pdf["text"]) for s in symbol_spans(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "keyword", "first", "last", "signature"])

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, name string, keyword string, first long, last long, signature string")


def merged_frames(frames: DataFrame, gap: int = GAP) -> DataFrame:
    """(doc_id, name, kind, first, last, hint): frames of one text, name and kind that begin at most ``gap`` lines after another's end are one."""
    w = Window.partitionBy("doc_id", "name", "kind").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = frames.withColumn("_new", F.when(F.col("first") <= reach + gap, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first_hint = F.min_by("hint", F.when(F.coalesce("hint", F.lit("")) != "", F.struct("first", "last")))
    return runs.groupBy("doc_id", "name", "kind", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.coalesce(first_hint, F.lit("")).alias("hint")).drop("_run")
