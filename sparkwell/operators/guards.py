"""Guards: a payload is replaced by an excerpt only if it is long enough and the excerpt saves enough.

Payloads are rows (``doc_id``, ``text``, ``tool``, ``task`` as an array of words, ``command``, ``exit_code``); null texts are empty and
never replaced. What SQL functions say stays there; only the reducers by tool run in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkwell.functions.columns import estimated_tokens, signal_line, token_cap
from sparkwell.functions.excerpts import command_header, let, ranked_excerpt, raw_tokens, sifted
from sparkwell.operators.reducers import reduce_by_tool

#: Tokens that a payload has at least, and tokens that its excerpt saves at least.
GENERIC_LEAST, GENERIC_GAIN = 1200, 120
SHELL_LEAST, SHELL_GAIN = 80, 40
#: Colours, titles and carriage returns of terminals.
CONTROL = r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[()][A-Z0-9]|\r"


def capped(rows: DataFrame, tool: str = "tool", text: str = "text", exit_code: str | None = None, least: int = 0) -> DataFrame:
    """``rows`` of ``least`` tokens and more with ``raw`` and ``cap``: the tokens of a payload, and how many its excerpt may take."""
    body = F.coalesce(F.col(text), F.lit(""))
    signals = F.size(F.filter(F.split(body, "\n", -1), signal_line)).cast("long")
    code = F.lit(None).cast("int") if exit_code is None else F.col(exit_code)
    cap = lambda n: token_cap(F.col("raw"), F.col(tool), code, n, F.lit(False), F.lit("balanced"), F.lit(1.0), F.lit(0), F.lit(False))
    measured = sifted(rows, F.struct(raw_tokens(F.col(tool), body).alias("raw")), lambda e: e["raw"] >= least)
    return measured.withColumn("cap", let(signals, cap))


def generic_guard(payloads: DataFrame) -> DataFrame:
    """(doc_id, raw, cap, delivered, text) of the payloads that an excerpt replaces."""
    rows = capped(payloads, least=GENERIC_LEAST)
    excerpt = let(F.regexp_replace("text", CONTROL, ""), lambda t: ranked_excerpt(t, F.col("task"), F.col("cap")))
    told = let(excerpt, lambda x: F.struct(x.alias("_shown"), estimated_tokens(x, "shell").alias("delivered")))
    raw = F.col("raw")
    return sifted(rows, told, lambda e: e["delivered"] + GENERIC_GAIN < raw).select("doc_id", "raw", "cap", F.col("_shown").alias("text"), "delivered")


def shell_guard(payloads: DataFrame) -> DataFrame:
    """(doc_id, kind, raw, delivered, text) of the shell outputs that their tool's reduced form replaces, under command and exit code."""
    measured = let(F.coalesce("text", F.lit("")), lambda t: F.struct(t.alias("_t"), raw_tokens(F.lit("shell"), t).alias("raw")))
    rows = sifted(payloads.select("doc_id", "command", "exit_code", "text"), measured, lambda e: e["raw"] >= SHELL_LEAST).drop("text")
    # What the guard needs of a row goes through the reducers with it: a join back would build all payloads twice.
    reduced = reduce_by_tool(rows, text="_t", keep=("raw", "command", "exit_code"))
    shown = command_header(F.col("command"), F.col("exit_code"), F.col("reduced"))
    told = let(shown, lambda t: F.struct(t.alias("text"), estimated_tokens(t, "shell").alias("delivered")))
    raw = F.col("raw")
    return sifted(reduced, told, lambda e: e["delivered"] + SHELL_GAIN < raw).select("doc_id", "kind", "raw", "text", "delivered")


def filled(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """``rows`` that a budget for each group buys in order, with ``used``; a row that is too dear is skipped, later ones may fit.

    Each group passes through one task in order, with one number as its state. Rows dearer than the budget never get there, nor do
    rows without a cost.
    """
    sorted_ = rows.where((F.col(cost) >= 0) & (F.col(cost) <= budget)).repartition(group).sortWithinPartitions(group, *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = None, None
        for batch in batches:
            keep, sums = [], []
            for g, c in zip(batch.column(group).to_pylist(), batch.column(cost).to_pylist()):
                if used is None or g != last:
                    last, used = g, 0
                fits = used + c <= budget
                used += c if fits else 0
                keep.append(fits)
                sums.append(used)
            whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "used"])
            yield whole.filter(pa.array(keep, pa.bool_()))

    return sorted_.mapInArrow(walk, StructType([*rows.schema.fields, StructField("used", LongType())]))
