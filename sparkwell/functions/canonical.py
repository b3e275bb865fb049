"""Texts and JSON without what changes from run to run, and hashes of prompt prefixes made of them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose values change from run to run.
VOLATILE = ("timestamp", "generated_at", "now", "date", "time", "current_time", "request_id", "uuid", "nonce", "sessionStartTime")
#: A clock time (its digits are tested where they tell it from other text) and a UUID; Java and Python read these alike.
CLOCK = r"[0-9]{4}-[\s\S]{5}T[\s\S]{2}:[\s\S]{2}:[\s\S]{2}(?:[.][0-9]*)?[Zz]?"
UUID = r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
EITHER = re.compile(f"({CLOCK})|{UUID}")
#: What stands between the parts of a prefix.
BETWEEN = "\n\x1e\n"


def plain(text: str) -> str:
    return EITHER.sub(lambda m: "<ts>" if m[1] else "<id>", text)


def normal_form(value: object) -> object:
    """Sorted keys, volatile ones dropped at every depth, clocks and ids in strings replaced."""
    if isinstance(value, dict):
        return {k: normal_form(value[k]) for k in sorted(value) if k not in VOLATILE}
    if isinstance(value, list):
        return [normal_form(v) for v in value]
    return plain(value) if isinstance(value, str) else value


def canonical_json(text: str) -> str | None:
    """The normal form without spaces; None for what is no JSON. Of keys that repeat the last counts."""
    try:
        return json.dumps(normal_form(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def _each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical_json(t))


def canonical(text: Column) -> Column:
    """JSON in its normal form, other text with its line ends, clocks and ids made alike. Only what may be JSON goes through Python."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    may_be = lines.rlike(r'^[ \t\n]*(?:[\[{"0-9-]|true|false|null)')
    stripped = F.regexp_replace(F.regexp_replace(lines, CLOCK, "<ts>"), UUID, "<id>")
    return F.coalesce(F.pandas_udf(_each, "string")(F.when(may_be, lines)), stripped)


def prefix_hash(*parts: Column) -> Column:
    """Equal for prefixes whose parts have equal canonical forms; null parts are empty."""
    return F.sha2(F.concat_ws(BETWEEN, *[F.coalesce(canonical(p), F.lit("")) for p in parts]), 256)
