"""Column functions: token estimates, hashes, time buckets, clock layers, prices. All stay inside code generation."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwell.functions.catalog import ALIASES, CATALOG

WORD = r"[^ \t\n\f\r]+"
#: Characters a token by kind of text (ASCII, other).
DIVISORS = {"code": (3.3, 1.1), "shell": (3.9, 1.1), "json": (2.9, 1.1), "prose": (4.2, 1.1), "cjk": (3.8, 0.9), "binary": (3.0, 1.1)}
INPUT_USD = {model: usd for model, usd, _ in CATALOG}


def estimated_tokens(text: Column, kind: str = "prose") -> Column:
    """Tokens of a text by its characters and words; 0 for an empty or null one."""
    ascii_, other = DIVISORS[kind]
    plain = F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    by_chars = plain / F.lit(ascii_) + (F.char_length(text) - plain) / F.lit(other)
    by_words = F.regexp_count(text, F.lit(WORD)) * F.lit(1.3)
    return F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.round(F.greatest(by_chars, by_words)), F.lit(1.0))).cast("long")


def normalized_hash(text: Column) -> Column:
    """Equal for texts that differ in white space only."""
    return F.sha2(F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), " "), 256)


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))


def bucket(seconds: Column, width: int, offset: int = 0) -> Column:
    """The start of the local time bucket that holds a moment."""
    return ((F.floor((seconds + offset) / width) * width) - offset).cast("long")


def reduction_pct(avoided: Column, raw: Column) -> Column:
    return F.when(raw == 0, F.lit(0.0)).otherwise(F.round(avoided * 100.0 / raw)).cast("long")


def layer(referenced: Column, age: Column) -> Column:
    """hot: referenced in the last 15 minutes; warm: referenced, or of the last day; cold: the rest."""
    return F.when(referenced & (age <= 900), "hot").when(referenced | (age <= 86400), "warm").otherwise("cold")


def canonical_model(model: Column) -> Column:
    names = F.create_map(*map(F.lit, chain.from_iterable(ALIASES.items())))
    return F.coalesce(names[model], model)


def input_price(model: Column) -> Column:
    prices = F.create_map(*map(F.lit, chain.from_iterable(INPUT_USD.items())))
    return prices[canonical_model(model)]


def round_usd(x: Column) -> Column:
    return F.round(x * 1e6) / 1e6


def uncached_input(harness: Column, tokens: Column, read: Column, written: Column) -> Column:
    """Some providers count cached tokens in their input."""
    return F.when(harness == "codex", F.greatest(tokens - F.greatest(read, F.lit(0)) - written, F.lit(0))).otherwise(tokens)


def signal_line(line: Column) -> Column:
    return F.lower(line).rlike("fail|error|panic|exception")


#: Prefixes and suffixes of model ids, and words that tell the provider, in order.
MODEL_PREFIXES = ("cursor/", "openai/", "anthropic/", "google/", "xai/")
MODEL_SUFFIXES = ("-thinking-max", "-thinking", "-xhigh", "-high", "-medium", "-med", "-low", "-max", "-fast")
PROVIDERS = {"anthropic": ("claude", "anthropic"), "openai": ("gpt", "o3", "o4", "codex"), "xai": ("grok",), "google": ("gemini",), "deepseek": ("deepseek",), "cursor": ("composer",)}
#: Output, cache read, 5-minute and 1-hour cache write and reasoning as multiples of the input price, by words in the model id, in order.
FAMILIES = (
    (("claude", "anthropic"), (5.0, 0.1, 1.25, 2.0, 5.0)),
    (("gpt", "o3", "o4", "codex", "sol", "terra", "luna"), (8.0, 0.25, 1.0, 1.0, 8.0)),
    (("grok", "composer"), (3.0, 0.1, 1.0, 1.0, 3.0)),
    (("deepseek",), (2.0, 0.02, 1.0, 1.0, 2.0)),
    ((), (4.0, 0.1, 1.0, 1.0, 4.0)),
)
#: Models with a context window of 200,000 tokens; others have 128,000.
WIDE_MODELS = ("opus", "sonnet", "gpt-5", "gpt-4.1", "gpt-4o")


def model_parts(raw: Column) -> Column:
    """struct(base, effort, thinking, provider) of a model id: one provider prefix and one suffix go."""
    bare = F.regexp_replace(F.trim(raw), f"^({'|'.join(MODEL_PREFIXES)})", "")
    suffix = F.regexp_extract(bare, f"({'|'.join(MODEL_SUFFIXES)})$", 1)
    effort = F.when(suffix.isin("-thinking-max", "-max"), "max").when(suffix == "-thinking", "").otherwise(F.ltrim(suffix, F.lit("-")))
    provider = F.lit("")
    for name, words in reversed(PROVIDERS.items()):
        provider = F.when(F.lower(raw).rlike("|".join(words)), name).otherwise(provider)
    thinking = bare.contains("thinking") | bare.contains("reason")
    return F.struct(F.left(bare, F.length(bare) - F.length(suffix)).alias("base"), effort.alias("effort"), thinking.alias("thinking"), provider.alias("provider"))


def model_label(model: Column) -> Column:
    """Title-cased on dashes; blank and unknown ones are Other, default and auto are Auto."""
    bare = F.trim(model)
    parts = F.transform(F.filter(F.split(bare, "-"), lambda p: p != ""), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2))))
    return F.when(F.lower(bare).isin("", "__unknown__", "unknown"), "Other").when(F.lower(bare).isin("default", "auto"), "Auto").otherwise(F.array_join(parts, "-"))


def context_window(model: Column) -> Column:
    return F.when(F.lower(model).rlike("|".join(WIDE_MODELS).replace(".", "[.]")), 200_000).otherwise(128_000)


def occupancy_pct(used: Column, window: Column) -> Column:
    """Whole percent of the window in use, 0 to 100."""
    return F.when(window <= 0, 0).otherwise(F.least(F.greatest(F.floor(used * 100 / window), F.lit(0)), F.lit(100))).cast("long")


def token_cap(raw: Column, kind: Column, exit_code: Column, signals: Column, fetched: Column, strategy: Column, tune: Column, occupancy: Column, compacting: Column) -> Column:
    """How many tokens a reduced payload may take; every step rounds."""
    whole = lambda c: F.floor(c + 0.5)
    shell, ok, bad = kind == "shell", exit_code == 0, exit_code.isNotNull() & (exit_code != 0)
    weight = F.when(shell & ok, 0.62).when(shell & bad, 1.35).when((kind == "mcp") & (signals > 0), 1.3).when(kind == "mcp", 0.7).otherwise(1.0)
    cap = whole(F.least(F.greatest(F.floor(raw * 15 / 100), F.lit(180)), F.lit(512)) * weight)
    cap = cap + F.least(signals, F.lit(12)) * 10 + F.when(fetched, 64).otherwise(0)
    cap = whole(cap * F.when(strategy == "extreme", 0.72).when(strategy == "conservative", 1.35).otherwise(1.0))
    cap = whole(cap * F.least(F.greatest(tune, F.lit(0.75)), F.lit(1.4)))
    cap = whole(cap * F.when(compacting, 0.8).when(occupancy == 0, 1.0).when(occupancy < 40, 1.15).when(occupancy > 70, 0.8).otherwise(1.0))
    quiet = (kind == "mcp") & (signals == 0)
    low = F.when(shell & ok, 120).when(shell & bad, 220).when(quiet, 120).otherwise(160)
    high = F.when(shell & ok, 280).when(shell & bad, 720).when(quiet, 320).otherwise(640)
    return F.least(F.greatest(cap, low), high).cast("long")


def token_kind(tool: Column, text: Column) -> Column:
    """Kind of text for the token estimate, by its first 4,000 characters."""
    sample = F.left(text, F.lit(4000))
    n = F.char_length(sample)
    other = n - F.char_length(F.regexp_replace(sample, r"[^\x00-\x7F]", ""))
    dense = n - F.char_length(F.regexp_replace(sample, "[A-Za-z0-9+/=]", ""))
    by_tool = F.when(tool == "file", "code").when(tool == "mcp", "json").when(tool == "shell", "shell").otherwise("prose")
    json = F.ltrim(sample, F.lit(" \t\n\r")).rlike(r"^[{\[]") & sample.contains(":")
    return F.when((n > 0) & (other * 100 >= n * 20), "cjk").when(json, "json").when((n > 80) & (F.floor(dense * 100 / n) > 92), "binary").otherwise(by_tool)


def canonical_text(text: Column) -> Column:
    """Without what changes from run to run: line ends as \\n, times as <ts>, UUIDs as <id>."""
    out = F.regexp_replace(text, "\r\n", "\n")
    out = F.regexp_replace(out, r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?", "<ts>")
    return F.regexp_replace(out, "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<id>")


def seconds_of(value: Column) -> Column:
    """Unix seconds of a number, a numeric string (over 1e10: milliseconds) or an RFC 3339 time, whose zone is ignored."""
    number = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    clock = F.unix_seconds(F.try_to_timestamp(F.substring(value, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return F.when(number > 1e10, F.floor(number / 1000)).when(number.isNotNull(), F.floor(number)).otherwise(clock).cast("long")


def compact_number(x: Column) -> Column:
    return F.when(x >= 1_000_000, F.format_string("%.2fM", x / 1e6)).when(x >= 1_000, F.format_string("%.2fK", x / 1e3)).otherwise(x.cast("string"))


def resolve_window(name: str, now: int, today: int, since: int | None = None, until: int | None = None) -> tuple[str, int, int, int]:
    """(key, since, until, bucket seconds) of a named range of time; ``today`` is the last local midnight."""
    days = {"1d": 1, "24h": 1, "14d": 14, "30d": 30}
    if name == "custom" and since is not None and until is not None:
        first = min(since, until, now)
        key, last = "custom", max(min(max(since, until), now), first)
    elif name == "today":
        key, first, last = "today", today, now
    else:
        key = "1d" if name == "24h" else name if name in days else "7d"
        first, last = now - 86400 * days.get(name, 7), now
    span = max(last - first, 1)
    width = 3600 if span <= 2 * 86400 else 86400 if span <= 45 * 86400 else 7 * 86400
    return key, first, last, width


def grid(since: int, until: int, width: int, zone: int = 0) -> tuple[int, int, int]:
    """(first bucket, last bucket, width): the width doubles, to a week at most, until 48 buckets will do."""
    align = lambda t, w: (t + zone) // w * w - zone
    while width < 7 * 86400 and (align(until, width) - align(since, width)) // width + 1 > 48:
        width *= 2
    return align(since, width), align(until, width), width
