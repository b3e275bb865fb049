"""Line-first quality rules, with DataFrame functions only and no shuffle.

Each line is judged by itself: a line fails if it is mostly punctuation, if it is a navigation bar, or if it
is boilerplate. Failing lines are removed; a document that loses more than ``MAX_LOST`` of its word
characters is rejected. Counts of the whole text (words, symbols, repeated lines and 5-word windows) make a
base test that comes first.

Defined cases: a null text has no words and fails the base test; so does an empty one; lines without a word
are neutral; repeated rows are judged one by one; an empty table gives an empty result; columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A document that loses more than this share of its word characters is rejected.
MAX_LOST = 0.5
SPACE_RUN = r"[ \t\n\x0B\f\r]+"
SYMBOLS = r"[#*$%&|<>]"
#: Marks that no prose line has more often than once every four words.
SHOUTS = r"[!?]{2,}|[.]{4,}|[=~_^]{3,}|[*#$%&]{2,}"
SEPARATORS = r"(^|\s)[|»›•·>/](\s|$)"
BOILERPLATE = (
    r"(?i)\b(cookie (policy|settings|notice)|uses cookies|accept (all )?cookies|privacy policy|terms of (use|service)|terms and conditions"
    r"|click here|read more|sign (in|up)|log ?in|subscribe (now|to)|newsletter|share (this|on)|follow us|back to top|skip to (main )?content"
    r"|enable javascript|javascript (is|must)|powered by|add to cart|lorem ipsum)\b"
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), lambda w: w != "")


def measured(line: Column) -> Column:
    """(line, n, marks): the line, its words and its characters that are neither letters, digits nor spaces."""
    n = F.regexp_count(line, F.lit(r"[^ \t\n\x0B\f\r]+"))
    marks = F.char_length(F.regexp_replace(line, r"[\p{L}\p{N} \t\n\x0B\f\r]+", ""))
    return F.struct(line.alias("line"), n.alias("n"), marks.alias("marks"))


def failing(m: Column) -> Column:
    """True for a measured line that has words and breaks a rule; the cheap conditions come first."""
    line, n, marks = m["line"], m["n"], m["marks"]
    letters = F.char_length(F.regexp_replace(line, r"[^\p{L}\p{N}]+", ""))
    # More marks than letters or digits, or a shout for fewer than four words: either takes a mark for fewer than four words.
    punctuation = (marks * 4 > n) & ((letters < marks) | (F.regexp_count(line, F.lit(SHOUTS)) * 4 > n))
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = (marks >= 3) & (separators >= 3) & (separators * 5 >= n)
    return (n > 0) & (punctuation | navigation | line.rlike(BOILERPLATE))


def _repeat_words() -> Column:
    """Words inside 5-word windows that the text holds twice or more, from ``windows``, their hashes in order."""
    twice = F.expr("""
        transform(array(sort_array(transform(windows, (k, i) -> struct(k as k, i as i)))), z ->
            aggregate(
                sort_array(transform(
                    filter(sequence(0, size(z) - 1), j -> (j > 0 and get(z, j).k = get(z, j - 1).k) or (j < size(z) - 1 and get(z, j).k = get(z, j + 1).k)),
                    j -> get(z, j).i)),
                named_struct('at', -5, 'total', 0),
                (a, p) -> named_struct('at', p, 'total', a.total + least(5, p - a.at)),
                a -> a.total))[0]
    """)
    return F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0)).otherwise(twice)


def judge(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """(row, doc_id, text, cleaned, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_share, base_failed, kept).

    ``row`` is the input row as a struct; Spark reads its columns only if they are used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.struct("*").alias("row"), "doc_id", "text", words_of(F.col("text")).alias("words"), F.split(text, "\n", -1).alias("lines"))
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    windows = F.when(F.col("n") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.expr("transform(sequence(0, n - 5), i -> xxhash64(get(hashes, i), get(hashes, i + 1), get(hashes, i + 2), get(hashes, i + 3), get(hashes, i + 4)))")
    )
    counted = hashed.withColumn("windows", windows).select(
        "row",
        "doc_id",
        "text",
        "lines",
        F.transform("lines", measured).alias("measured"),
        F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _repeat_words().cast("long").alias("n_repeat_words"),
    )
    counted = counted.withColumns({
        "with_words": F.transform(F.filter("measured", lambda m: m["n"] > 0), lambda m: m["line"]),
        "good": F.transform(F.filter("measured", lambda m: ~failing(m)), lambda m: m["line"]),
    })
    base = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    good_chars = F.char_length(F.array_join(words_of(F.col("cleaned")), ""))
    cleaned = F.when(F.size("good") == F.size("lines"), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join("good", "\n"))
    lost = F.when(F.size("good") == F.size("lines"), F.lit(0.0)).otherwise(1 - good_chars / F.greatest(F.col("word_chars"), F.lit(1)))
    judged = counted.withColumn("cleaned", cleaned).withColumn("lost_share", lost)
    # One row of one struct, unpacked: a filter on the result isn't pushed below this, where it would be evaluated with
    # all that it depends on inside the lambdas that use it.
    return judged.select(
        F.inline(F.array(F.struct(
            "row",
            "doc_id",
            "text",
            "cleaned",
            "n_words",
            "word_chars",
            "n_symbols",
            (F.size("with_words") - F.size(F.array_distinct("with_words"))).cast("long").alias("n_dup_lines"),
            "n_repeat_words",
            (F.size("lines") - F.size("good")).cast("long").alias("n_failed_lines"),
            "lost_share",
            base.alias("base_failed"),
            (~base & (F.col("lost_share") <= max_lost)).alias("kept"),
        )))
    )
