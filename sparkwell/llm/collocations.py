"""Phrase collocation mining: word runs that occur together more than their parts would let expect.

Texts are split into pieces at punctuation and line ends, and pieces into words; a phrase never crosses pieces. All n-grams of
1 to ``max_n`` words are exploded into rows and counted by language with partial aggregation before the shuffle. A phrase can't
be more frequent than any part of it, so the rows of an n-gram that holds a shorter one of fewer than
``least`` occurrences need not be made: it is no candidate and no part of one. Which ones these are is told by a table
of ``FLAGS`` one-byte flags by hash, of that size whatever the corpus: an unlucky hash lets a row through, and none is lost, as counts
are exact. Candidates are joined with the counts of both parts at each cut, scored in decimal arithmetic, anti-joined with
their one-word extensions (a longer phrase that covers a phrase covers also one of these as often) and ranked by language.

Defined cases: a null text is empty; a null language is ``und``; repeated rows count each; pieces of spaces hold no word;
ties of the score go to the more frequent phrase, then to the bytewise smaller one; an empty table gives an empty result;
columns besides ``text`` and ``lang`` are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.llm.common import materialize, release
from sparkwell.llm.merkle import lowered

#: Words of a phrase.
MAX_N = 4
#: Occurrences that a candidate has at least.
LEAST = 30
#: Phrases of a language in the report.
TOP = 2000
#: A phrase is dropped if a longer one has this percentage of its occurrences.
COVERED = 80
#: Flags of what is frequent, a byte each: what is sent to the tasks, of this size for any corpus. A multiple of 32768.
FLAGS = 1 << 22
#: Slices of a language for the first of two rankings.
SLICES = 64
BREAKS = r"[.,;:!?\n\x0B\f\r]+"
EXACT = "decimal(38,0)"


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, words): the words of each piece that has some, in order."""
    split = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(lowered(F.coalesce(F.col("text"), F.lit(""))), BREAKS)).alias("piece"))
    bare = split.select("lang", F.trim("piece", F.lit(" \t")).alias("piece")).where("piece <> ''")
    return bare.select("lang", F.split("piece", "[ \t]+").alias("words"))


def _slot(h: Column) -> Column:
    return F.pmod(h, F.lit(FLAGS))


def _flags(spark: SparkSession, slots: DataFrame) -> Column:
    """The flags of all slots that occur, as one binary value that a plan reads once: ``FLAGS`` bytes."""
    one = F.col("slot") + 1  # these functions count from 1
    maps = slots.groupBy(F.bitmap_bucket_number(one).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    flags = np.zeros(FLAGS, np.uint8)
    for part, bits in maps.collect():  # FLAGS / 32768 rows of 4 KB at most
        start = (part - 1) * 32768
        some = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        flags[start : start + len(some)] = some
    return spark.createDataFrame([(bytearray(flags.tobytes()),)], "flags binary").scalar()


def _is_set(flags: Column, slot: Column) -> Column:
    return F.substring(flags, slot.cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def _told(flags: Column, lang: Column, words: list[Column]) -> Column:
    """Whether these words may be a frequent n-gram."""
    return _is_set(flags, _slot(F.xxhash64(lang, *words)))


def _counted(rows: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, f) of those with ``least`` occurrences."""
    return rows.groupBy("lang", "phrase").agg(F.count("*").alias("f")).where(F.col("f") >= least)


def counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of 1 to ``max_n`` words with ``least`` occurrences; (lang, n) of all words."""
    spark = docs.sparkSession
    source = materialize(pieces(docs), "phrase-pieces")
    totals = source.groupBy("lang").agg(F.sum(F.size("words")).cast("long").alias("n"))
    lang, words, at = F.col("lang"), F.col("words"), F.col("at")
    singles = materialize(_counted(source.select("lang", F.explode("words").alias("phrase")), least), "phrase-words")
    release(spark)
    out = singles.select("lang", F.lit(1).alias("size"), "phrase", "f")
    if max_n < 2:
        return out, totals
    word = lambda i: F.get(words, at + i) if i else F.col("w0")
    run = lambda i, n: [word(j) for j in range(i, i + n)]
    starts = source.where(F.size("words") >= 2).select("lang", "words", F.posexplode("words").alias("at", "w0"))
    known: dict[int, Column] = {}
    # n-grams are first counted by hash alone, shorter ones first, which moves half of their bytes; equal hashes can only add to a count.
    # Pairs are counted without a look at their words: nearly all words of a large corpus are frequent.
    for n in range(2, max_n):
        long = starts.where(word(n - 1).isNotNull())
        both = _told(known[n - 1], lang, run(0, n - 1)) & _told(known[n - 1], lang, run(1, n - 1)) if n > 2 else F.lit(True)
        hashes = long.where(both).select(F.xxhash64(lang, *run(0, n)).alias("h")).groupBy("h").agg(F.count("*").alias("f"))
        known[n] = _flags(spark, hashes.where(F.col("f") >= least).select(_slot(F.col("h")).alias("slot")))
        release(spark)
    # The longest n-gram from here on that may be frequent; all shorter ones from here on may be too. These are counted by their words.
    last = max_n - 1
    reach = F.lit(max_n) if last < 2 else F.when(word(last).isNotNull() & _told(known[last], lang, run(1, last)), F.lit(max_n)).otherwise(F.lit(last))
    for n in reversed(range(2, max_n)):
        reach = F.when(word(n - 1).isNotNull() & _told(known[n], lang, run(0, n)), reach).otherwise(F.lit(n - 1))
    reach = F.when(word(1).isNotNull(), reach).otherwise(F.lit(1))
    grams = starts.select("lang", "words", "at", reach.alias("reach")).where("reach >= 2").select("lang", "words", "at", F.explode(F.sequence(F.lit(2), "reach")).alias("size"))
    longer = _counted(grams.select("lang", F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("size"))).alias("phrase")), least)
    grams = materialize(longer.select("lang", F.size(F.split("phrase", " ")).alias("size"), "phrase", "f"), "phrase-grams")
    release(spark)
    return out.unionByName(grams), totals


def phrases(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    a, l, r: occurrences of the phrase and of its parts at its worst cut; score: floor(2000000 a / (l + r)).
    """
    f, totals = counts(docs, max_n, least)
    candidates = f.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("size") - F.col("k"))).alias("tail")
    )
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # Whole quotients: the decimal division would round, div cuts.
    score = F.expr(f"(cast(2000000 AS {EXACT}) * cast(a AS decimal(19,0))) div (cast(l AS {EXACT}) + cast(r AS {EXACT}))")
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"), F.col("a"))).alias("cut")).select("lang", "phrase", "cut.*").drop("k")
    # An extension by one word holds a phrase as its head or its tail.
    w, m = F.col("w"), F.col("size") - 1
    longer = candidates.where("size > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(F.concat_ws(" ", F.slice(w, F.lit(1), m)), F.concat_ws(" ", F.slice(w, F.lit(2), m)))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f")).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f")
    same = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
    free = worst.join(most, same & (F.col("f").cast(EXACT) * 100 >= F.col("a").cast(EXACT) * covered), "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    sliced = free.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
