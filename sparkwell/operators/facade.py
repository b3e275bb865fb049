"""Search over everything stored: frames first, then the text index, then the newest pages line by line; and the pages mapped for a task.

Queries are rows (``query_id``, ``needle``). What holds a needle is found by pairs of letters: stored lines are keyed by theirs, a
needle looks under its rarest pair only, and what it finds there is compared in full. So no needle meets all lines.

Defined cases: needles of less than two characters find nothing; letters A-Z count as a-z; null names, hints and texts are empty; ranks
are whole orders, the last key being the uri; empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.functions.columns import layer
from sparkwell.functions.tasks import token_overlap
from sparkwell.operators import index
from sparkwell.operators import needles as needle_sets
from sparkwell.sources.stored import stored

#: Hits of a search at least and at most, pages that the last resort reads, and rows of the map.
LEAST_HITS, MOST_HITS, NEWEST, MAPPED, EACH_KIND = 1, 16, 80, 12, 4
#: Points of overlap, of any overlap, of a hot and of a warm page, of a rare word, of TF-IDF, and of a failure.
OVERLAP, ANY, HOT, WARM, RARE, TFIDF, FAILED = 12, 6, 8, 3, 6, 18, 10
DAY, WEEK = 86_400, 7
#: Frames, first in the order of hits, in which each needle is looked up before all others.
FIRST_FRAMES = 4096


def folded(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def pairs_of(text: Column) -> Column:
    """The distinct pairs of neighbouring characters of a folded text."""
    # One pass over the text; cutting out each pair by its place would read the text from its start for each.
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1)))


def holding(needles: DataFrame, rows: DataFrame, body: str) -> DataFrame:
    """``needles`` (query_id, needle) joined with the ``rows`` whose folded ``body`` holds the folded needle.

    The needles, short texts, go to the rows; rows are taken apart into their pairs where they lie, and never shuffled once for each.
    """
    asked = needles.select("query_id", folded(F.col("needle")).alias("_needle")).where(F.char_length("_needle") >= 2)
    # The body is folded by a projection of its own, so that a pair of letters doesn't fold it again.
    keyed = rows.withColumn("_body", folded(F.col(body))).withColumn("_pair", F.explode(pairs_of(F.col("_body"))))
    wanted = asked.select("_needle").distinct().withColumn("_pair", F.explode(pairs_of(F.col("_needle"))))
    # A pair that no row has makes its needle's smallest count 0: then nothing holds the needle.
    counts = keyed.groupBy("_pair").agg(F.count("*").alias("_n"))
    rarest = wanted.join(counts, "_pair", "left").groupBy("_needle").agg(F.min_by("_pair", F.struct(F.coalesce("_n", F.lit(0)), F.col("_pair"))).alias("_pair"))
    found = keyed.join(F.broadcast(rarest), "_pair").where(F.col("_body").contains(F.col("_needle"))).select("_needle", *rows.columns)
    return asked.join(found, "_needle").select("query_id", *rows.columns)


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each query, numbered from 1."""
    k = min(max(k, LEAST_HITS), MOST_HITS)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def search_frames(needles: DataFrame, frames: DataFrame, k: int = MOST_HITS) -> DataFrame:
    """(query_id, rank, uri, name, kind, hint): frames (uri, name, kind, start_line, hint) whose name or hint holds the needle, failures first."""
    # A null character stands between the two, so no needle reaches over both.
    weight = F.when(F.col("kind") == "fail", 0).when(F.col("kind") == "error", 1).otherwise(2)
    rows = frames.withColumn("_both", F.concat_ws("\x00", F.coalesce("name", F.lit("")), F.coalesce("hint", F.lit("")))).withColumn("_weight", weight)
    order = ["_weight", "start_line", "uri", "name"]
    k = min(max(k, LEAST_HITS), MOST_HITS)
    # Equal needles are looked up once. Those that ``k`` of the first frames in the order hold have their hits there; only the
    # others, which few frames hold, are looked up in all frames.
    named = needles.select("query_id", folded(F.col("needle")).alias("_needle"))
    asked = stored(named.select(F.col("_needle").alias("query_id"), F.col("_needle").alias("needle")).distinct(), "frame-needles")
    parts = frames.sparkSession.sparkContext.defaultParallelism
    first = stored(rows.orderBy(*order).limit(FIRST_FRAMES), "frames-first").repartition(parts)
    early = stored(top(holding(asked, first, "_both"), k, *order), "frames-early")
    done = early.where(F.col("rank") == k).select("query_id")
    left = asked.join(done, "query_id", "left_anti").select(F.col("needle").alias("_needle"))
    found = needle_sets.found(left, rows.withColumn("_both", folded(F.col("_both"))), "_both", "frames-found")
    rest = top(found.withColumnRenamed("_needle", "query_id"), k, *order)
    best = early.join(done, "query_id", "left_semi").select(*rest.columns).unionByName(rest).withColumnRenamed("query_id", "_needle")
    return named.join(best, "_needle").select("query_id", "rank", "uri", "name", "kind", "hint")


def scan_newest(needles: DataFrame, pages: DataFrame, k: int = MOST_HITS) -> DataFrame:
    """(query_id, rank, uri, lines, snippet): of the newest pages (uri, text, created_at) those with the most lines that hold the needle."""
    newest = pages.orderBy(F.desc("created_at"), "uri").limit(NEWEST)
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\n$", "")
    lines = newest.select("uri", F.split(body, "\n", -1).alias("all")).select("uri", "all", F.posexplode("all").alias("pos", "line"))
    found = holding(needles, lines.select("uri", "pos", "line"), "line")
    by = found.groupBy("query_id", "uri").agg(F.count("*").alias("lines"), F.min("pos").alias("first"))
    # The line before the first hit and two after it, with their numbers.
    start = F.greatest(F.col("first") - 1, F.lit(0))
    shown = F.transform(F.slice("all", start + 1, F.col("first") + 3 - start), lambda x, i: F.concat(F.lpad((start + i + 1).cast("string"), 6, " "), F.lit(" | "), x))
    texts = newest.select("uri", F.split(body, "\n", -1).alias("all"))
    return top(by, k, F.desc("lines"), "uri").join(texts, "uri").select("query_id", "rank", "uri", "lines", F.array_join(shown, "\n").alias("snippet"))


def search(needles: DataFrame, frames: DataFrame, texts: index.Index, pages: DataFrame, k: int = MOST_HITS) -> DataFrame:
    """(query_id, rank, source, uri, detail): frames that hold the needle, then texts by BM25 that have none of these; if neither, the newest pages."""
    k = min(max(k, LEAST_HITS), MOST_HITS)
    # Three of the steps below read what the frames hold.
    framed = stored(search_frames(needles, frames, k).select("query_id", F.lit(0).alias("source"), F.col("rank").alias("place"), "uri", F.col("name").alias("detail")), "search-framed")
    # Equal needles are searched for once.
    named = needles.select("query_id", folded(F.col("needle")).alias("_needle"))
    scored = index.search(texts, named.select(F.col("_needle").alias("query_id"), F.col("_needle").alias("text")).distinct(), k)
    scored = named.join(scored.withColumnRenamed("query_id", "_needle"), "_needle").drop("_needle")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.select("query_id", F.lit(1).alias("source"), F.row_number().over(order).alias("place"), F.col("doc_id").alias("uri"), F.lit("").alias("detail"))
    texts_only = ranked.join(framed.select("query_id", "uri").distinct(), ["query_id", "uri"], "left_anti").select(*ranked.columns)
    found = framed.unionByName(texts_only)
    unfound = needles.join(framed.select("query_id").unionByName(ranked.select("query_id")).distinct(), "query_id", "left_anti")
    scanned = scan_newest(unfound, pages, k).select("query_id", F.lit(2).alias("source"), F.col("rank").alias("place"), "uri", F.col("snippet").alias("detail"))
    names = F.element_at(F.array(F.lit("frame"), F.lit("text"), F.lit("scan")), F.col("source") + 1)
    both = top(found.unionByName(scanned), k, "source", "place")
    return both.select("query_id", "rank", names.alias("source"), "uri", "detail")


def mapped_pages(pages: DataFrame, seen: DataFrame, asked: list[str], now: int, most: int = MAPPED) -> DataFrame:
    """(rank, uri, kind, layer, score): the pages to show for a task, at most ``EACH_KIND`` of a kind.

    ``pages``: (uri, kind, tokens as an array, summary, created_at); ``seen``: (uri, referenced, accessed_at), the last look at each; ``asked``: the task's tokens.
    """
    pages = stored(pages, "map-pages")  # three passes read it; tokens are cut from texts once
    hits = lambda q: token_overlap(F.col("tokens"), F.array(F.lit(q))) > 0
    n, *df = pages.agg(F.count("*"), *[F.count(F.when(hits(q), 1)).alias(f"df{i}") for i, q in enumerate(asked)]).first()
    held = pages.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    alike = lambda q: token_overlap(F.array("t"), F.array(F.lit(q))) > 0
    # How many pages have a word; if none has it as it is, the most that have one word which holds it or is held in it.
    own = held.agg(F.lit(0), *[F.coalesce(F.max(F.when(F.col("t") == q, F.col("n"))), F.max(F.when(alike(q), F.col("n"))), F.lit(0)) for q in asked]).first()[1:]
    rows = pages.join(seen, "uri", "left").withColumn("_at", F.coalesce("accessed_at", "created_at"))
    age = F.lit(now) - F.col("_at")
    where = layer(F.coalesce("referenced", F.lit(False)), age)
    overlap = token_overlap(F.col("tokens"), F.array(*map(F.lit, asked))) if asked else F.lit(0)
    rare = reduce(lambda s, q: s + F.when(hits(q[0]), max(round(math.log2((max(n, 1) + 1) / (max(q[1], 1) + 1)) * RARE), 0)).otherwise(0), zip(asked, df), F.lit(0))
    share = lambda q: F.size(F.filter("tokens", lambda t: token_overlap(F.array(t), F.array(F.lit(q))) > 0)) / F.greatest(F.size("tokens"), F.lit(1))
    weight = lambda q: 0.6 if len(q) <= 2 else 1.0 if len(q) <= 5 else 1.3
    semantic = reduce(lambda s, q: s + share(q[0]) * (max(math.log((n + 1) / (q[1] + 1)), 0.0) * weight(q[0])), zip(asked, own), F.lit(0.0))
    failed = F.lower(F.coalesce("summary", F.lit(""))).rlike("fail|error|panic|e0")
    recent = F.expr(f"({WEEK * DAY} - least(greatest(_age, 0), {WEEK * DAY})) div {DAY}")
    rows = rows.withColumns({"_age": age, "_layer": where, "_overlap": overlap, "_semantic": semantic}).where((F.col("_overlap") > 0) | (F.col("_semantic") > 0) | (F.col("_layer") != "cold"))
    score = F.col("_overlap") * OVERLAP + F.when(F.col("_layer") == "hot", HOT).when(F.col("_layer") == "warm", WARM).otherwise(0) + F.when(F.col("_overlap") > 0, ANY).otherwise(0)
    score = score + rare + F.round(F.col("_semantic") * TFIDF).cast("int") + F.when(failed, FAILED).otherwise(0) + recent
    scored = rows.select("uri", "kind", F.col("_layer").alias("layer"), score.cast("long").alias("score"), "created_at")
    order = [F.desc("score"), F.desc("created_at"), F.col("uri")]
    of_kind = scored.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("_r") <= EACH_KIND)
    best = of_kind.orderBy(*order).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "uri", "kind", "layer", "score")
