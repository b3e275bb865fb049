"""What has been seen before: each arriving payload against all that came before it, by one chain of look-ups.

An arrival (``at``, ``hash``, ``norm``, ``simhash``, ``digits``) is

``exact``       if its hash came before: it belongs to the first arrival with that hash;
``normalized``  else, if its normalized hash did: it belongs to the first of these;
``near``        else, if an earlier payload with the same digits has a simhash within ``radius`` bits: the nearest, of
                equally near ones the first;
``new``         else.

``match`` is the ``at`` of what an arrival belongs to, ``count`` how often that payload has come, this arrival included.
Every arrival with a new hash can be matched from then on. All candidates are compared, not the first few.

Defined cases: a null hash or normalized hash is a value like any other; a simhash of 0 or null has no near match; equal
``at`` go by hash, but such rows don't see one another's counts; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.functions.columns import digit_runs, normalized_hash
from sparkwell.operators.texts import BLOCKS, simhash_trigrams
from sparkwell.sources.stored import stored

RADIUS = 3
MASKS = [m - (1 << 64) if m >> 63 else m for m in (sum(((1 << w) - 1) << at for at, w in three) for three in combinations(BLOCKS, 3))]
#: Stretches of arrival order into which the count of one payload is split.
STRETCHES = 64


def near_keys(simhash: Column) -> Column:
    """(choice, value): 31 bits and more of a simhash, chosen in each of 20 ways; two within three bits share one."""
    return F.posexplode(F.array(*[simhash.bitwiseAND(F.lit(m)) for m in MASKS])).alias("choice", "value")


def arrivals_of(docs: DataFrame) -> DataFrame:
    """(at, hash, norm, simhash, digits) of texts (doc_id, text) that arrive in the order of their ids."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(F.col("doc_id").alias("at"), F.sha2(text, 256).alias("hash"), normalized_hash(text).alias("norm"), F.sha2(F.array_join(digit_runs(text), ","), 256).alias("digits"))
    return keys.join(simhash_trigrams(docs).withColumnRenamed("doc_id", "at"), "at")


def counted_before(events: DataFrame, key: str, order: str, weight: str) -> DataFrame:
    """``events`` with ``before``: the weights of the same key with a smaller ``order``.

    The order is cut into stretches that are summed apart, so a key that a third of all rows have is many tasks' work.
    """
    low, high = events.agg(F.min(order), F.max(order)).first()
    width = max(((high or 0) - (low or 0)) // STRETCHES + 1, 1)
    cut = events.withColumn("_stretch", F.expr(f"({order} - {low or 0}) div {width}"))
    local = Window.partitionBy(key, "_stretch").orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(F.col(key).alias("_key"), F.col("_stretch").alias("_s")).agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_key", "_s", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    placed = cut.withColumn("_local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    met = placed.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_s")))
    return met.withColumn("before", F.col("_local") + F.col("_offset")).drop("_stretch", "_key", "_s", "_local", "_offset")


def nearest(probes: DataFrame, entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(at, match, distance): for each probe (at, simhash, digits) the nearest earlier entry, of equally near ones the first."""
    if radius > 3:
        raise ValueError("the keys find what is within 3 bits")
    known = entries.where("simhash <> 0").groupBy("simhash", "digits").agg(F.min("at").alias("match"))
    asked = probes.where("simhash <> 0").select("at", "simhash", "digits")
    same = asked.join(known, ["simhash", "digits"]).where(F.col("match") < F.col("at")).select("at", "match", F.lit(0).alias("distance"))
    open_ = asked.join(same.select("at").hint("merge"), "at", "left_anti").select("at", "digits", F.col("simhash").alias("a"), near_keys(F.col("simhash")))
    side = known.select("match", "digits", F.col("simhash").alias("b"), near_keys(F.col("simhash")))
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int")
    close = open_.join(side, ["digits", "choice", "value"]).where((F.col("match") < F.col("at")) & (distance <= radius))
    best = close.groupBy("at").agg(F.min(F.struct(distance.alias("distance"), F.col("match"))).alias("m"))
    return same.unionByName(best.select("at", "m.match", "m.distance"))


def chained(arrivals: DataFrame) -> DataFrame:
    """``arrivals`` with ``kind`` (exact, normalized or open), ``match`` and ``entry``: whether the hash is new."""
    rank = F.struct("at", "hash")
    by_hash = arrivals.groupBy("hash").agg(F.min("at").alias("_first"))
    by_norm = arrivals.groupBy("norm").agg(F.min(rank).alias("_n"))
    a = arrivals.join(by_hash.withColumnRenamed("hash", "_hash"), F.col("hash").eqNullSafe(F.col("_hash"))).join(by_norm.withColumnRenamed("norm", "_norm"), F.col("norm").eqNullSafe(F.col("_norm")))
    entry = F.col("at") == F.col("_first")
    kind = F.when(~entry, "exact").when(F.col("at") > F.col("_n.at"), "normalized").otherwise("open")
    return a.select(*arrivals.columns, kind.alias("kind"), F.when(~entry, F.col("_first")).when(F.col("at") > F.col("_n.at"), F.col("_n.at")).alias("match"), entry.alias("entry"))


def concluded(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(at, kind, match, count, distance) from ``chained`` rows and the ``nearest`` of the open ones."""
    # Both sides have a row for each arrival: merged, as rows that compress well look small enough to be sent whole through the driver.
    joined = rows.join(near.withColumnRenamed("match", "_near").hint("merge"), "at", "left")
    kind = F.when(F.col("kind") != "open", F.col("kind")).when(F.col("_near").isNotNull(), "near").otherwise("new")
    told = joined.select("at", "hash", kind.alias("kind"), F.coalesce("match", "_near").alias("match"), F.coalesce("distance", F.lit(0)).alias("distance"))
    # How often had the matched payload come? Each arrival counts for its hash, and asks for its match's hash.
    hash_of = rows.where("entry").select(F.col("at").alias("match"), F.col("hash").alias("_of"))
    asks = told.where("match IS NOT NULL").join(hash_of, "match").select("at", F.col("_of").alias("hash"), F.lit(0).alias("n"), F.lit(True).alias("asks"))
    events = rows.select("at", "hash", F.lit(1).alias("n"), F.lit(False).alias("asks")).unionByName(asks)
    counts = counted_before(events, "hash", "at", "n").where("asks").select("at", (F.col("before") + 1).alias("count"))
    return told.join(counts.hint("merge"), "at", "left").select("at", "kind", "match", F.coalesce("count", F.lit(1)).cast("long").alias("count"), "distance")


def remembered(arrivals: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(at, kind, match, count, distance) of all arrivals, as if they had come one by one."""
    # Stored, as each look-up reads them again and would hash all texts anew.
    rows = stored(chained(stored(arrivals, "arrivals")), "arrivals-chained")
    return concluded(rows, nearest(rows.where("kind = 'open'"), rows.where("entry"), radius))
