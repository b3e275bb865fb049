"""Model names and prices: which listed model an id means, and what a turn costs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.functions.catalog import ALIASES, AUTO, CATALOG, EFFORTS, EXTRAS, PREFIX, STEPS, UNKNOWN
from sparkwell.functions.columns import FAMILIES, round_usd


def normalized(model: Column) -> Column:
    """Lower case, without what stands before the last slash or colon."""
    return F.regexp_extract(F.lower(F.trim(model)), "([^/:]*)$", 1)


def _map(pairs) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs)))


def _without_effort(key: Column) -> Column:
    """Null where no ending fits or nothing would be left. No ending is the end of another, so their order does not matter."""
    return F.nullif(F.regexp_extract(key, f"^(.+)(?:{'|'.join(EFFORTS)})$", 1), F.lit(""))


def canonical_id(model: Column) -> Column:
    """One id for a model under all its names: aliases, the harness's prefix and effort endings go, one a step."""
    aliases = _map(ALIASES.items())
    bare = lambda k: F.when(k.startswith(PREFIX), F.substr(k, F.lit(len(PREFIX) + 1)))
    step = lambda k, _: F.coalesce(F.try_element_at(aliases, k), bare(k), _without_effort(k), k)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), normalized(model), step)
    known = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return F.when(known.isin(*UNKNOWN), "__unknown__").when(known.isin(*AUTO), "default").otherwise(walked)


def display_name(model: Column) -> Column:
    """The listed name of a model, found by the same steps; else its id without prefix and ending, else the id as it is."""
    aliases, names = _map(ALIASES.items()), _map((i, n) for i, _, n in CATALOG)
    bare = lambda k: F.when(k.startswith(PREFIX), F.substr(k, F.lit(len(PREFIX) + 1)))
    step = lambda k, _: F.when(F.map_contains_key(names, k), k).otherwise(F.coalesce(F.try_element_at(aliases, k), bare(k), _without_effort(k), k))
    found = F.try_element_at(names, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), normalized(model), step))
    short = bare(normalized(model))
    known = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return F.when(known.isin(*UNKNOWN), "Other").when(known.isin(*AUTO), "Auto").otherwise(F.coalesce(found, _without_effort(short), short, F.trim(model)))


def catalog(spark: SparkSession) -> DataFrame:
    """(model_id, usd, output, cache_read, cache_write): the built-in prices; the last three are null where the family tells."""
    extra = {e[0]: e[1:] for e in EXTRAS}
    return spark.createDataFrame([(i, usd, *extra.get(i, (None, None, None))) for i, usd, _ in CATALOG], "model_id string, usd double, output double, cache_read double, cache_write double")


def resolved(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, matched): the priced model that each distinct id of ``models`` (model) means; null where none does.

    A bounded fixpoint: in each of ``STEPS`` steps all open ids are looked up at once, in one table of what a name leads to (a
    priced model, or an alias to look up next); an id that leads nowhere loses an ending. Only distinct ids take part.
    """
    spark = models.sparkSession
    priced = prices.select(F.col("model_id").alias("name"), F.col("model_id").alias("found")).distinct()
    aliases = spark.createDataFrame(list(ALIASES.items()), "name string, target string")
    # A priced name is itself; else an alias leads to its model; else the name less the harness's prefix may be priced.
    led = aliases.join(priced.select(F.col("name").alias("target"), "found"), "target", "left").select("name", "found", F.when(F.col("found").isNull(), F.col("target")).alias("next"))
    prefixed = priced.select(F.concat(F.lit(PREFIX), "name").alias("name"), "found")
    ways = priced.select("name", "found", F.lit(None).cast("string").alias("next"), F.lit(0).alias("rank"))
    ways = ways.unionByName(led.withColumn("rank", F.lit(1))).unionByName(prefixed.select("name", "found", F.lit(None).cast("string").alias("next"), F.lit(2).alias("rank")))
    best = ways.groupBy("name").agg(F.min_by(F.struct("found", "next"), "rank").alias("w")).select("name", "w.*")
    known = F.lower(F.trim(F.coalesce(F.col("model"), F.lit(""))))
    state = models.select("model").distinct().select("model", F.when(~known.isin(*UNKNOWN, *AUTO), normalized(F.col("model"))).alias("name"), F.lit(None).cast("string").alias("matched"))
    for _ in range(STEPS):
        state = state.join(best, "name", "left").select("model", F.coalesce("matched", "found").alias("matched"), F.when(F.coalesce("matched", "found").isNull(), F.coalesce("next", _without_effort(F.col("name")))).alias("name"))
    return state.select("model", "matched")


def usd(price: Column, extras: dict[str, Column], model: Column, harness: Column, provider: Column, fresh: Column, output: Column, read: Column, written_5m: Column, written_1h: Column, reasoning: Column) -> Column:
    """What a turn costs: by its model's family, or by the model's own prices (``extras``) where it has any.

    Negative counts are none; reasoning is part of the output for some. Null without a price.
    """

    def rate(i: int) -> Column:
        out = F.lit(FAMILIES[-1][1][i])
        for words, rates in reversed(FAMILIES[:-1]):
            out = F.when(F.lower(model).rlike("|".join(words)), rates[i]).otherwise(out)
        own = extras.get(("output", "cache_read", "cache_write", "cache_write", "output")[i])
        return price * out if own is None else F.coalesce(own, price * out)

    count = lambda c: F.greatest(c, F.lit(0))
    units = count(fresh) * price + count(read) * rate(1) + count(written_5m) * rate(2) + count(written_1h) * rate(3) + count(output) * rate(0)
    units = units + F.when((harness == "codex") | (provider == "openai"), 0.0).otherwise(count(reasoning) * rate(4))
    return round_usd(units / 1e6)


def priced(turns: DataFrame, prices: DataFrame, fresh: Column, provider: Column | None = None) -> DataFrame:
    """``turns`` with ``matched`` and ``usd``: ids are resolved once for each distinct one and joined back."""
    found = resolved(turns, prices).join(prices.withColumnRenamed("model_id", "matched"), "matched").withColumnRenamed("model", "_model")
    # One row for each distinct id that has a price: sent to the turns, which would else meet by model, a few large groups.
    by_id = F.broadcast(found.select("_model", "matched", F.col("usd").alias("_price"), *[F.col(c).alias(f"_{c}") for c in ("output", "cache_read", "cache_write")]))
    rows = turns.join(by_id, F.col("model").eqNullSafe(F.col("_model")), "left")
    cost = usd(F.col("_price"), {c: F.col(f"_{c}") for c in ("output", "cache_read", "cache_write")}, F.col("matched"), F.col("harness"), F.lit("") if provider is None else provider, fresh, *[F.col(c) for c in ("output_tokens", "cache_read_tokens", "cache_write_5m", "cache_write_1h", "reasoning_tokens")])
    return rows.select(*turns.columns, "matched", cost.alias("usd"))
