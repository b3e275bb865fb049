"""Queries over model names and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions import prices as P
from sparkwell.functions.catalog import ALIASES, CATALOG, EFFORTS, EXTRAS
from sparkwell.functions.columns import FAMILIES
from sparkwell.operators import dashboard
from sparkwell.plans.queries import FRESH, query
from sparkwell.sources.model import TURNS_SQL, table, turns

NAMES = [i for i, _, _ in CATALOG] + list(ALIASES) + ["default", "no-such-model", "", "Unknown"]
BEFORE = ["", "cursor-", "openai/", "a/b:Cursor-"]
AFTER = ["", "-high", "-high-fast", "-thinking-max", "-low-med-xhigh-thinking", "-fast"]
text = lambda rows: ", ".join("(" + ", ".join(("NULL::DOUBLE" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v)) for v in r) + ")" for r in rows)
LISTS = f"cat(id, usd, name) AS (VALUES {text(CATALOG)}), ali(name, target) AS (VALUES {text(ALIASES.items())}), ext(id, o, r, w) AS (VALUES {text(EXTRAS)})"
one_of = lambda values, i: f"{[*values]}[{i} % {len(values)} + 1]"
ID_SQL = f"{one_of(BEFORE, 'l_linenumber')} || {one_of(NAMES, 'l_orderkey')} || {one_of(AFTER, 'l_partkey')}"
#: The price that each id means, by following aliases, prefix and endings for eight steps.
WALK_SQL = rf"""{LISTS}, ids AS (SELECT DISTINCT {ID_SQL} AS model FROM lineitem),
  r(model, key, matched, n) AS (SELECT model, CASE WHEN lower(trim(model)) IN ('', '__unknown__', 'unknown', 'default', 'auto') THEN NULL ELSE regexp_extract(lower(trim(model)), '([^/:]*)$', 1) END, NULL::VARCHAR, 0 FROM ids
    UNION ALL SELECT model, CASE WHEN target IS NOT NULL THEN target ELSE nullif(regexp_extract(key, '^(.+)(?:{'|'.join(EFFORTS)})$', 1), '') END,
      CASE WHEN key IN (SELECT id FROM cat) THEN key WHEN target IN (SELECT id FROM cat) THEN target WHEN target IS NULL AND starts_with(key, 'cursor-') AND substr(key, 8) IN (SELECT id FROM cat) THEN substr(key, 8) END, n + 1
    FROM r LEFT JOIN ali ON key = ali.name WHERE matched IS NULL AND key IS NOT NULL AND n < 8),
  c(model, key, n) AS (SELECT model, regexp_extract(lower(trim(model)), '([^/:]*)$', 1), 0 FROM ids
    UNION ALL SELECT model, CASE WHEN target IS NOT NULL THEN target WHEN starts_with(key, 'cursor-') THEN substr(key, 8) ELSE coalesce(nullif(regexp_extract(key, '^(.+)(?:{'|'.join(EFFORTS)})$', 1), ''), key) END, n + 1
    FROM c LEFT JOIN ali ON key = ali.name WHERE n < 8),
  hit AS (SELECT model, max(matched) AS matched FROM r GROUP BY 1)"""


def ids(spark, d):
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    model = F.concat(pick(BEFORE, F.col("l_linenumber")), pick(NAMES, F.col("l_orderkey")), pick(AFTER, F.col("l_partkey")))
    return table(spark, d, "lineitem").select(model.alias("model"), "l_orderkey", "l_linenumber")


@query(rf"""WITH RECURSIVE {WALK_SQL}, last AS (SELECT model, key FROM c WHERE n = 8)
  SELECT hit.model, matched, CASE WHEN lower(trim(hit.model)) IN ('', '__unknown__', 'unknown') THEN '__unknown__' WHEN lower(trim(hit.model)) IN ('default', 'auto') THEN 'default' ELSE key END AS canonical
  FROM hit JOIN last ON hit.model = last.model""")
def resolved_models(spark, d):
    """Each id that turns name: the priced model that it means, and its canonical name."""
    models = ids(spark, d).select("model").distinct()
    return P.resolved(models, P.catalog(spark)).withColumn("canonical", P.canonical_id(F.col("model")))


def _rate_sql(i: int, own: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(matched, '{'|'.join(words)}') THEN {rates[i]}::DOUBLE" for words, rates in FAMILIES if words)
    return f"coalesce({own}, usd * CASE {cases} ELSE {FAMILIES[-1][1][i]}::DOUBLE END)"


COST_ID = ID_SQL.replace("l_linenumber", "(reasoning_tokens // 100)").replace("l_orderkey", "turn_key").replace("l_partkey", "turn_key")


@query(rf"""WITH RECURSIVE {TURNS_SQL}, {WALK_SQL.replace(f"{ID_SQL} AS model FROM lineitem", f"{COST_ID} AS model FROM turns")},
  u AS (SELECT matched, round(round(({FRESH} * usd + cache_read_tokens * {_rate_sql(1, "r")} + cache_write_5m * {_rate_sql(2, "w")} + cache_write_1h * {_rate_sql(3, "w")} + output_tokens * {_rate_sql(0, "o")}
    + CASE WHEN harness = 'codex' THEN 0.0::DOUBLE ELSE reasoning_tokens * {_rate_sql(4, "o")} END) / 1e6 * 1e6) / 1e6 * 1e5) AS units FROM (SELECT *, {COST_ID} AS id_ FROM turns) t JOIN hit ON t.id_ = hit.model JOIN cat ON matched = cat.id LEFT JOIN ext ON matched = ext.id)
  SELECT matched, count(*) AS turns, sum(CAST(units AS BIGINT)) / 1e5 AS usd FROM u GROUP BY 1""")
def resolved_costs(spark, d):
    """What turns cost by the priced model that their ids mean."""
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    key, line = F.col("turn_key"), F.expr("reasoning_tokens div 100")
    rows = turns(spark, d).withColumn("model", F.concat(pick(BEFORE, line), pick(NAMES, key), pick(AFTER, key)))
    costs = P.priced(rows, P.catalog(spark), dashboard.fresh_input(rows)).where("usd IS NOT NULL")
    return costs.groupBy("matched").agg(F.count("*").alias("turns"), (F.sum(F.round(F.col("usd") * 1e5).cast("long")) / 1e5).alias("usd"))


@query(f"""WITH {LISTS}, a AS (SELECT id AS model_id, usd, 0 AS layer FROM cat),
  b AS (SELECT {one_of([i for i, _, _ in CATALOG] + ["own"], "p_partkey")} AS model_id, arg_max(CASE WHEN p_size % 3 <> 0 THEN p_retailprice / 1000 END, p_partkey) FILTER (p_size % 3 <> 0) AS usd, 1 AS layer FROM part GROUP BY 1),
  c AS (SELECT {one_of([i for i, _, _ in CATALOG][:5] + ["mine"], "s_suppkey")} AS model_id, arg_max(s_acctbal / 1000, s_suppkey) AS usd, 2 AS layer FROM supplier WHERE s_acctbal > 0 GROUP BY 1)
  SELECT model_id, arg_max(usd, layer) AS usd, max(layer) AS layer FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE usd IS NOT NULL GROUP BY 1""")
def price_layers(spark, d):
    """Built-in prices, over them a list taken from parts, over that one from suppliers."""
    listed = [i for i, _, _ in CATALOG]
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int")).alias("model_id")
    has = F.col("p_size") % 3 != 0
    parts = table(spark, d, "part").where(has).groupBy(pick([*listed, "own"], F.col("p_partkey"))).agg(F.max_by(F.col("p_retailprice") / 1000, "p_partkey").alias("usd"))
    own = table(spark, d, "supplier").where("s_acctbal > 0").groupBy(pick([*listed[:5], "mine"], F.col("s_suppkey"))).agg(F.max_by(F.col("s_acctbal") / 1000, "s_suppkey").alias("usd"))
    return dashboard.layered(P.catalog(spark).select("model_id", "usd"), parts, own)
