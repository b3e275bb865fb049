"""Queries over frames, the search facade and the pages mapped for a task."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwell.functions.tasks import task_tokens
from sparkwell.operators import facade, index
from sparkwell.plans.deltas import TOKENS_SQL
from sparkwell.plans.queries import NOW, query
from sparkwell.sources.model import table
from sparkwell.sources.stored import fresh_path

ASKED = ["idiot", "ion", "menteau", "der", "th"]
#: (query_id, needle): a word, or letters from inside one, of every row whose id is divisible by 20; (uri, name, kind, start_line, hint): the first three lines of each.
NEEDLE_SQL = r"""ws AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id % 20 = 0),
  nd AS (SELECT doc_id AS query_id, CASE doc_id % 60 WHEN 0 THEN w[1] WHEN 20 THEN substr(w[5], 2, 4) ELSE w[12] END AS needle FROM ws),
  ln AS (SELECT doc_id AS uri, unnest(string_split(coalesce(text, ''), chr(10))) AS hint, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS start_line FROM documents),
  fr AS (SELECT uri, regexp_extract(hint, '[\p{L}\p{N}]+') AS name, CASE (uri + start_line) % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'error' ELSE 'symbol' END AS kind, start_line, hint FROM ln WHERE start_line <= 3),
  fh AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE kind WHEN 'fail' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, start_line, uri, name) AS rank, uri, name, kind, hint
    FROM nd JOIN fr ON length(needle) >= 2 AND (contains(lower(name), lower(needle)) OR contains(lower(hint), lower(needle))) QUALIFY rank <= 5)"""


def needles(spark, d):
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")
    at = lambda i: F.get("w", F.lit(i - 1))
    needle = F.when(F.col("doc_id") % 60 == 0, at(1)).when(F.col("doc_id") % 60 == 20, F.substring(at(5), 2, 4)).otherwise(at(12))
    return table(spark, d, "documents").where("doc_id % 20 = 0").select("doc_id", w.alias("w")).select(F.col("doc_id").alias("query_id"), needle.alias("needle"))


def frames(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.posexplode(F.slice(F.split(F.coalesce("text", F.lit("")), "\n", -1), 1, 3)).alias("pos", "hint"))
    kind = F.when((F.col("uri") + F.col("pos") + 1) % 4 == 0, "fail").when((F.col("uri") + F.col("pos") + 1) % 4 == 1, "error").otherwise("symbol")
    return lines.select("uri", F.regexp_extract("hint", r"[\p{L}\p{N}]+", 0).alias("name"), kind.alias("kind"), (F.col("pos") + 1).alias("start_line"), "hint")


@query(f"WITH {NEEDLE_SQL} SELECT * FROM fh")
def frame_search(spark, d):
    return facade.search_frames(needles(spark, d), frames(spark, d), 5)


@query(rf"""WITH {NEEDLE_SQL}, t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM documents),
  p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
  s AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT count(*) FROM t)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
  q AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(needle, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM nd),
  th AS (SELECT query_id, doc_id AS uri, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, p.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) * 1e6) / 1e6 AS score FROM q JOIN p ON q.term = p.term JOIN df ON q.term = df.term JOIN l ON p.doc_id = l.doc_id, s GROUP BY 1, 2) QUALIFY rank <= 5),
  newest AS (SELECT uri, start_line, hint AS line FROM ln WHERE uri IN (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 80) AND NOT (hint = '' AND start_line > 1 AND start_line = (SELECT max(start_line) FROM ln x WHERE x.uri = ln.uri))),
  sh AS (SELECT query_id, uri, count(*) AS lines, min(start_line) AS first FROM nd JOIN newest ON length(needle) >= 2 AND contains(lower(line), lower(needle))
    WHERE query_id NOT IN (SELECT query_id FROM fh) AND query_id NOT IN (SELECT query_id FROM th) GROUP BY 1, 2),
  sd AS (SELECT query_id, sh.uri, lines, string_agg(lpad(start_line::VARCHAR, 6, ' ') || ' | ' || line, chr(10) ORDER BY start_line) AS detail FROM sh JOIN newest ON sh.uri = newest.uri AND start_line BETWEEN greatest(first - 1, 1) AND first + 2 GROUP BY 1, 2, 3),
  every AS (SELECT query_id, 0 AS source, rank AS place, uri, name AS detail FROM fh UNION ALL SELECT query_id, 1, rank, uri, '' FROM th WHERE (query_id, uri) NOT IN (SELECT (query_id, uri) FROM fh)
    UNION ALL SELECT query_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY lines DESC, uri), uri, detail FROM sd)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, place) AS rank, ['frame', 'text', 'scan'][source + 1] AS source, uri, detail FROM every QUALIFY rank <= 5""")
def search_everything(spark, d):
    """Frames, then texts, then the newest pages, for a needle from every row whose id is divisible by 20."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    pages = docs.select(F.col("doc_id").alias("uri"), "text", F.col("doc_id").alias("created_at"))
    return facade.search(needles(spark, d), frames(spark, d), index.build(docs, fresh_path(spark, "index")), pages, 5)


@query(f"""WITH {TOKENS_SQL}, pg AS (SELECT doc_id AS uri, coalesce(source, '') AS kind, CASE WHEN doc_id % 7 = 0 THEN 'Failed ' || doc_id ELSE lang END AS summary, {NOW} - doc_id * 9000 AS created_at,
    CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 END AS referenced, CASE WHEN doc_id % 3 = 0 THEN {NOW} - doc_id * 400 END AS accessed_at FROM documents),
  q AS (SELECT unnest({ASKED}) AS q), m AS (SELECT doc_id AS uri, q, tok FROM top, q WHERE tok = q OR (length(tok) >= 2 AND length(q) >= 2 AND (contains(tok, q) OR contains(q, tok)))),
  n AS (SELECT count(*)::DOUBLE AS n FROM documents), dq AS (SELECT q, count(DISTINCT uri) AS df FROM m GROUP BY 1), held AS (SELECT tok, count(DISTINCT doc_id) AS c FROM top GROUP BY 1),
  own AS (SELECT q.q, coalesce((SELECT c FROM held WHERE tok = q.q), (SELECT max(c) FROM held WHERE tok IN (SELECT tok FROM m WHERE m.q = q.q)), 0) AS c FROM q),
  sz AS (SELECT doc_id AS uri, count(*) AS size FROM top GROUP BY 1),
  pq AS (SELECT uri, q, count(*) AS hits FROM m GROUP BY 1, 2),
  sc AS (SELECT pq.uri, sum(CASE WHEN length(q) <= 2 THEN 1 WHEN length(q) <= 5 THEN 2 ELSE 3 END) AS ov, sum(greatest(round(log2((n + 1) / (greatest(df, 1) + 1)) * 6), 0)) AS rare,
    sum(hits / size::DOUBLE * greatest(ln((n + 1) / (c + 1)), 0) * CASE WHEN length(q) <= 2 THEN 0.6::DOUBLE WHEN length(q) <= 5 THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END) AS sem FROM pq JOIN dq USING (q) JOIN own USING (q) JOIN sz USING (uri), n GROUP BY 1),
  a AS (SELECT pg.*, coalesce(ov, 0) AS ov, coalesce(rare, 0) AS rare, coalesce(sem, 0) AS sem, {NOW} - coalesce(accessed_at, created_at) AS age FROM pg LEFT JOIN sc USING (uri)),
  b AS (SELECT *, CASE WHEN coalesce(referenced, false) AND age <= 900 THEN 'hot' WHEN coalesce(referenced, false) OR age <= 86400 THEN 'warm' ELSE 'cold' END AS layer FROM a),
  c AS (SELECT uri, kind, layer, created_at, CAST(ov * 12 + CASE layer WHEN 'hot' THEN 8 WHEN 'warm' THEN 3 ELSE 0 END + CASE WHEN ov > 0 THEN 6 ELSE 0 END + rare + round(sem * 18) + CASE WHEN regexp_matches(lower(coalesce(summary, '')), 'fail|error|panic|e0') THEN 10 ELSE 0 END
    + (604800 - least(greatest(age, 0), 604800)) // 86400 AS BIGINT) AS score FROM b WHERE ov > 0 OR sem > 0 OR layer <> 'cold' QUALIFY row_number() OVER (PARTITION BY kind ORDER BY score DESC, created_at DESC, uri) <= 4)
  SELECT row_number() OVER (ORDER BY score DESC, created_at DESC, uri) AS rank, uri, kind, layer, score FROM c QUALIFY rank <= 12""")
def mapped_pages(spark, d):
    """The documents to show for a task, as pages that were seen at different times."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents")
    pages = docs.select(i.alias("uri"), F.coalesce("source", F.lit("")).alias("kind"), task_tokens(F.col("text")).alias("tokens"), F.when(i % 7 == 0, F.concat(F.lit("Failed "), i.cast("string"))).otherwise(F.col("lang")).alias("summary"), (NOW - i * 9000).alias("created_at"))
    seen = docs.where(i % 3 == 0).select(i.alias("uri"), (i % 2 == 0).alias("referenced"), (NOW - i * 400).alias("accessed_at"))
    return facade.mapped_pages(pages, seen, ASKED, NOW)
