"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm import collocations, decontaminate, line_dedup, merkle, packing, quality_classifier, quality_rules, simhash, sketches, substring_dedup, suffix_dedup, toxicity, url_filter
from sparkwell.llm.common import table

URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality_classifier.remainder(F.col("doc_id"), 5) == 0
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", held_out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = quality_classifier.remainder(F.col("doc_id"), 3) == 1
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", held_out)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.against_next(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"), quality_classifier.remainder(F.col("doc_id"), 3) == 0)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_simhash, op4_quality_classifier, op5_decontaminate, op6_url_filter, op7_suffix_dedup, op8_packing, op9_quality_rules, op10_substring_dedup, op11_scaled_sketch, op12_merkle_manifest, op13_collocations)}


SQL_OP2 = r"""
WITH l AS (
  SELECT d.rowid AS row, d.doc_id, u.pos, u.line,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents) d,
       LATERAL (SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(d.text, ''), chr(10))))) AS pos) u
), k AS (
  SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT l.*, k.first IS NOT NULL AND k.first <> l.doc_id AS gone FROM l LEFT JOIN k ON l.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY row, doc_id
"""

SQL_OP6 = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM h
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN host LIKE '%casino%' OR host LIKE '%free-bets%' OR host LIKE '%adult-%' OR host LIKE '%porn%' OR host LIKE '%-pills%'
    OR host LIKE '%payday-loan%' OR host LIKE '%spam-%' OR host LIKE '%ads-track%' THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""

SQL_OP9 = r"""
WITH w AS (
  SELECT row_number() OVER () AS id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
), win AS (
  SELECT id, i, ws[i:i + 4] AS k FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), twice AS (
  SELECT id, k FROM win GROUP BY id, k HAVING count(*) > 1
), rep AS (
  SELECT id, count(DISTINCT i + o) AS n FROM win JOIN twice USING (id, k), range(5) AS r(o) GROUP BY id
), l AS (
  SELECT id, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS n, len(regexp_extract_all(line, '[\p{L}\p{N}]')) AS letters,
         len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]')) AS chars,
         len(regexp_extract_all(line, '[!?]{2,}|[.]{4,}|[=~_^]{3,}|[*#$%&]{2,}')) AS shouts,
         len(regexp_extract_all(line, '(^|\s)[|»›•·>/](\s|$)')) AS seps
  FROM (SELECT id, unnest(lines) AS line FROM w)
), f AS (
  SELECT id, sum(chars) FILTER (n > 0 AND (letters * 2 < chars OR shouts * 4 > n OR (seps >= 3 AND seps * 5 >= n) OR regexp_matches(line, BOILERPLATE))) AS lost
  FROM l GROUP BY id
), c AS (
  SELECT w.id, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(lines, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')))) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (id) LEFT JOIN f USING (id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= 0.5 * greatest(word_chars, 1) AS kept
FROM c
""".replace("BOILERPLATE", f"'{quality_rules.BOILERPLATE}'")


#: Levels that the SQL of the manifest unrolls: up to 8 ** 8 rows of a language.
LEVELS = 8
FIELD_SQL = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
CRC_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(FIELD_SQL.format(text if f == "text" else f) for f in merkle.FIELDS) + ")"


def _levels_sql(name: str, up_to: int) -> str:
    """From {name}0 (t, idx, h) the nodes of the next levels, and with each node (b, a): what stands around it; more: its level is hashed."""
    out = []
    for k in range(up_to):
        out.append(f"""{name}r{k} AS (SELECT t, idx // 8 AS run, c > 1 AS more, string_agg(h, '' ORDER BY idx) AS hs FROM (SELECT *, count(*) OVER (PARTITION BY t) AS c FROM {name}{k}) GROUP BY ALL),
        {name}{k + 1} AS (SELECT t, run AS idx, CASE WHEN more THEN sha256(hs) ELSE hs END AS h FROM {name}r{k})""")
    return ",\n".join(out)


def _climb_sql(name: str, source: str, up_to: int) -> str:
    """From rows of {source} (t, idx, f, proof) the folded values and proofs through all levels of {name}."""
    out = source
    for k in range(up_to):
        out = f"""(SELECT q.* REPLACE (CASE WHEN more THEN sha256(left(hs, 64 * (idx % 8)) || f || substr(hs, 64 * (idx % 8) + 65)) ELSE f END AS f,
          proof || left(hs, 64 * (idx % 8)) || substr(hs, 64 * (idx % 8) + 65) AS proof, idx // 8 AS idx) FROM {out} q JOIN {name}r{k} r ON q.t = r.t AND q.idx // 8 = r.run)"""
    return out


SQL_OP12 = f"""
WITH l AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, {_leaf_sql("text")} AS h,
         CASE WHEN doc_id IS NOT NULL AND {CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents
), d AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS idx FROM l
), n0 AS (SELECT t, idx, h FROM d),
{_levels_sql("n", LEVELS)},
m0 AS (SELECT 0 AS t, t AS idx, h FROM n{LEVELS}),
{_levels_sql("m", 3)},
low AS (SELECT doc_id, h AS leaf, t, idx, coalesce(changed, h) AS f, '' AS proof FROM d),
mid AS (SELECT * REPLACE (0 AS t, t AS idx), t AS tree FROM {_climb_sql("n", "low", LEVELS)} x),
top AS (SELECT * FROM {_climb_sql("m", "mid", 3)} x)
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM top JOIN n{LEVELS} s ON top.tree = s.t, m3 r
"""


SQL_OP13 = r"""
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)
), t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase FROM w, (SELECT unnest(range(1, 5)) AS size) WHERE len(ws) >= size
), f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL
), c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 30
), k AS (SELECT *, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), s AS (
  SELECT k.*, l.f AS l, r.f AS r, 2000000 * a // (l.f + r.f) AS score FROM k JOIN f l ON k.lang = l.lang AND k.head = l.phrase JOIN f r ON k.lang = r.lang AND k.tail = r.phrase
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1
), o AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s
  WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = s.lang AND x.size > s.size AND (' ' || x.phrase || ' ') LIKE ('% ' || replace(replace(replace(s.phrase, '\', '\\'), '%', '\%'), '_', '\_') || ' %') ESCAPE '\' AND 100 * x.a >= 80 * s.a)
)
SELECT o.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN t ON o.lang = t.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": SQL_OP2, "op6_url_filter": SQL_OP6, "op9_quality_rules": SQL_OP9, "op12_merkle_manifest": SQL_OP12, "op13_collocations": SQL_OP13}
