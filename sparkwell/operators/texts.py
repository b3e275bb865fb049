"""Operators over payload texts: duplicates and deltas, retrieval, line selection, frames and reducers.

Tables of texts have (doc_id, text). What SQL functions can express stays there; 64-bit hashing and
line-by-line state run in Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.functions.columns import digit_runs, normalized_hash, signal_line

TERM = r"[^\p{L}\p{N}]+"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line): a trailing empty line and carriage returns at line ends don't count."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\n$", "")
    rows = docs.where(F.coalesce("text", F.lit("")) != "").select("doc_id", F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
    return rows.withColumn("line", F.regexp_replace("line", "\r$", ""))


def exact_groups(docs: DataFrame, normalize: bool = False) -> DataFrame:
    """Groups of texts that are equal (white space apart, if ``normalize``): first id and size. Hashes combine before the shuffle."""
    key = normalized_hash(F.col("text")) if normalize else F.sha2(F.col("text"), 256)
    return docs.where(F.col("text").isNotNull()).groupBy(key.alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def digit_variants(docs: DataFrame) -> DataFrame:
    """Templates (texts without their digits) that occur with unlike digit runs: such texts are no duplicates."""
    template = F.sha2(F.regexp_replace("text", "[0-9]+", "#"), 256)
    rows = docs.where(F.col("text").isNotNull()).select(template.alias("hash"), F.array_join(digit_runs(F.col("text")), ",").alias("digits"), "doc_id")
    return rows.groupBy("hash").agg(F.count("*").alias("n"), F.count_distinct("digits").alias("variants"), F.min("doc_id").alias("first_id")).where("variants > 1")


def previous_ids(docs: DataFrame, cell: int = 10_000) -> DataFrame:
    """(doc_id, prev_id): the row before of the same source, from ids alone.

    A source is cut into cells of ids, so one that holds a third of all rows is spread over many tasks; cells meet by their last ids.
    """
    ids = docs.select("doc_id", "source", F.floor(F.col("doc_id") / cell).alias("cell"))
    inside = ids.withColumn("prev", F.lag("doc_id").over(Window.partitionBy("source", "cell").orderBy("doc_id")))
    ends = ids.groupBy("source", "cell").agg(F.max("doc_id").alias("last"))
    before = ends.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.lag("last").over(Window.partitionBy("source").orderBy("cell")).alias("before"))
    rows = inside.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    return rows.select("doc_id", F.coalesce("prev", "before").alias("prev_id")).where("prev_id is not null")


def line_overlap(docs: DataFrame) -> DataFrame:
    """Distinct lines that a text shares with the text before it from the same source; texts meet by id, not by source."""
    own = docs.select("doc_id", F.array_distinct(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("own"))
    pairs = previous_ids(docs).join(own, "doc_id").join(own.select(F.col("doc_id").alias("prev_id"), F.col("own").alias("prev")), "prev_id")
    return pairs.select("doc_id", "prev_id", F.size("own").cast("long").alias("n_lines"), F.size(F.array_intersect("own", "prev")).cast("long").alias("shared"))


FOLDED = re.compile(r"((?:[0-9]|x(?=[0-9A-Fa-f]))[0-9A-Fa-f:.x-]*)|(/(?=[A-Za-z0-9.])[^ \t\n\f\r]*)|[ \t\n\f\r]+")


def folded(text: str) -> bytes:
    """The text with numbers, hex ids and times as '#', paths as '/path' and runs of spaces as one; bytes count as characters, as in the reference."""
    return FOLDED.sub(lambda m: "#" if m[1] else "/path" if m[2] else " ", text.encode().decode("latin-1")).encode()


def simhash_trigrams(docs: DataFrame) -> DataFrame:
    """(doc_id, simhash): the sign of FNV-1a bits over byte 3-grams of the folded text; a digest of shorter ones, 0 for an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(text: str | None) -> int:
        body = folded(text or "")
        if len(body) < 3:
            return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little") if body else 0
        raw = np.frombuffer(body, np.uint8).astype(np.uint64)
        total = np.zeros(64, np.int64)
        for at in range(0, len(raw) - 2, 1 << 16):
            part = raw[at : at + (1 << 16) + 2]
            h = np.full(len(part) - 2, 0xCBF29CE484222325, np.uint64)
            for j in range(3):
                h = (h ^ part[j : len(part) - 2 + j]) * np.uint64(0x100000001B3)
            total += 2 * np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) - len(h)
        return sum(1 << b for b in np.flatnonzero(total >= 0).tolist())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "simhash": np.array([one(t) for t in pdf["text"]], np.uint64).view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, simhash long")


def simhash_links(hashes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b, distance) of distinct hashes within ``radius`` (up to 3)."""
    return _links(hashes.select("simhash").distinct().withColumn("class_id", F.lit(0)), radius).select("a", "b", "distance")


def simhash_class_links(hashes: DataFrame, radius: int = 3) -> DataFrame:
    """simhash_links with the class ids (see simhash_members) of both sides."""
    return _links(hashes.groupBy("simhash").agg(F.min("doc_id").alias("class_id")), radius)


#: Six blocks of a hash: three differing bits leave three blocks alike, so the 20 choices of three blocks find every link.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def _links(classes: DataFrame, radius: int) -> DataFrame:
    """Links of (simhash, class_id): keys of 31 bits and more joined on (choice, value), verified by bits."""
    if radius > 3:
        raise ValueError("the keys find links within 3 bits")
    masks = [sum(((1 << w) - 1) << at for at, w in three) for three in combinations(BLOCKS, 3)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = classes.where("simhash <> 0").select("simhash", "class_id", F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "value"))
    # The number of partitions is given: hashes are few bytes, links may be many, and one task would get them all.
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda x: keyed.withColumnsRenamed({"simhash": x, "class_id": f"{x}_class"}).repartition(parts, "choice", "value")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    distance = F.bit_count(differ)
    # A link comes from the first choice that both sides share, so none comes twice and no task holds links to compare them.
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
    met = side("a").join(side("b"), ["choice", "value"]).where((F.col("a") < F.col("b")) & (distance <= radius) & (F.col("choice") == first))
    return met.select("a", "b", distance.cast("int").alias("distance"), "a_class", "b_class")


def simhash_members(hashes: DataFrame) -> DataFrame:
    """(doc_id, simhash, class_id) of every document; class_id is the smallest doc_id with the same hash."""
    least = hashes.groupBy("simhash").agg(F.min("doc_id").alias("class_id"))
    return hashes.join(least, "simhash").select("doc_id", "simhash", "class_id")


GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)


def chunk_ends(body: bytes, least: int = 512, most: int = 8192, bits: int = 11, middle: int = 2048) -> list[int]:
    """Where content-defined chunks end: where a rolling sum of byte hashes has ``bits`` low zero bits, from ``middle`` bytes on one fewer."""
    raw = np.frombuffer(body, np.uint8)
    g, h = GEAR[raw], np.zeros(len(raw), np.uint64)
    # Each shift drops older bytes, so the sum of the last shifted values is the rolling hash; its low bits depend on that many bytes.
    for j in range(min(bits, len(raw))):
        h[j:] += g[: len(raw) - j] << np.uint64(j)
    # These are fewer than ``least``, so a chunk's start makes no difference.
    spots = [np.flatnonzero(h & np.uint64((1 << n) - 1) == 0) + 1 for n in (bits, bits - 1)]
    ends, at = [], 0
    while at < len(raw):
        end = min(at + most, len(raw))
        for found, size in zip(spots, (least, middle)):
            i = np.searchsorted(found, at + size)
            if i < len(found):
                end = min(end, int(found[i]))
        ends.append(at := end)
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, offset, len, hash): content-defined chunks. The hash starts anew with each chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                body = (t or "").encode()
                at = 0
                for end in chunk_ends(body):
                    rows.append((d, at, end - at, hashlib.blake2b(body[at:end], digest_size=8).hexdigest()))
                    at = end
            yield pd.DataFrame(rows, columns=["doc_id", "offset", "len", "hash"])

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, offset long, len long, hash string")


def chunk_reuse(docs: DataFrame) -> DataFrame:
    """For each text the bytes in chunks that an earlier text already holds."""
    c = chunks(docs)
    first = c.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    return c.join(first, "hash").groupBy("doc_id").agg(F.sum("len").alias("n_bytes"), F.sum(F.when(F.col("first_id") < F.col("doc_id"), F.col("len")).otherwise(0)).alias("reused"))


def _counted(docs: DataFrame, query: list[str]) -> tuple[DataFrame, Row]:
    """(doc_id, len, tf) with how often each term of the query occurs, and the corpus's (n, mean, df of each term): one pass each."""
    terms = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), TERM, -1), lambda t: t != "")
    count = lambda q: F.size(F.filter("terms", lambda t: t == q)).cast("long")
    tf = F.array(*[count(q) for q in query])
    rows = docs.select("doc_id", terms.alias("terms")).select("doc_id", F.size("terms").cast("long").alias("len"), tf.alias("tf"))
    df = [F.coalesce(F.sum((F.get("tf", F.lit(i)) > 0).cast("long")), F.lit(0)) for i in range(len(query))]
    return rows.where(F.exists("tf", lambda n: n > 0)), rows.agg(F.count("*").alias("n"), F.avg(F.col("len").cast("double")).alias("mean"), F.array(*df).alias("df")).first()


def bm25(docs: DataFrame, query: list[str], k: int = 16, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents for an OR of terms."""
    rows, corpus = _counted(docs, query)
    norm = k1 * (1 - b + b * F.col("len") / F.lit(corpus["mean"] or 1.0))
    score = F.lit(0.0)
    for i, df in enumerate(corpus["df"]):
        tf = F.get("tf", F.lit(i))
        score += F.lit(math.log(1 + (corpus["n"] - df + 0.5) / (df + 0.5))) * tf * (k1 + 1) / (tf + norm)
    return rows.select("doc_id", (F.round(score * 1e6) / 1e6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def tfidf(docs: DataFrame, query: list[str], k: int = 16) -> DataFrame:
    rows, corpus = _counted(docs, query)
    score = F.lit(0.0)
    for i, df in enumerate(corpus["df"]):
        score += F.get("tf", F.lit(i)) / F.col("len") * max(math.log((corpus["n"] + 1) / (df + 1)), 0.0)
    return rows.select("doc_id", (F.round(score * 1e9) / 1e9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def tfidf_containing(docs: DataFrame, query: list[str], k: int = 16) -> DataFrame:
    """TF-IDF by the reference's rules: tokens that hold a term or are held in it (2 or more characters) count too.

    A term's df is its own or, if no text has it, the greatest of its matching tokens; longer terms weigh more.
    """
    terms = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), TERM, -1), lambda t: t != "")

    def match(t: Column, q: str) -> Column:
        return (t == q) | ((F.char_length(t) >= 2) & (t.contains(q) | F.lit(q).contains(t))) if len(q) >= 2 else t == q

    def holding(q: str) -> Callable[[Column], Column]:
        return lambda t: match(t, q)

    rows = docs.select("doc_id", terms.alias("terms"))
    tokens = rows.select(F.explode(F.array_distinct(F.filter("terms", lambda t: reduce(or_, (match(t, q) for q in query))))).alias("t"))
    df = tokens.groupBy("t").agg(F.count("*").alias("n"))
    own, any_ = [F.max(F.when(F.col("t") == q, F.col("n"))) for q in query], [F.max(F.when(match(F.col("t"), q), F.col("n"))) for q in query]
    dfs = df.agg(*[F.coalesce(a, b, F.lit(0)).alias(f"df{i}") for i, (a, b) in enumerate(zip(own, any_))]).first()
    n = docs.count()
    score = F.lit(0.0)
    for q, d in zip(query, dfs):
        hits = F.size(F.filter("terms", holding(q)))
        score += hits / F.greatest(F.size("terms"), F.lit(1)) * max(math.log((n + 1) / (d + 1)), 0.0) * (0.6 if len(q) <= 2 else 1.0 if len(q) <= 5 else 1.3)
    hit = F.exists("terms", lambda t: reduce(or_, (match(t, q) for q in query)))
    return rows.where(hit).select("doc_id", (F.round(score * 1e9) / 1e9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def overlap(docs: DataFrame, query: list[str], k: int = 16) -> DataFrame:
    """Documents by the query terms they contain, longer terms weighing more."""
    body = F.lower(F.coalesce("text", F.lit("")))
    score = sum((F.when(body.contains(q), 1 if len(q) <= 2 else 2 if len(q) <= 5 else 3).otherwise(0) for q in query), F.lit(0))
    return docs.select("doc_id", score.cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(k)


def signal_counts(docs: DataFrame) -> DataFrame:
    """Lines of each text that speak of failures."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), signal_line))
    return docs.select("doc_id", n.cast("long").alias("signals")).where("signals > 0")


def top_lines(docs: DataFrame, k: int = 3) -> DataFrame:
    """Each text's k longest lines; ranks inside the row, nothing is shuffled."""
    ranked = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x, i: F.struct((-F.char_length(x)).alias("size"), i.alias("pos"), x.alias("line")))
    top = F.slice(F.sort_array(ranked), 1, k)
    return docs.select("doc_id", F.explode(top).alias("t")).select("doc_id", F.col("t.pos").cast("long").alias("pos"), (-F.col("t.size")).cast("long").alias("size"))


def frames(docs: DataFrame) -> DataFrame:
    """(doc_id, name, kind, first, last): failures and code symbols with their line ranges (from 1), at most 48 a text.

    A symbol reaches to the line before the next one that is indented no deeper; failures take their line and the next.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    symbol = re.compile(r"^(\s*)(?:pub |async |export |static )*(?:fn|def|class|struct|enum|trait|impl|interface|function|func|type|mod)\s+([A-Za-z_]\w*)")
    failure = re.compile(r"(?i)\b(?:error(?:\[\w+\])?|failed|panicked|exception)\b[:\s]*(.{0,60})")

    def of(text: str) -> list[tuple]:
        rows = text.splitlines()
        found = [(i, len(m[1]), m[2]) for i, x in enumerate(rows) if (m := symbol.match(x))]
        out = []
        for j, (i, depth, name) in enumerate(found):
            after = next((k for k, d, _ in found[j + 1 :] if d <= depth), len(rows))
            out.append((name, "symbol", i + 1, after))
        out += [((m[1].strip() or "error")[:60], "fail", i + 1, min(i + 2, len(rows))) for i, x in enumerate(rows) if (m := failure.search(x))]
        return sorted(out, key=lambda f: (f[0], f[2]))[:48]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *f) for d, t in zip(pdf["doc_id"], pdf["text"]) for f in of(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "kind", "first", "last"])

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, name string, kind string, first long, last long")


ANSI = re.compile(r"\x1b\[[0-?]*[ -/]*[@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\r")
DIAGNOSTIC = re.compile(r"(?i)^\s*(error|warning|fail|panicked|traceback|e\s{2,}|assert)|(\berror\b|\bFAILED\b|panicked at|exception:|-->|expected|received)")
PASSING = re.compile(r"(?i)\.\.\. ok$|^ok\b|^PASS\b|PASSED|^\s*(compiling|checking|downloading|finished)\b")


def reduced(text: str, budget: int = 60) -> str:
    """The working set of a payload: colours and passing noise out, repeats folded, head, tail and diagnostics kept in order."""
    rows: list[str] = []
    again = 0
    for x in ANSI.sub("", text).split("\n") + [None]:
        if rows and x is not None and x == rows[-1]:
            again += 1
            continue
        if again and rows:
            rows[-1] += f"  ×{again + 1}"
            again = 0
        if x is not None and not PASSING.search(x):
            rows.append(x)
    if len(rows) <= budget:
        return "\n".join(rows)
    near = {j for i, x in enumerate(rows) if DIAGNOSTIC.search(x) for j in (i - 1, i, i + 1) if 0 <= j < len(rows)}
    rank = sorted(range(len(rows)), key=lambda i: (i not in near, min(i, len(rows) - 1 - i), i))[:budget]
    out, last = [], -1
    for i in sorted(rank):
        if i != last + 1:
            out.append("…")
        out.append(rows[i])
        last = i
    return "\n".join(out + (["…"] if last < len(rows) - 1 else []))


def reduce_payloads(docs: DataFrame, budget: int = 60) -> DataFrame:
    """(doc_id, reduced): never longer than the payload."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "reduced": [min((reduced(t, budget), t), key=len) for t in texts]})

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, reduced string")
