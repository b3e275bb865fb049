"""Threshold-scaled sketches: fingerprints of documents that can be merged and that estimate containment between unequal ones.

A sketch keeps every shingle hash below a fixed fraction of the hash range. So it grows with its document, the sketch of a union
is the union of sketches, and the share of a small sketch found in a large one estimates the share of a short text
that a long one holds. A text with so few shingles that none is below the fraction keeps its smallest hash, which
merges as well (a union with a hash below the fraction drops it).

Shingles are runs of ``WORDS`` words, A-Z lower-cased; a shorter text is one shingle, a text without words has none.
Defined cases: a null text is empty; two sketches without shingles are alike (1.0), one without and one with are not (0.0);
rows without doc_id come last, rows of one doc_id in the order of a hash of their text; an empty table gives an
empty result; a table of one row follows itself; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sparkwell.llm.common import materialize, partitions, small_batches
from sparkwell.llm.repeats import refine, scramble, unsqueeze
from sparkwell.llm.substring_dedup import word_hashes

WORDS = 5
#: One shingle hash of this many is kept. A text of 300 words keeps about 75: a standard error of 0.05 for a likeness of 0.75.
SCALE = 4
#: Bits of a hash; kept ones lie below 2 ** BITS / SCALE.
BITS = 48


def sketch(text: str | None, words: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """The kept hashes of a text, ascending and distinct."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z only
    if not len(h):
        return np.empty(0, np.uint64)
    every = np.unique(scramble(refine(h, 1, min(words, len(h)))) >> np.uint64(64 - BITS))
    return _thresholded(every, scale)


def _thresholded(hashes: np.ndarray, scale: int) -> np.ndarray:
    below = np.searchsorted(hashes, np.uint64((1 << BITS) // scale))
    return hashes[: max(below, 1)]


def union(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of two texts' shingles together; associative and commutative."""
    return _thresholded(np.union1d(a, b), scale)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of ``a``'s shingles that ``b`` has."""
    return float(len(np.intersect1d(a, b, assume_unique=True)) / len(a)) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The containment of the smaller sketch in the larger one: 1 for a text and any text that holds it."""
    return containment(a, b) if 0 < len(a) <= len(b) or not len(b) else containment(b, a)


def encode(hashes: np.ndarray) -> str:
    """As text: base64 of six bytes a hash, ascending."""
    return base64.b64encode(np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()).decode()


def decode(text: str) -> np.ndarray:
    six = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(six), 2), np.uint8), six], axis=1).copy().view(">u8").ravel().astype(np.uint64)


def edited_text(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much, or all, of the start of another."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


ROW = "doc_id {0}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
SPLIT = ROW + ", part int, head_text string, tail_text string"


def _judged(doc_id, text: str, own: np.ndarray, following: str, next_sketch: np.ndarray, scale: int) -> tuple:
    new = edited_text(text, following)
    of_new = own if new == text else sketch(new, scale=scale)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(own), encode(of_new), likeness(own, of_new), likeness(own, next_sketch)


def squeezed(body: DataFrame) -> DataFrame:
    """The same rows with compressed bodies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([pack.compress(b) for b in batch.column("body").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), packed], ["doc_id", "tie", "body"])

    return body.mapInArrow(work, body.schema)


def against_next(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per input row.

    Rows are ranged by doc_id and pass through a task in that order, one text behind the other. The row that ends a range
    leaves its text open, and the row that begins one shows its text besides; these two a range meet in a join.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    body = docs.select("doc_id", F.xxhash64(text).alias("tie"), text.cast("binary").alias("body"))
    keys = [F.asc_nulls_last("doc_id"), F.asc("tie")]
    # Texts move compressed, at less than half the bytes of a plain shuffle.
    ranged = squeezed(body).repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            out_type = batch.schema.field("doc_id").type
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                text = unsqueeze(blob).decode()
                own = sketch(text, scale=scale)
                if before is None:
                    out.append((*[None] * 7, part, text, None))
                else:
                    out.append((*_judged(*before, text, own, scale), None, None, None))
                before = doc_id, text, own
            yield as_batch(out, out_type)
            out = []
        if before is not None:
            yield as_batch([(before[0], *[None] * 6, part, None, before[1])], out_type)

    def as_batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        types = [doc_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
        names = [f.split()[0] for f in SPLIT.format("").split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_judged(i, a, sketch(a, scale=scale), b, sketch(b, scale=scale), scale) + (None, None, None) for i, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail_text", "head_text")))]
            yield as_batch(rows, batch.schema.field("doc_id").type)

    walked = materialize(ranged.mapInArrow(walk, SPLIT.format(kind)), "sketches")
    parts = sorted(r["part"] for r in walked.where("head_text IS NOT NULL").select("part").collect())  # as many as ranges
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = walked.where("head_text IS NOT NULL").select(F.col("part").alias("next"), "head_text")
    tails = walked.where("tail_text IS NOT NULL").select("part", "doc_id", "tail_text")
    closed = tails.join(follows, "part").join(heads, "next").select("doc_id", "tail_text", "head_text").mapInArrow(close, SPLIT.format(kind))
    columns = [f.split()[0] for f in ROW.format("").split(", ")]
    return walked.where("part IS NULL").select(*columns).unionByName(closed.select(*columns))


def merged(sketches: DataFrame, *by: str, scale: int = SCALE) -> DataFrame:
    """(``by``, hash): the sketches (column ``hashes``, array of long) of each group as one, a row for each kept hash.

    A group of any size is spread over tasks by its hashes; only smallest hashes at or above the fraction are compared as a group.
    """
    most = (1 << BITS) // scale
    rows = sketches.select(*by, F.explode("hashes").alias("hash")).distinct()
    least = rows.groupBy(*by).agg(F.min("hash").alias("hash")).where(F.col("hash") >= most)
    return rows.where(F.col("hash") < most).unionByName(least)


def sketched(docs: DataFrame, *keep: str, scale: int = SCALE) -> DataFrame:
    """(``keep``, hashes): the kept hashes of each text as an array of long."""
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("hashes", ArrayType(LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sketch(t, scale=scale).astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(kept, pa.list_(pa.int64()))], [*keep, "hashes"])

    return docs.select(*keep, F.col("text").alias("text")).mapInArrow(work, schema)


def containments(small: DataFrame, large: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, shared, containment): for merged sketches (name, hash), the estimated share of each ``a`` that each ``b`` holds, where any."""
    sizes = small.groupBy(a).agg(F.count("*").alias("kept"))
    shared = small.join(large, "hash").groupBy(a, b).agg(F.count("*").alias("shared"))
    return shared.join(sizes, a).select(a, b, "shared", (F.col("shared") / F.col("kept")).alias("containment"))
