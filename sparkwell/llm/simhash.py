"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments, each padded to 23 bits, the length of the perfect
binary Golay code. Every 23-bit word lies within 3 bits of exactly one codeword; within 4 bits of a word lie
that codeword and, for 7 words of 8, five more. So if two segments differ in at most one bit, the
codeword nearest to the one is among the (at most six) codewords within 4 bits of the other.

Three errors over three segments fall in one of two ways. Either one segment has no error and another has
at most one: the key is the first segment itself and the codeword of the second. Or each segment has exactly
one: the key is the three codewords. One side of the join always emits nearest codewords where the
other emits all nearby ones, which keeps a fingerprint at about 70 short keys and loses no pair. Keys have 33
bits or more, so unrelated fingerprints seldom meet; pairs that do are verified bit by bit.

Exact copies share a fingerprint and are folded before the join, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import discard, keyed, materialize, row_id, row_tag, small_batches, written

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH = 23
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GENERATOR << (bit - 11), 0)
    return rest


def _patterns(weight: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(LENGTH), weight)], np.int64)


def nearby_tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error to the nearest codeword, and the errors of weight 4 to five more (0 if there are none)."""
    nearest = np.zeros(2048, np.int64)
    for weight in range(4):
        errors = _patterns(weight)
        nearest[syndrome(errors)] = errors
    fours = _patterns(4)
    s = syndrome(fours)
    order = np.argsort(s, kind="stable")
    further = np.zeros((2048, 5), np.int64)
    further[s[order].reshape(-1, 5)[:, 0]] = fours[order].reshape(-1, 5)
    return nearest, further


NEAREST, FURTHER = nearby_tables()


def information(codewords: np.ndarray) -> np.ndarray:
    """The 12-bit index of a codeword: the code is cyclic and systematic in its upper 12 bits."""
    return codewords >> 11


def codeword_indices(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword; indices of all within 4 bits, six columns; which of these exist."""
    s = syndrome(segment)
    near = segment ^ NEAREST[s]
    more = segment[:, None] ^ FURTHER[s]
    exists = np.concatenate([np.ones((len(segment), 1), bool), FURTHER[s] != 0], axis=1)
    return information(near), information(np.concatenate([near[:, None], more], axis=1)), exists


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, side, key): side 0 emits nearest codewords where side 1 emits nearby ones."""
    u = fps.astype(np.uint64)
    seg = [((u >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    codes = [codeword_indices(s) for s in seg]
    rows, sides, keys = [], [], []
    every = np.arange(len(u))

    def emit(side: int, key: np.ndarray, exists: np.ndarray) -> None:
        grid = np.broadcast_to(every.reshape((-1,) + (1,) * (key.ndim - 1)), key.shape)[exists]
        rows.append(grid)
        sides.append(np.full(len(grid), side, np.int8))
        keys.append(key[exists])

    kind = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                exact = (seg[i] << 12) | (kind << 40)
                near, nearby, exists = codes[j]
                emit(0, exact | near, np.ones(len(u), bool))
                emit(1, exact[:, None] | nearby, exists)
                kind += 1
    (a0, a1, ae), (b0, b1, be), (c0, c1, ce) = codes
    top = kind << 40
    emit(0, top | ((a0 << 24) | (b0 << 12))[:, None] | c1, ce)
    emit(1, top | (a1 << 24)[:, :, None] | (b1 << 12)[:, None, :] | c0[:, None, None], ae[:, :, None] & be[:, None, :])
    return np.concatenate(rows), np.concatenate(sides), np.concatenate(keys)


def fingerprint(body: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 for a text without words."""
    words = body.lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):  # bounds the bit matrix of very long texts
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(first[at : at + 100_000], last[at : at + 100_000])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_id, doc_id, _tag, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    src = keyed(docs).select("_id", "doc_id", "_tag", "body")
    kind = src.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(b, shingle) for b in pdf["body"]], np.uint64)
            yield pdf[["_id", "doc_id", "_tag"]].assign(fp=fps.view(np.int64))

    return src.mapInPandas(work, f"_id long, doc_id {kind}, _tag long, fp long")


def similar_pairs(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints at ``max_distance`` (up to 3) or fewer bits. ``fps``: distinct ``fp``."""
    if max_distance > MAX_DISTANCE:
        raise ValueError("the keys find pairs at up to 3 differing bits")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            for at in range(0, len(fp), 5000):
                part = fp[at : at + 5000]
                row, side, key = fuzzy_keys(part.view(np.uint64))
                yield pd.DataFrame({"fp": part[row], "side": side, "key": key})

    keys = materialize(fps.mapInPandas(work, "fp long, side byte, key long"), "simhash-keys")
    left = keys.where("side = 0").select("key", F.col("fp").alias("x"))
    right = keys.where("side = 1").select("key", F.col("fp").alias("y"))
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_distance
    return left.join(right, "key").where((F.col("x") != F.col("y")) & close).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that node reaches. Alternates large-star and small-star steps.

    Each step hooks nodes onto the smallest neighbour by a grouped minimum and a join, so no node's
    neighbours meet in one place; the steps' tables are written to the shared folder.
    """
    (state, path), before = written(edges.select(F.col("a").alias("lo"), F.col("b").alias("hi")), "star"), None
    while True:
        both = state.unionByName(state.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("lo").alias("node")).agg(F.min("hi").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, both["lo"] == least["node"]).where("hi > lo").select(F.col("m").alias("lo"), "hi").distinct()
        large, large_path = written(large.where("lo < hi"), "star")
        floor = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        joined = large.join(floor, large["hi"] == floor["node"])
        small = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionByName(floor.select(F.col("m").alias("lo"), F.col("node").alias("hi"))).distinct()
        old, (state, path) = path, written(small, "star")
        for done in (old, large_path):
            discard(edges.sparkSession, done)
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before:
            return state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now


def _named(marked: DataFrame, max_distance: int) -> DataFrame:
    """(fp, root, component_id) of all fingerprints."""
    folded = marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(similar_pairs(folded.select("fp"), max_distance))
    rooted = folded.join(roots, folded["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    return rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, _tag, fp, root, component_id): the smallest doc_id among all documents that fingerprint links reach.

    ``root`` names the component also where it holds no doc_id; ``_tag`` is common.row_tag.

    Defined cases: a null or empty text has fingerprint 0, linked like any other; repeated rows share a
    component; rows without doc_id are linked but never name a component, which is null if nothing else is in
    it; an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
    """
    marked = materialize(fingerprints(docs, shingle), "simhash")
    return marked.join(_named(marked, max_distance), "fp").select("doc_id", "_tag", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id (rows without come last)."""
    marked = materialize(fingerprints(docs, shingle), "simhash")
    return first_rows(docs, marked, _named(marked, max_distance).select(F.col("fp").alias("node"), "root"))


def first_rows(docs: DataFrame, marked: DataFrame, roots: DataFrame) -> DataFrame:
    """The first row of ``docs`` of each root; ``marked`` has (_id, doc_id, _tag, fp). A fingerprint that is no ``node`` is its own root."""
    order = F.struct(F.col("doc_id").isNull(), "_id", "_tag")
    # The first row of each fingerprint is found before the join, so a fingerprint that many rows share meets it once.
    heads = marked.groupBy("fp").agg(F.min(order).alias("o"))
    heads = heads.join(roots, heads["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "o")
    stay = heads.groupBy("root").agg(F.min("o").alias("o")).select(F.col("o._id").alias("_id"), F.col("o._tag").alias("_tag"))
    rows = docs.select(F.struct("*").alias("row"), row_id().alias("_id"), row_tag().alias("_tag"))
    # Rows that repeat one another share id and tag: one of them stays.
    return rows.join(stay, ["_id", "_tag"], "left_semi").groupBy("_id", "_tag").agg(F.first("row").alias("row")).select("row.*")
