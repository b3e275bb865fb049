"""Which keys occur twice or more, over the whole corpus, at the cost of one compact shuffle.

Scans emit arrays of (key, check, document, position, length). Each task folds its own repeats before
anything moves and sends at most one entry for a key, packed by bucket of the key; a bucket is joined by
sorting and answers only to entries whose key repeats. A key that a third of all documents hold therefore
costs one entry a task. Answers are regrouped by document: (_id, _tag, marks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import partitions

#: Entries that a task gathers before it folds and sends them.
FLUSH = 1_000_000
#: Bytes of text whose entries meet in one bucket, which a task holds in memory.
BUCKET_BYTES = 64 << 20
ENTRY = np.dtype([("key", "<u8"), ("check", "<u4"), ("id", "<i8"), ("tag", "<i8"), ("pos", "<i4"), ("len", "<i4"), ("flag", "u1")])
MARK = np.dtype([("id", "<i8"), ("tag", "<i8"), ("pos", "<i4"), ("len", "<i4"), ("kind", "u1")])
#: Entry flags: alone in its task, one of several equal ones, or of several unlike ones (no answer wanted).
ALONE, SEVERAL, MIXED = 0, 1, 2
#: Mark kinds: all that the entry covers is repeated; some of it may be.
WHOLE, EDGE = 0, 1

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return scramble((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * M1)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket identifier of a string from those of its two parts."""
    x = a * M1
    x ^= x >> np.uint64(29)
    x += b
    x *= M2
    x ^= x >> np.uint64(32)
    return x


def refine(ids: np.ndarray, depth: int, width: int) -> np.ndarray:
    """From identifiers of all strings of ``depth`` to those of ``width``: each is refined by the identifier at a later
    offset, and the refined identifiers are used for the next step, which doubles the depth."""
    while depth < width:
        step = min(depth, width - depth)
        if len(ids) <= step:
            return ids[:0]
        ids = combine(ids[:-step], ids[step:])
        depth += step
    return ids


def pack(a: np.ndarray) -> bytes:
    """Column by column, so that like bytes lie together."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a[f]).tobytes() for f in a.dtype.names))


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = np.empty(len(raw) // dtype.itemsize, dtype), 0
    for f in dtype.names:
        size = len(out) * dtype[f].itemsize
        out[f] = np.frombuffer(raw, dtype[f], len(out), at)
        at += size
    return out


def by_bucket(a: np.ndarray, bucket: np.ndarray, kind: int) -> pd.DataFrame:
    """One packed row for each bucket that has entries; in a row they lie by document and position, which packs best."""
    order = np.lexsort((a["pos"], a["tag"], a["id"], bucket))
    names, starts = np.unique(bucket[order], return_index=True)
    parts = np.split(a[order], starts[1:]) if len(a) else []
    return pd.DataFrame({"bucket": names.astype(np.int32), "kind": np.full(len(names), kind, np.int8), "blob": [pack(p) for p in parts]})


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together, and the number of the group of each in that order."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new)


def _marks(e: np.ndarray, kind: int) -> np.ndarray:
    out = np.empty(len(e), MARK)
    for f in ("id", "tag", "pos", "len"):
        out[f] = e[f]
    out["kind"] = kind
    return out


def fold(e: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a task sends, and the marks that it can set by itself.

    strict: equal means equal key and check. Otherwise entries of one key but unlike checks are a mixed group: what
    they cover is alike in part, so each distinct one must be looked at closely (an EDGE mark).
    """
    e = e[np.lexsort((e["pos"], e["id"], e["check"], e["key"]))]
    n = len(e)
    new_key = np.ones(n, bool)
    new_key[1:] = e["key"][1:] != e["key"][:-1]
    new_pair = new_key.copy()
    new_pair[1:] |= e["check"][1:] != e["check"][:-1]
    pair = np.cumsum(new_pair) - 1
    pair_size = np.bincount(pair, minlength=1)
    marks = [_marks(e[pair_size[pair] > 1], WHOLE)] if n else []
    if strict:
        sent = e[new_pair]
        sent["flag"] = np.where(pair_size > 1, SEVERAL, ALONE)[: len(sent)]
    else:
        key = np.cumsum(new_key) - 1
        unlike = np.bincount(key[new_pair], minlength=1) > 1
        heads = new_pair & unlike[key] if n else new_pair
        marks.append(_marks(e[heads], EDGE))
        sent = e[new_key]
        sent["flag"] = np.where(unlike, MIXED, np.where(pair_size[pair[new_key]] > 1, SEVERAL, ALONE)) if n else 0
    return sent, np.concatenate(marks) if marks else np.empty(0, MARK)


def answer(e: np.ndarray, strict: bool) -> np.ndarray:
    """Marks for the entries of one bucket whose keys repeat."""
    order, group = _groups([e["key"], e["check"]] if strict else [e["key"]])
    e = e[order]
    size = np.bincount(group, minlength=1)
    if strict:
        return _marks(e[(size[group] > 1) & (e["flag"] == ALONE)], WHOLE)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(e) else np.empty(0, int)
    unlike = e["check"] != e["check"][first][group] if len(e) else np.empty(0, bool)
    mixed = np.bincount(group, weights=unlike | (e["flag"] == MIXED), minlength=1) > 0
    more = (size[group] > 1) & (e["flag"] != MIXED)
    return np.concatenate([_marks(e[more & ~mixed[group]], WHOLE), _marks(e[more & mixed[group]], EDGE)])


def bucket_count(docs: DataFrame) -> int:
    """Buckets for a corpus (column ``body``): each gets the entries of at most about BUCKET_BYTES of text, whatever the corpus's size."""
    size = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def repeats(source: DataFrame, scan: Callable[[pd.DataFrame], Iterator[np.ndarray]], strict: bool, n: int) -> DataFrame:
    """(_id, _tag, marks): for each document with marked entries, its marks in order, packed as MARK. ``n``: buckets."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                sent, marks = fold(np.concatenate(held), strict)
                held.clear()
                yield by_bucket(sent, (sent["key"] >> np.uint64(7)) % np.uint64(n), 0)
                yield by_bucket(marks, scramble(marks["id"].astype(np.uint64)) % np.uint64(n), 1)

        for pdf in batches:
            for entries in scan(pdf):
                held.append(entries)
                if sum(map(len, held)) >= FLUSH:
                    yield from flush()
        yield from flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        entries = [unpack(b, ENTRY) for b in pdf.loc[pdf["kind"] == 0, "blob"]]
        marks = [unpack(b, MARK) for b in pdf.loc[pdf["kind"] == 1, "blob"]]
        if entries:
            marks.append(answer(np.concatenate(entries), strict))
        marks = np.concatenate(marks) if marks else np.empty(0, MARK)
        return by_bucket(marks, scramble(marks["id"].astype(np.uint64)) % np.uint64(n), 1)

    def regroup(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.concatenate([unpack(b, MARK) for b in pdf["blob"]])
        marks = marks[np.lexsort((marks["pos"], marks["tag"], marks["id"]))]
        new = np.ones(len(marks), bool)
        new[1:] = (marks["id"][1:] != marks["id"][:-1]) | (marks["tag"][1:] != marks["tag"][:-1])
        first = np.flatnonzero(new)
        return pd.DataFrame({"_id": marks["id"][first], "_tag": marks["tag"][first], "marks": [pack(m) for m in np.split(marks, first[1:])]})

    packed = "bucket int, kind byte, blob binary"
    sent = source.mapInPandas(send, packed)
    met = sent.groupBy("bucket").applyInPandas(meet, packed)
    return met.groupBy("bucket").applyInPandas(regroup, "_id long, _tag long, marks binary")


def squeezed(docs: DataFrame) -> DataFrame:
    """The same rows with compressed bodies: texts that must move to their marks move at less than half their size."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack_ = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            pdf["body"] = [pack_.compress(b) for b in pdf["body"]]
            yield pdf

    return docs.mapInPandas(work, docs.schema)


def unsqueeze(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """bool[n]: covered by one of the half-open intervals."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.clip(starts, 0, n), 1)
    np.add.at(delta, np.clip(ends, 0, n), -1)
    return np.cumsum(delta)[:n] > 0


def entries(n: int) -> np.ndarray:
    return np.zeros(n, ENTRY)
