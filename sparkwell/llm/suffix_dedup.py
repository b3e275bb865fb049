"""Byte-level deduplication by bucket-pointer refinement over sampled suffixes.

Buckets of suffixes start out as 16-grams. A bucket is refined by the bucket identifiers of the same suffixes
at a later offset, and the refined identifiers serve the next step, so 16 bytes become 32, 64, 128, 256
and then 400 (256 and 256 at offset 144). Identifiers are 64-bit hashes of what the bucket's suffixes share, so
every task refines its own documents and tasks agree without a shuffle; a shuffle only tells which buckets hold
more than one suffix.

Not every suffix is sent. Of the 145 offsets of each 400-byte string at which a 256-gram fits, the one with the
least 16-gram bucket stands for the string: equal strings choose alike, and neighbours share their choice.
One entry covers the whole run of strings with one choice. If all members of its 256-gram bucket cover the
same bytes, they are repeated as they stand. Where members differ (at the edges of repeats) the strings of
those runs are refined to 400 bytes, sent one by one and compared by 96 bits.

Defined cases: null and empty texts, and texts under 400 bytes, lose nothing; each row is a document, so
repeated rows remove each other; overlapping repeats within a document count; an empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkwell.llm.common import keyed, materialize, small_batches
from sparkwell.llm.repeats import EDGE, MARK, WHOLE, bucket_count, entries, refine, repeats, scramble, seeds, spread, squeezed, unpack, unsqueeze

WINDOW = 400
FIRST = 16
DEEP = 256
CHOICES = WINDOW - DEEP + 1
BYTES, OTHER = seeds(256, 1), seeds(256, 2)
#: Suffixes refined at once; bounds memory on very long texts.
CHUNK = 1 << 20
PLACE = np.uint64((1 << 21) - 1)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        a = np.minimum(a[:-step], a[step:])
        size += step
    return a


def _joined(bodies: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bodies], np.int64)
    return b"".join(bodies), np.cumsum(sizes) - sizes, sizes


def _rows(pdf: pd.DataFrame, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    e = entries(len(row))
    e["id"], e["tag"], e["pos"] = pdf["_id"].to_numpy(np.int64)[row], pdf["_tag"].to_numpy(np.int64)[row], pos
    return e


def scan_runs(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    """An entry for each run of 400-byte strings that one suffix stands for."""
    data, base, sizes = _joined(list(pdf["body"]))
    raw = np.frombuffer(data, np.uint8)
    last = base + sizes - WINDOW  # the last string's start in each document
    for at in range(0, len(raw) - WINDOW + 1, CHUNK):
        part = raw[at : at + CHUNK + WINDOW - 1]
        ids = refine(BYTES[part], 1, FIRST)
        ranked = (scramble(ids) & ~PLACE) | np.arange(len(ids), dtype=np.uint64)  # ties: the leftmost
        deep = refine(ids, FIRST, DEEP)
        full = refine(deep, DEEP, WINDOW)
        choice = (sliding_min(ranked[: len(deep)], CHOICES) & PLACE).astype(np.int64)
        start = np.arange(at, at + len(full))
        row = np.searchsorted(base, start, side="right") - 1
        ok = start <= last[row]
        start, row, choice = start[ok] - at, row[ok], choice[ok]
        if not len(start):
            continue
        new = np.r_[True, (choice[1:] != choice[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]
        lo, hi = start[new], start[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
        e = _rows(pdf, row[new], lo + at - base[row[new]])
        e["key"], e["len"] = deep[choice[new]], hi - lo + 1
        # The run's bytes are those of its first and last string, which overlap.
        same = scramble(full[lo] + np.uint64(3) * full[hi] + (choice[new] - lo).astype(np.uint64))
        e["check"] = ((same + e["len"].astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
        yield e


def scan_edges(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    """The single 400-byte strings of runs whose buckets differ."""
    bodies = [unsqueeze(b) for b in pdf["body"]]
    for r, (body, blob) in enumerate(zip(bodies, pdf["marks"])):
        marks = unpack(blob, MARK)
        marks = marks[marks["kind"] == EDGE]
        raw = np.frombuffer(body, np.uint8)
        want = np.flatnonzero(spread(marks["pos"].astype(np.int64), marks["pos"].astype(np.int64) + marks["len"], len(raw)))
        if not len(want):
            continue
        stretch = np.split(want, np.flatnonzero(np.diff(want) > WINDOW) + 1)
        for s in (s[i : i + CHUNK] for s in stretch for i in range(0, len(s), CHUNK)):
            part = raw[s[0] : s[-1] + WINDOW]
            ids, second = refine(BYTES[part], 1, WINDOW), refine(OTHER[part], 1, WINDOW)
            e = _rows(pdf, np.full(len(s), r), s)
            e["key"], e["check"], e["len"] = ids[s - s[0]], (second[s - s[0]] >> np.uint64(32)).astype(np.uint32), 1
            yield e


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): ``spans`` are the removed runs of bytes (first, last); ``kept`` is binary."""
    small_batches(docs.sparkSession)
    src = keyed(docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    n = bucket_count(src)
    runs = materialize(repeats(src.select("_id", "_tag", "body"), scan_runs, False, n), "suffix-runs")
    moved = squeezed(src)
    edges = repeats(moved.select("_id", "_tag", "body").join(runs, ["_id", "_tag"]), scan_edges, True, n)
    found = runs.join(edges.withColumnRenamed("marks", "single"), ["_id", "_tag"], "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for squeezed_body, marks, single in zip(pdf["body"], pdf["marks"], pdf["single"]):
                body = unsqueeze(squeezed_body)
                starts, ends = np.empty(0, np.int64), np.empty(0, np.int64)
                for blob in (marks, single):
                    if blob is not None:
                        m = unpack(blob, MARK)
                        m = m[m["kind"] == WHOLE]
                        starts, ends = np.r_[starts, m["pos"]], np.r_[ends, m["pos"] + m["len"] - 1 + WINDOW]
                if len(starts):
                    gone = spread(starts, ends, len(body))
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]
                    rows.append((len(body), int(gone.sum()), spans, np.frombuffer(body, np.uint8)[~gone].tobytes()))
                else:
                    rows.append((len(body), 0, [], body))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return moved.join(found, ["_id", "_tag"], "left").select("doc_id", "body", "marks", "single").mapInPandas(cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<first:long,last:long>>, kept binary")
