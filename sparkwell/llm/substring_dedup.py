"""Substring deduplication over words by difference-cover anchors.

Positions of a document are anchors if their remainder modulo 21 is in a perfect difference set, 5 of 21.
Whatever two positions a match of 35 words starts at, one shift below 21 brings both onto anchors, and the
15 words from there on still lie inside the match. So hashing 15 words at anchors finds every match; where an
anchor repeats, the windows of 35 words around it are compared exactly (by 96 bits), which extends it to the
whole match.

Defined cases: null and empty texts, and texts under 35 words, lose nothing; each row is a document, so
repeated rows remove each other; overlapping repeats within a document count; an empty table gives an empty
result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkwell.llm.common import keyed, small_batches
from sparkwell.llm.repeats import M1, MARK, bucket_count, entries, refine, repeats, scramble, seeds, spread, squeezed, unpack, unsqueeze

WINDOW = 35
PERIOD = 21
#: Every remainder but 0 is exactly one difference of two of these.
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
BYTES = seeds(256, 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once; bounds memory on very long texts.
CHUNK = 1 << 21


def word_hashes(body: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    out, at = [], 0
    while at < len(body):
        end = at + CHUNK
        while end < len(body) and not SPACE[body[end]]:
            end += 1
        part = np.frombuffer(body, np.uint8, min(end, len(body)) - at, at)
        at = end
        inside = ~SPACE[part]
        starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]])
        if len(starts):
            place = np.flatnonzero(inside)
            word = np.cumsum(np.r_[True, ~inside[:-1]][place] | (place == 0)) - 1
            value = scramble(BYTES[part[place]] + (place - starts[word]).astype(np.uint64) * M1)
            out.append(scramble(np.add.reduceat(value, np.searchsorted(place, starts))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _batch(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a batch; for each word its row and its position in its document."""
    each = [word_hashes(b) for b in pdf["body"]]
    sizes = np.array([len(h) for h in each], np.int64)
    row = np.repeat(np.arange(len(each)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate(each) if each else np.empty(0, np.uint64), row, at


def _entries(pdf: pd.DataFrame, row: np.ndarray, at: np.ndarray, key: np.ndarray, check: np.ndarray | int) -> np.ndarray:
    e = entries(len(row))
    e["id"], e["tag"] = pdf["_id"].to_numpy(np.int64)[row], pdf["_tag"].to_numpy(np.int64)[row]
    e["pos"], e["key"], e["check"], e["len"] = at, key, check, 1
    return e


def scan_anchors(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    h, row, at = _batch(pdf)
    ids = refine(h, 1, ANCHOR)
    n = len(ids)
    size = np.bincount(row, minlength=len(pdf))
    ok = np.isin(at[:n] % PERIOD, COVER) & (at[:n] + ANCHOR <= size[row[:n]]) & (size[row[:n]] >= WINDOW)
    yield _entries(pdf, row[:n][ok], at[:n][ok], ids[ok], 0)


def scan_windows(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    """Windows of 35 words that hold a repeated anchor in their first 21 positions."""
    pdf = pdf.assign(body=[unsqueeze(b) for b in pdf["body"]])
    h, row, at = _batch(pdf)
    size = np.bincount(row, minlength=len(pdf))
    base = np.cumsum(size) - size
    pos = [unpack(m, MARK)["pos"] + b for m, b in zip(pdf["marks"], base)]
    anchor = np.concatenate(pos) if pos else np.empty(0, np.int64)
    near = spread(anchor - (PERIOD - 1), anchor + 1, len(h))
    ids, second = refine(h, 1, WINDOW), refine(scramble(h + M1), 1, WINDOW)
    n = len(ids)
    ok = near[:n] & (at[:n] + WINDOW <= size[row[:n]])
    yield _entries(pdf, row[:n][ok], at[:n][ok], ids[ok], (second[ok] >> np.uint64(32)).astype(np.uint32))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): ``spans`` are the removed runs of words, (first, last)."""
    small_batches(docs.sparkSession)
    src = keyed(docs)
    kind = src.schema["doc_id"].dataType.simpleString()
    n = bucket_count(src)
    anchors = repeats(src.select("_id", "_tag", "body"), scan_anchors, True, n)
    moved = squeezed(src)
    windows = repeats(moved.select("_id", "_tag", "body").join(anchors, ["_id", "_tag"]), scan_windows, True, n)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, body, marks in zip(pdf["doc_id"], pdf["body"], pdf["marks"]):
                words = unsqueeze(body).split()
                gone = np.zeros(len(words), bool)
                if marks is not None:
                    starts = unpack(marks, MARK)["pos"].astype(np.int64)
                    gone = spread(starts, starts + WINDOW, len(words))
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]
                rows.append((doc_id, len(words), int(gone.sum()), spans, b" ".join(compress(words, ~gone)).decode("utf-8", "replace")))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])
            out["doc_id"] = pdf["doc_id"].to_numpy()
            yield out

    return moved.join(windows, ["_id", "_tag"], "left").select("doc_id", "body", "marks").mapInPandas(cut, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<first:long,last:long>>, kept_text string")
