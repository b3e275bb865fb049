"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Texts and test items are read as lower-cased words without ASCII punctuation. Seeds are word n-grams of the items
that are rare in the corpus: one pass counts in how many documents each n-gram of the items occurs; an n-gram is a
seed if that is a small share, or if it is the rarest of the few around it, so every stretch of an
item has seeds however often it was copied. A second pass finds seeds in the documents and
aligns the item with the region around them: matches, substitutions, insertions and deletions of words are scored, and
a document is contaminated by an item if the score reaches ``THRESHOLD`` of a perfect copy's.

Documents never move: the seeds are sent to them. The items are sent in blocks of at most ``BLOCK_BYTES`` of text, as
many as it takes, so what is broadcast stays bounded whatever the size of the benchmark. Each block is counted and aligned
over the documents themselves, so blocks cost the same.

Defined cases: null and empty texts have no hits; an item under ``least_words`` words (a parameter) says too little
to be recognised and has no hits; items longer than ``PASSAGE`` words are aligned passage by passage, a short rest with the
last one; repeated items give one hit each document; repeated rows have hits one by one; empty tables give no
hits; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import keyed, row_id, row_tag, small_batches
from sparkwell.llm.repeats import refine
from sparkwell.llm.substring_dedup import word_hashes

NGRAM = 3
#: An n-gram found in at most this share of the documents is rare.
RARE_SHARE = 0.001
#: Of this many consecutive n-grams the rarest is a seed in any case.
STRETCH = 3
LEAST_WORDS = 5
PASSAGE = 200
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
BLOCK_BYTES = 8_000_000
_PLAIN = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))
HITS = "array<struct<item_id:long,score:double,first:long,last:long>>"


def plain_hashes(body: bytes) -> np.ndarray:
    return word_hashes(body.translate(_PLAIN))


def batch_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the plain words of many texts, and how many each text has."""
    each = [b.translate(_PLAIN) for b in bodies]
    return word_hashes(b" ".join(each)), np.array([len(b.split()) for b in each], np.int64)


def local_alignment(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words with linear gaps: the best score, and the first and last position in ``text``."""
    n = len(text)
    score, origin = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    steps = np.arange(n + 1) * -GAP
    for w in item:
        step = np.where(text == w, MATCH, MISMATCH)
        through, above = score[:-1] + step, score[1:] + GAP
        new, start = np.zeros(n + 1), np.arange(n + 1)
        take = through > 0
        new[1:][take], start[1:][take] = through[take], origin[:-1][take]
        take = above > new[1:]
        new[1:][take], start[1:][take] = above[take], origin[1:][take]
        # A run of insertions: the best earlier cell less the gaps since.
        lifted = new + steps
        source = np.maximum.accumulate(np.where(lifted >= np.maximum.accumulate(lifted), np.arange(n + 1), 0))
        run = lifted[source] - steps
        take = run > new
        new[take], start[take] = run[take], start[source][take]
        score, origin = new, start
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (float(score[at]), int(origin[at]), at - 1)
    return best


class Seeds:
    """The passages of a block of items and the n-grams that lead to them."""

    def __init__(self, items: list[tuple[int, bytes]], least_words: int = LEAST_WORDS):
        parts, of, grams, owner, at = [], [], [], [], []
        for item_id, body in items:
            words = plain_hashes(body)
            if len(words) < max(least_words, NGRAM):
                continue
            starts = range(0, max(1, len(words) - LEAST_WORDS + 1), PASSAGE)
            for i in starts:
                part = words[i : i + PASSAGE if i < starts[-1] else len(words)]
                g = refine(part, 1, NGRAM)
                grams.append(g)
                owner.append(np.full(len(g), len(parts)))
                at.append(np.arange(len(g)))
                parts.append(part)
                of.append(item_id)
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.words, self.ends, self.item = cat(parts, np.uint64), np.cumsum([len(x) for x in parts], dtype=np.int64), np.array(of, np.int64)
        self.grams, self.owner, self.at = cat(grams, np.uint64), cat(owner, np.int64), cat(at, np.int64)
        self.sort()

    def arrays(self) -> dict[str, np.ndarray]:
        """All that ``of`` needs; plain arrays can be broadcast to workers that lack this package."""
        return dict(vars(self))

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Seeds:
        out = cls([])
        vars(out).update(arrays)
        return out

    def passage(self, p: int) -> np.ndarray:
        return self.words[self.ends[p - 1] if p else 0 : self.ends[p]]

    def sort(self) -> None:
        order = np.argsort(self.grams, kind="stable")
        self.grams, self.owner, self.at = self.grams[order], self.owner[order], self.at[order]
        self.distinct = np.unique(self.grams)

    def keep_rare(self, count: np.ndarray, documents: int) -> None:
        """count: by distinct n-gram, the documents that hold it."""
        of = count[np.searchsorted(self.distinct, self.grams)]
        order = np.lexsort((self.at, self.owner))
        of, owner = of[order], self.owner[order]
        n, none = len(of), np.iinfo(np.int64).max
        keep = of <= RARE_SHARE * documents
        # Each row: an n-gram and the ones after it in its passage; the rarest of a whole stretch, or of a short passage, stays.
        stretch = np.full((n, STRETCH), none)
        for j in range(STRETCH):
            stretch[: n - j, j] = np.where(owner[j:] == owner[: n - j], of[j:], none)
        first = np.ones(n, bool)
        first[1:] = owner[1:] != owner[:-1]
        rows = np.flatnonzero(first | (stretch[:, -1] < none))
        keep[rows + stretch[rows].argmin(1)] = True
        mask = np.zeros(n, bool)
        mask[order] = keep
        self.grams, self.owner, self.at = self.grams[mask], self.owner[mask], self.at[mask]
        self.sort()

    def found(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of a batch at which one of the n-grams starts, and its index among the distinct ones."""
        ids = refine(h, 1, NGRAM)
        if not len(ids) or not len(self.distinct):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        index = np.searchsorted(self.distinct, ids)
        index[index == len(self.distinct)] = 0
        left = np.repeat(np.cumsum(sizes), sizes)[: len(ids)] - np.arange(len(ids))
        pos = np.flatnonzero((self.distinct[index] == ids) & (left >= NGRAM))
        return pos, index[pos]

    def hits(self, h: np.ndarray, pos: np.ndarray, gram: np.ndarray) -> list[dict]:
        """The items that one document aligns with. pos: in the document."""
        lo, hi = np.searchsorted(self.grams, self.distinct[gram], "left"), np.searchsorted(self.grams, self.distinct[gram], "right")
        n = hi - lo
        where = np.repeat(pos, n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out: dict[int, dict] = {}
        owner = self.owner[entry]
        for p in np.unique(owner):
            item_id, words = int(self.item[p]), self.passage(p)
            reach = 2 * len(words) + 8
            spots = np.sort(where[owner == p])
            for spot in np.split(spots, np.flatnonzero(np.diff(spots) > reach) + 1):
                a = max(0, int(spot[0]) - reach)
                score, first, last = local_alignment(words, h[a : int(spot[-1]) + reach])
                score /= MATCH * len(words)
                if score >= THRESHOLD and (item_id not in out or score > out[item_id]["score"]):
                    out[item_id] = {"item_id": item_id, "score": score, "first": a + first, "last": a + last}
        return [out[k] for k in sorted(out)]


    def scan(self, bodies: list[bytes]) -> dict[int, list[dict]]:
        """The hits of a batch of texts, by the index of the text."""
        h, sizes = batch_hashes(bodies)
        pos, gram = self.found(h, sizes)
        base = np.cumsum(sizes) - sizes
        doc = np.searchsorted(np.cumsum(sizes), pos, "right")
        out = {}
        for d in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
            if hits := self.hits(h[base[d] : base[d] + sizes[d]], pos[a:b] - base[d], gram[a:b]):
                out[d] = hits
        return out


def _blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int, least_words: int) -> list[Broadcast]:
    """The seeds of each block of items, as broadcast arrays of at most a few times ``block_bytes``."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    out = []
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        seeds = Seeds(sorted((r["item_id"], bytes(r["body"])) for r in part.collect()), least_words)
        known = spark.sparkContext.broadcast(seeds.distinct)
        counted = keyed(docs).select("body").mapInPandas(_counter(known), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        gram, n = counted["gram"].to_numpy(), counted["n"].to_numpy()  # a row for each n-gram of the block at most
        by_gram = np.zeros(len(seeds.distinct), np.int64)
        by_gram[gram[gram >= 0]] = n[gram >= 0]
        seeds.keep_rare(by_gram, int(n[gram < 0].sum()))
        known.unpersist()
        out.append(spark.sparkContext.broadcast(seeds.arrays()))
    return out


def _counter(known: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts for each n-gram the documents that hold it; -1 counts all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, documents = np.zeros(len(known.value), np.int64), 0
        probe = Seeds([])
        probe.distinct = known.value
        for pdf in batches:
            h, sizes = batch_hashes(list(pdf["body"]))
            pos, gram = probe.found(h, sizes)
            documents += len(sizes)
            pairs = np.unique(np.searchsorted(np.cumsum(sizes), pos, "right") * (len(total) + 1) + gram)
            np.add.at(total, pairs % (len(total) + 1), 1)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": np.r_[-1, some], "n": np.r_[documents, total[some]]})

    return count


def _hits(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(_id, _tag, doc_id, hits) of the documents that hold copies of one block's items."""
    src = keyed(docs)
    kind = src.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Seeds.of(sent.value)
        for pdf in batches:
            found = seeds.scan(list(pdf["body"]))
            some = list(found)
            yield pdf.iloc[some][["_id", "_tag", "doc_id"]].assign(hits=pd.Series(list(found.values()), index=pdf.index[some], dtype=object))

    return src.mapInPandas(align, f"_id long, _tag long, doc_id {kind}, hits {HITS}")


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first, last): one row for each document and item it holds a copy of; word positions."""
    blocks = [_hits(docs, sent) for sent in _blocks(docs, benchmark, block_bytes, least_words)]
    if not blocks:
        return docs.limit(0).select("doc_id", F.inline(F.array().cast(HITS)))
    return reduce(DataFrame.unionByName, blocks).select("doc_id", F.inline("hits"))


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` without hits. One block is filtered in place; of more, the hits meet the rows by their keys."""
    blocks = _blocks(docs, benchmark, block_bytes, least_words)
    if len(blocks) > 1:
        hit = reduce(DataFrame.unionByName, [_hits(docs, sent).select("_id", "_tag") for sent in blocks]).distinct()
        rows = docs.select(F.struct("*").alias("row"), row_id().alias("_id"), row_tag().alias("_tag"))
        return rows.join(hit, ["_id", "_tag"], "left_anti").select("row.*")
    if not blocks:
        return docs
    (sent,) = blocks

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds.of(sent.value)
        for batch in batches:
            found = seeds.scan([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in found], pa.int64()))

    return docs.mapInArrow(keep, docs.schema)
