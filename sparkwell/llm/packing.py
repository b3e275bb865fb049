"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. A window takes from every queue its quantum, the queue's target share of the
window; what a quantum has over whole tokens is carried as a deficit to the next window, and the queues with
the largest deficits get the tokens that rounding leaves. When a queue runs dry the others' shares are scaled
up (a new phase); what is left in the end fills the last windows one after another, and the last, part-filled
window is cut into powers of two, so nothing is padded.

How many tokens a queue has been served after k windows has a closed form, so deficits need not be passed
from task to task: a task that knows where its documents start in their queues computes which windows
they fall into. The starts are running sums of small totals by task and source. Texts are tokenized once; only their
ids are written to the shared folder. A source may hold any share of the rows: queues are never gathered.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by one; rows without a
source share a queue; sources under 1/256 of all tokens that no mixture names share one queue too; an empty table gives an empty
result; columns besides ``doc_id``, ``text`` and ``source`` are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwell.llm.common import materialize, small_batches

SEQUENCE = 4096
END_ID = 2
#: Queues of their own go to sources with at least this share of all tokens, or that a mixture names; bounds the plan.
LEAST_SHARE = 256
#: Bytes of words and ids that a task remembers, with the overhead of a dictionary's entry.
MEMORY_BYTES, ENTRY_BYTES = 64 << 20, 160
#: Rows of task and source totals up to which they are broadcast (about 10 MB); beyond, Spark shuffles for the join.
BROADCAST_ROWS = 100_000
#: A mark after a letter or digit is a token of its own in any case; apart, the word before it is met more often.
TRAILING = re.compile(rb"(?<=[A-Za-z0-9])([.,]+)(?=[\x09-\x0d ]|$)")
#: A final mark that follows neither an ASCII letter or digit nor a Latin letter in two bytes: plain replacement won't do.
ODD = re.compile(rb"(?<![A-Za-z0-9])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,](?=[\x09-\x0d ]|$)")
#: Byte classes that tell texts in which ODD needs no search.
CLASSES = bytes(97 if chr(b).isalnum() and b < 128 else 100 if b in b".," else 32 if b in b"\t\n\x0b\x0c\r " else 112 for b in range(256))
#: Stands between words that are tokenized in one call; it is one token that no other word yields.
BETWEEN = b"|"
TOGETHER = 2000
#: Words whose ids are put in place at once; bounds memory on very long texts.
STEP = 1 << 20
LETTERS = re.compile(rb"[a-z]+").fullmatch
#: What WordTokenizer relies on, tried before it is used.
TRIAL = "Plain words, and MORE of them. don't 12.5, (a,b).. naïve, É. «x». 日本語、テスト。 a|b |c| x_y e\u0301. \ufb01n, ??! #$%&* ünï.\r\n\tthe end."


def spaced(body: bytes) -> bytes:
    """A text with its words' final marks apart and A-Z lower-cased, which this kind of tokenizer does itself."""
    if b"<|" not in body:  # may be a special token, whose letters count
        body = body.lower()
    kinds = body.translate(CLASSES)
    if (b"pd" in kinds or b"dd" in kinds) and ODD.search(body):
        return TRAILING.sub(rb" \1", body)
    for mark in (b".", b","):
        body = body.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
    return body


class WordTokenizer:
    """Ids of whole texts by way of their words, for tokenizers that lower-case, drop white space and never merge across it."""

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        self.known: dict[bytes, bytes] = {}
        self.room = MEMORY_BYTES
        between = self.model.encode(BETWEEN.decode(), add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words, letters by the model alone and others many a call."""
        merge = self.model.model.tokenize
        out = {w: array("I", [t.id for t in merge(w.decode())]).tobytes() for w in new if LETTERS(w)}
        plain = [] if self.between is None else [w for w in new if w not in out and BETWEEN not in w and b"<|" not in w]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            joined = (b" " + BETWEEN + b" ").join(part).decode("utf-8", "replace")
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for word, end in zip(part, [*np.flatnonzero(ids == self.between).tolist(), len(ids)]):
                out[word] = raw[4 * start : 4 * end]
                start = end + 1
        for word in new:
            if word not in out:
                out[word] = self.whole(word.decode("utf-8", "replace"))
        return out

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """Little-endian uint32 ids of each text: each distinct word of the batch is looked up once, the rest are NumPy look-ups."""
        split = pc.ascii_split_whitespace(pa.array([spaced(b) for b in bodies], pa.large_binary()).cast(pa.large_string(), safe=False))
        ends, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        found = list(map(self.known.get, distinct))
        new = self.words([w for w, i in zip(distinct, found) if i is None])
        if self.room > 0:  # else the new ones are forgotten after this batch
            self.known.update(new)
            self.room -= sum(len(w) + len(i) + ENTRY_BYTES for w, i in new.items())
        found = [new[w] if i is None else i for w, i in zip(distinct, found)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start, pool = np.cumsum(size) - size, np.frombuffer(b"".join(found), "<u4")
        codes, out, before = coded.indices.to_numpy(), [], np.zeros(len(coded) + 1, np.int64)
        for at in range(0, len(codes), STEP):
            part = codes[at : at + STEP]
            n = size[part]
            last = np.cumsum(n)
            out.append(pool[np.repeat(start[part] - last + n, n) + np.arange(last[-1])].tobytes())
            before[at + 1 : at + 1 + len(part)] = before[at] + last
        ids, edge = b"".join(out), (4 * before[ends]).tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]

    def check(self) -> None:
        """Raise if ids by words differ from ids of the whole text: a tokenizer of another kind."""
        for text in (TRIAL, TRIAL.upper(), TRIAL.replace(" ", "  ")):
            if self.encode([text.encode()])[0] != self.whole(text):
                raise ValueError("this tokenizer doesn't read texts word by word in lower case")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(task, source, before, doc_id, n_tokens, ids): ``before`` counts the source's tokens earlier in the task."""
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    WordTokenizer(text).check()
    definition = docs.sparkSession.sparkContext.broadcast(text)  # one vocabulary file, a few MB
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    src = docs.select("doc_id", source.alias("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    kind = src.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, squeeze = WordTokenizer(definition.value), zstandard.ZstdCompressor(level=1)
        served: dict[str, int] = defaultdict(int)
        task = TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for name, ids in zip(pdf["source"], model.encode(list(pdf["body"]))):
                n = len(ids) // 4 + 1
                rows.append((task, name, served[name], n, squeeze.compress(ids + end)))
                served[name] += n
            out = pd.DataFrame(rows, columns=["task", "source", "before", "n_tokens", "ids"])
            out.insert(3, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return src.mapInPandas(work, f"task int, source string, before long, doc_id {kind}, n_tokens long, ids binary")


@dataclass
class Phase:
    """``windows`` windows from ``first`` on, in which queue i gets quantum[i] / 2**bits tokens each, from served[i] on."""

    first: int
    windows: int
    bits: int
    quantum: np.ndarray
    served: np.ndarray

    def after(self, k: np.ndarray) -> np.ndarray:
        """Tokens [k, queue] served after k windows of the phase: whole quanta, and the largest deficits rounded up."""
        exact = k[:, None] * (self.quantum >> self.bits)[None, :]
        part = k[:, None] * (self.quantum & ((1 << self.bits) - 1))[None, :]
        out = exact + (part >> self.bits)
        deficit = part & ((1 << self.bits) - 1)
        spare = k * SEQUENCE - out.sum(1)
        # Queues with less than a token a window wait until their deficit is a token.
        order = np.argsort(np.where(self.quantum >= 1 << self.bits, -deficit, 1), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
        return out + (rank < spare[:, None]) + self.served


def plan(totals: list[int], targets: list[float], size: int = SEQUENCE) -> tuple[list[Phase], np.ndarray, int]:
    """Phases, tokens of each queue that they serve, and windows that they fill."""
    phases: list[Phase] = []
    served = [0] * len(totals)
    active = [i for i, n in enumerate(totals) if n and targets[i] > 0]
    first = 0
    bits = 62 - max(1, (sum(totals) // size + 1).bit_length()) - 1
    bits = min(bits, 40)
    while active:
        whole = sum(targets[i] for i in active)
        quantum = [0] * len(totals)
        for i in active:
            quantum[i] = int(targets[i] / whole * size * (1 << bits))
        top = max(active, key=lambda i: quantum[i])
        quantum[top] += (size << bits) - sum(quantum)
        k = min(((totals[i] - served[i] - 1) << bits) // quantum[i] if quantum[i] else 0 for i in active)
        if k > 0:
            phases.append(Phase(first, k, bits, np.array(quantum, np.int64), np.array(served, np.int64)))
            served = [int(x) for x in phases[-1].after(np.array([k], np.int64))[0]]
            first += k
        ended = {i for i in active if ((totals[i] - served[i]) << bits) <= quantum[i] + (2 << bits)} or set(active)
        active = [i for i in active if i not in ended]
    return phases, np.array(served, np.int64), first


def place(phases: list[Phase], tail_from: np.ndarray, tail_at: np.ndarray, tail_window: int, tail_total: int, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (row, start in the document, length, sequence, offset) of documents at ``start`` in their queues."""
    out: list[tuple[np.ndarray, ...]] = []
    for p in phases:
        each = p.quantum[queue] / float(1 << p.bits)
        end = np.minimum(start + length, p.after(np.array([p.windows], np.int64))[0][queue])
        begin = np.maximum(start, p.served[queue])
        live = np.flatnonzero((end > begin) & (each > 0))
        if not len(live):
            continue
        lo = np.maximum(0, np.floor((begin[live] - p.served[queue[live]] - 1) / each[live]).astype(np.int64) - 2)
        hi = np.minimum(p.windows - 1, np.ceil((end[live] - p.served[queue[live]] + 1) / each[live]).astype(np.int64) + 2)
        for cut in np.array_split(np.arange(len(live)), max(1, int((hi - lo + 1).sum() * len(p.quantum) // 2_000_000))):
            n = hi[cut] - lo[cut] + 1
            who = np.repeat(cut, n)
            k = np.repeat(lo[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ks, back = np.unique(k, return_inverse=True)
            before, after = p.after(ks), p.after(ks + 1)
            share = after - before
            at = np.cumsum(share, axis=1) - share
            row, q = live[who], queue[live[who]]
            a, b = np.maximum(begin[row], before[back, q]), np.minimum(end[row], after[back, q])
            ok = b > a
            row, q, a, b, back, k = row[ok], q[ok], a[ok], b[ok], back[ok], k[ok]
            out.append((row, a - start[row], b - a, p.first + k, at[back, q] + a - before[back, q]))
    # The tail: queue after queue; the last window's tokens in powers of two.
    whole = tail_total // SEQUENCE * SEQUENCE
    rest, cuts = tail_total - whole, [*range(0, whole + 1, SEQUENCE)]
    for bit in range(SEQUENCE.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    edges = np.array(cuts, np.int64)
    begin, end = np.maximum(start, tail_from[queue]), start + length
    live = np.flatnonzero(end > begin)
    if len(live):
        a = tail_at[queue[live]] + begin[live] - tail_from[queue[live]]
        b = a + end[live] - begin[live]
        lo, hi = np.searchsorted(edges, a, "right") - 1, np.searchsorted(edges, b, "left") - 1
        n = hi - lo + 1
        who = np.repeat(np.arange(len(live)), n)
        s = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = np.maximum(a[who], edges[s]), np.minimum(b[who], edges[s + 1])
        row = live[who]
        out.append((row, begin[row] - start[row] + x - a[who], y - x, tail_window + s, x - edges[s]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 5


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, mixture: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, source, start, length, ids, doc_tokens, sequence_id, offset): one row for each piece of a document.

    ``mixture`` gives target proportions by source; without it, the proportions of the corpus are kept in every window.
    """
    tokens = materialize(tokenized(docs, tokenizer, end_id), "tokens")
    by_source = tokens.groupBy("task", "source").agg(F.sum("n_tokens").alias("n"))
    totals = by_source.groupBy("source").agg(F.sum("n").alias("n"))
    grand = totals.agg(F.sum("n")).first()[0] or 0
    # At most LEAST_SHARE rows and those of the mixture reach the driver, whatever the number of sources.
    own = F.col("n") * LEAST_SHARE >= grand
    if mixture:
        own |= F.col("source").isin(list(mixture))
    large = sorted((r["source"], int(r["n"])) for r in totals.where(own).collect())
    names = [s for s, _ in large]
    counts = [n for _, n in large] + [grand - sum(n for _, n in large)]
    targets = [float(n) for n in counts] if mixture is None else [mixture.get(s, 0.0) for s in names] + [0.0]
    phases, used, windows = plan(counts, targets)
    left = np.array(counts, np.int64) - used
    tail_at = np.cumsum(left) - left

    queue = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(names)], F.lit(len(names)))
    by_source = by_source.withColumn("queue", queue)
    exclusive = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_source.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    by_task = by_task.withColumn("of_task", F.coalesce(F.sum("n").over(exclusive("queue").orderBy("task")), F.lit(0))).drop("n")
    bases = by_source.withColumn("of_source", F.coalesce(F.sum("n").over(exclusive("queue", "task").orderBy("source")), F.lit(0))).join(by_task, ["queue", "task"])
    bases = bases.select("task", "source", "queue", (F.col("of_task") + F.col("of_source")).alias("base"))
    if by_source.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)  # ids need not move
    placed = tokens.join(bases, ["task", "source"]).select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("at"), "n_tokens", "ids")
    kind = placed.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, start, length, sequence, offset = place(phases, used, tail_at, windows, int(left.sum()), pdf["queue"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64))
            ids = [zstandard.ZstdDecompressor().decompress(b) for b in pdf["ids"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy()[row], "source": pdf["source"].to_numpy()[row], "start": start, "length": length,
                "ids": [ids[r][4 * a : 4 * (a + n)] for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())],
                "doc_tokens": pdf["n_tokens"].to_numpy()[row], "sequence_id": sequence, "offset": offset,
            })

    return placed.mapInPandas(work, f"doc_id {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
