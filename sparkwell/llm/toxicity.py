"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks, trained on labelled sentences.

The kernel of two words sums, over all subsequences of 3 and 4 letters (word start and end count as letters),
the products of their weights; a subsequence weighs DECAY for each letter it skips, up to MAX_GAP. So a
word with inserted or missing letters stays close to its plain form. Letters between marks (``i.d.i.o.t``),
runs of single letters (``i d i o t``) and digits that stand for letters are read as one word first. The kernel of two
sentences is the sum of the kernels of their words.

Training reads whole labelled texts that are not held out: at most about ``fit_bytes`` of each class, taken by a hash of the
id, cut into sentences (at line ends and after . ! ?). A label is that of a text, so a toxic text is a bag of sentences of which one at
least is toxic: the machine is trained with all of them as toxic, lightly, and then again with the one that it finds most
toxic in each text, a few times; all sentences of clean texts are clean. Landmarks are the words that tell the classes
apart best and the most frequent ones. Nyström features ``K(w, L) K(L, L)^-1/2``, summed over a sentence, feed a linear SVM
(squared hinge, Newton steps).

An inner product with landmark features is linear in a word's subsequences, so the fitted machine folds into one
weight per subsequence; scoring a word is a sum of table look-ups, exactly the kernel expansion. A text's margin
is that of its most toxic sentence, and an isotonic curve counted on labelled rows kept from the fit makes it a probability.

Defined cases: null and empty texts have the lowest margin; repeated rows are scored one by one; labels of one
doc_id that disagree count as toxic if any does; without labelled rows of both classes every score is the share of
the one class there is (0 without labels); texts over ``LONGEST_FIT`` bytes are scored whole but not fitted on; an empty table
gives an empty result; columns besides ``doc_id``, ``text`` and the label are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import keyed, materialize, small_batches
from sparkwell.llm.quality_classifier import isotonic

ORDERS = (3, 4)
MAX_GAP = 2
DECAY = 0.5
BASE = 1 << 6
#: Bits of a code of four letters, above which its order stands.
SHIFT = 24
#: Rows of features that the fit reads at once.
BLOCK = 2048
#: Longest piece of a word that is read at once; longer words are read in overlapping pieces.
LONGEST = 24
LANDMARKS = 480
#: Bytes of labelled text of each class that the fit reads; the driver holds them and their sentences' features.
FIT_BYTES = 2 << 20
LONGEST_FIT = 1 << 20
#: One labelled row in CALIBRATION is kept from the fit; the curve counts these rows.
CALIBRATION = 4
#: Times that the most toxic sentence of each toxic text is chosen anew.
ROUNDS = 3
#: The calibration reads at most about this many labelled rows, so that their labels (a few MB) can be sent to the texts.
MAX_LABELLED = 200_000
PENALTY = 3.0
#: A sentence's features are divided by this power of its number of words.
POWER = 0.25
#: Words that a task remembers.
CACHE_WORDS = 200_000
#: Margins are counted for the isotonic curve in cells of this width from -LIMIT to LIMIT.
CELL, LIMIT = 0.05, 5.0
LEET = str.maketrans("013457@$", "oieastas")
EDGE_MARKS = re.compile(r"^[^\w@$]+|[^\w@$]+$")
INNER_MARKS = re.compile(r"[\W_]+")
#: Stands for a line end among the words.
LINE = b"\x1e"


def normal_word(raw: bytes) -> str:
    """A word as the kernel reads it; empty without letters."""
    bare = raw.rstrip(b".,;:!?")
    if bare.isalpha():  # ASCII letters: nothing to undo
        return bare.lower().decode()
    text = EDGE_MARKS.sub("", raw.decode("utf-8", "replace").lower())
    return INNER_MARKS.sub("", text.translate(LEET)) if any(c.isalpha() for c in text) else ""


class Sentences:
    """The sentences of a batch of texts: for each, its text and the words in it."""

    def __init__(self, bodies: list[bytes], known: dict[bytes, str]):
        split = pc.ascii_split_whitespace(pa.array([b.replace(b"\n", b" " + LINE + b" ") for b in bodies], pa.large_binary()).cast(pa.large_string(), safe=False))
        coded = split.values.dictionary_encode()
        raw = coded.dictionary.cast(pa.large_binary()).to_pylist()
        normal = [known[r] if r in known else normal_word(r) for r in raw]
        if len(known) < CACHE_WORDS:
            known.update(zip(raw, normal))
        codes = coded.indices.to_numpy()
        place: dict[str, int] = {}
        spelled = np.array([place.setdefault(w, len(place)) for w in normal], np.int64)
        word = spelled[codes]
        names = list(place)
        size = np.fromiter(map(len, names), np.int64, len(names))
        sizes = np.diff(split.offsets.to_numpy())
        text = np.repeat(np.arange(len(bodies)), sizes)
        stop = np.array([r == LINE or r[-1:] in (b".", b"!", b"?") for r in raw], bool)[codes]
        new = np.ones(len(codes), bool)
        new[1:] = stop[:-1] | (text[1:] != text[:-1])
        sentence = np.cumsum(new) - 1
        self.text = text[new]
        # Three single letters or more in a row are one word.
        single = size[word] == 1
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        spelt = [(a, "".join(names[i] for i in word[a:b])) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 3]
        plain = size[word] > 1
        self.word = np.r_[word[plain], np.array([place.setdefault(w, len(place)) for _, w in spelt], np.int64)]
        self.sentence = np.r_[sentence[plain], sentence[np.array([a for a, _ in spelt], np.int64)]]
        self.words = list(place)

    def margins(self, value: np.ndarray, bias: float, texts: int) -> np.ndarray:
        """The largest margin of each text's sentences, from the words' values."""
        n = len(self.text)
        total, count = np.bincount(self.sentence, value[self.word], n), np.bincount(self.sentence, minlength=n)
        out = np.full(texts, -LIMIT)
        np.maximum.at(out, self.text, np.where(count > 0, bias + total / count.clip(1) ** POWER, -LIMIT))
        return out


def letters(word: str) -> list[int]:
    return [47, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 20 for c in word), 47]


def pieces(word: str) -> list[list[int]]:
    codes = letters(word)
    return [codes[i : i + LONGEST] for i in range(0, max(1, len(codes) - LONGEST // 2), LONGEST // 2)] if len(codes) > LONGEST else [codes]


def _choices(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: positions of all subsequences of a word of n letters, and their weights."""
    if n not in CHOICES:
        CHOICES[n] = []
        for p in ORDERS:
            at = [(i, *rest) for i in range(n) for rest in combinations(range(i + 1, min(n, i + p + MAX_GAP)), p - 1)]
            at = np.array(at, np.int64).reshape(-1, p)
            CHOICES[n].append((at, DECAY ** (at[:, -1] - at[:, 0] - p + 1.0) if len(at) else np.empty(0)))
    return CHOICES[n]


CHOICES: dict[int, list] = {}


def subsequences(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words of one length [words, letters]: subsequence codes [words, m] and their weights [m], scaled to length 1."""
    out, norm = [], 0.0
    for at, weight in _choices(codes.shape[1]):
        index = np.zeros((len(codes), len(at)), np.int64)
        for j in range(at.shape[1]):
            index = index * BASE + codes[:, at[:, j]]
        out.append((index, weight))
        norm += (weight**2).sum()
    return [(i, w / np.sqrt(max(norm, 1e-12))) for i, w in out]


def explicit(word: str) -> tuple[np.ndarray, np.ndarray]:
    """A word in the kernel's feature space: codes of its subsequences, with their order, and their weights; of all its pieces."""
    own = pieces(word)
    parts = [(p, index[0], weight) for piece in own for p, (index, weight) in zip(ORDERS, subsequences(np.array([piece], np.int64)))]
    return np.concatenate([index | (p << SHIFT) for p, index, _ in parts]), np.concatenate([weight for _, _, weight in parts]) / np.sqrt(len(own))


class Landmarks:
    """Some words' subsequences as the columns of one table."""

    def __init__(self, words: list[str]):
        feats = [explicit(w) for w in words]
        self.codes = np.unique(np.concatenate([f[0] for f in feats]))
        self.table = np.zeros((len(self.codes), len(words)), np.float32)
        for j, (code, x) in enumerate(feats):
            np.add.at(self.table[:, j], np.searchsorted(self.codes, code), x)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Inner products of words with the landmarks in feature space, by way of the subsequences that these have."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for i, w in enumerate(words):
            code, x = explicit(w)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = self.codes[at] == code
            out[i] = x[known].astype(np.float32) @ self.table[at[known]]
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, penalty: float, steps: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Linear SVM with squared hinge loss on some rows of x, by Newton steps summed over blocks of rows; y is -1 or 1; the last coefficient is the bias."""
    beta = np.zeros(x.shape[1] + 1) if start is None else start
    ridge = np.diag(np.r_[np.ones(x.shape[1]), 1e-6])
    for _ in range(steps):
        left, right = ridge.copy(), np.zeros(len(beta))
        for at in range(0, len(rows), BLOCK):
            part = rows[at : at + BLOCK]
            part = part[y[part] * (x[part] @ beta[:-1].astype(np.float32) + beta[-1]) < 1]
            xb = np.c_[x[part].astype(float), np.ones(len(part))]
            xs = xb * weight[part, None]
            left += penalty * xs.T @ xb
            right += penalty * xs.T @ y[part]
        new = np.linalg.solve(left, right)
        if np.abs(new - beta).max() < 1e-5:
            break
        beta = new
    return beta


def chosen(words: np.ndarray, toxic: np.ndarray, clean: np.ndarray, totals: tuple[int, int], value: np.ndarray | None) -> list[str]:
    """Landmarks: words that tell the classes apart, by the texts that hold them, ``toxic`` and ``clean``; frequent ones; and, by
    their ``value`` in an earlier fit, those of clean texts that were taken for toxic."""
    odds = np.log((toxic + 0.5) / (totals[0] + 1)) - np.log((clean + 0.5) / (totals[1] + 1))
    name = words.astype(str)
    out = np.lexsort((name, -toxic * np.maximum(odds, 0)))[: LANDMARKS // 3].tolist()
    for order in (-(toxic + clean), None if value is None else np.where(odds < 0, -value, np.inf)):
        if order is not None:
            rank = np.lexsort((name, order))
            out += rank[~np.isin(rank, out)][: LANDMARKS // 3].tolist()
    return [words[i] for i in out]


def _most_toxic(x: np.ndarray, y: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The machine's coefficients: first from all sentences, then from those of clean texts and the most toxic one of each toxic text."""
    live, beta = np.ones(len(y), bool), None
    for _ in range(ROUNDS + 1):
        # A toxic text's sentences share its weight; those of clean texts count one each.
        weight = np.where(y > 0, 1 / np.bincount(text[live], minlength=texts)[text].clip(1), 1.0)
        weight[y > 0] *= 1000 / weight[live & (y > 0)].sum()
        weight[y < 0] *= 1000 / weight[y < 0].sum()
        beta = svm(x, y, weight, np.flatnonzero(live), PENALTY, start=beta)
        rank = np.lexsort((-(x @ beta[:-1].astype(np.float32)), text))
        live = y < 0
        live[rank[np.r_[True, text[rank][1:] != text[rank][:-1]]]] = True
    return beta


def fit(toxic: list[bytes], clean: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], float] | None:
    """The sparse weights by subsequence for each order, and a bias, from toxic and clean texts."""
    read = Sentences(toxic + clean, {})
    y_text = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    holds = np.unique(read.text[read.sentence] * np.int64(len(read.words)) + read.word)
    of = y_text[holds // max(len(read.words), 1)] > 0
    by_class = [np.bincount(holds[m] % max(len(read.words), 1), minlength=len(read.words)) for m in (of, ~of)]
    used = np.flatnonzero(by_class[0] + by_class[1])
    if not len(used) or not toxic or not clean:
        return None
    place = np.zeros(len(read.words), np.int64)
    place[used] = np.arange(len(used))
    order = np.argsort(read.sentence, kind="stable")
    word, (sentence, begin) = place[read.word[order]], np.unique(read.sentence[order], return_index=True)
    ends = np.r_[begin[1:], len(word)]
    text = read.text[sentence]
    y = y_text[text]
    named, value = np.array(read.words, object), None
    for _ in range(2):
        marks = chosen(named[used], by_class[0][used], by_class[1][used], (len(toxic), len(clean)), value)
        landmarks = Landmarks(marks)
        values, vectors = np.linalg.eigh(landmarks.kernel(marks).astype(float))
        good = values > 1e-6
        white = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        z = np.empty((len(used), white.shape[1]), np.float16)  # of vectors no longer than 1
        for at in range(0, len(used), BLOCK):
            z[at : at + BLOCK] = landmarks.kernel(list(named[used[at : at + BLOCK]])) @ white
        x = np.empty((len(sentence), white.shape[1]), np.float32)
        for at in range(0, len(sentence), BLOCK):
            a, b = begin[at], ends[min(at + BLOCK, len(sentence)) - 1]
            x[at : at + BLOCK] = np.add.reduceat(z[word[a:b]].astype(np.float32), begin[at : at + BLOCK] - a)
        x /= ((ends - begin)[:, None] ** POWER).astype(np.float32)
        beta = _most_toxic(x, y, text, len(y_text))
        value = np.concatenate([z[at : at + BLOCK].astype(np.float32) @ beta[:-1].astype(np.float32) for at in range(0, len(z), BLOCK)])
        del x, z
    folded = landmarks.table @ (white @ beta[:-1].astype(np.float32))
    level = landmarks.codes >> SHIFT
    return [(landmarks.codes[level == p] & ((1 << SHIFT) - 1), folded[level == p]) for p in ORDERS], float(beta[-1])


class Scorer:
    """Margins of texts; the values of words are remembered within a task."""

    def __init__(self, sparse: list[tuple[np.ndarray, np.ndarray]], bias: float):
        self.tables = [np.zeros(BASE**p, np.float32) for p in ORDERS]
        for t, (at, value) in zip(self.tables, sparse):
            t[at] = value
        self.bias = bias
        self.known: dict[str, float] = {}
        self.spelled: dict[bytes, str] = {}

    def values(self, words: list[str]) -> np.ndarray:
        """What each word adds to its sentence's margin."""
        owner, codes = [], []
        for i, w in enumerate(words):
            for piece in pieces(w):
                owner.append(i)
                codes.append(piece)
        size, who = np.array([len(c) for c in codes]), np.array(owner)
        out = np.zeros(len(words))
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                value = np.zeros(len(part))
                for t, (index, weight) in zip(self.tables, subsequences(np.array([codes[i] for i in part], np.int64))):
                    value += t[index] @ weight
                np.add.at(out, who[part], value)
        return out / np.sqrt(np.bincount(who, minlength=len(words)))

    def texts(self, bodies: list[bytes]) -> np.ndarray:
        read = Sentences(bodies, self.spelled)
        need = np.zeros(len(read.words), bool)
        need[read.word] = True
        value = np.zeros(len(read.words))
        found = [self.known.get(w) if n else 0.0 for w, n in zip(read.words, need)]
        new = [i for i, v in enumerate(found) if v is None]
        if new:
            values = self.values([read.words[i] for i in new]).tolist()
            if len(self.known) < CACHE_WORDS:
                self.known.update((read.words[i], v) for i, v in zip(new, values))
            for i, v in zip(new, values):
                found[i] = v
        value[:] = found
        return read.margins(value, self.bias, len(bodies))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: Column | None = None, max_labelled: int = MAX_LABELLED, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted, margin): trained on labelled rows that are not held out, applied to all."""
    small_batches(docs.sparkSession)
    out = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).alias("y"))
    n = known.count()
    if n > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1e6 * max_labelled / n))
    known = F.broadcast(known)
    src = keyed(docs).select("doc_id", "body").withColumn("held_out", out)
    kind = src.schema["doc_id"].dataType.simpleString()
    kept = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(CALIBRATION)) == 0
    train = src.where(~F.col("held_out")).join(known, "doc_id").select("doc_id", "body", "y")
    share = train.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    fitting = train.where(~kept & (F.octet_length("body") <= LONGEST_FIT))
    size = {r["y"]: r["size"] or 1 for r in fitting.groupBy("y").agg(F.sum(F.octet_length("body")).alias("size")).collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit("text")), F.lit(1_000_000))
    rows = fitting.where(F.when(F.col("y"), part < int(1e6 * fit_bytes / size.get(True, 1))).otherwise(part < int(1e6 * fit_bytes / size.get(False, 1))))
    texts = rows.select("doc_id", "body", "y").orderBy("doc_id", "body").toArrow()  # about 2 * fit_bytes
    bodies, y = texts["body"].to_pylist(), texts["y"].to_pylist()
    fitted = fit([b for b, t in zip(bodies, y) if t], [b for b, t in zip(bodies, y) if not t])
    if fitted is None:
        return src.select("doc_id", "held_out", F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"), F.lit(-LIMIT).alias("margin"))
    machine = docs.sparkSession.sparkContext.broadcast(fitted)  # at most LANDMARKS words' subsequences

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*machine.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "margin": scorer.texts(list(pdf["body"]))})

    marked = materialize(src.mapInPandas(margins, f"doc_id {kind}, held_out boolean, margin double"), "margins")
    cells = int(2 * LIMIT / CELL)
    cell = F.least(F.greatest(F.floor((F.col("margin") + LIMIT) / CELL), F.lit(0)), F.lit(cells - 1)).cast("int")
    positive, size = np.zeros(cells), np.zeros(cells)
    counted = marked.where(~F.col("held_out")).join(known, "doc_id")
    by_cell = lambda df: df.groupBy(cell.alias("cell")).agg(F.sum(F.col("y").cast("double")).alias("p"), F.count("*").alias("n")).collect()
    rows = by_cell(counted.where(kept))
    if not 0 < sum(r["p"] for r in rows) < sum(r["n"] for r in rows):
        rows = by_cell(counted)  # too few rows to keep any from the fit
    for r in rows:
        positive[r["cell"]], size[r["cell"]] = r["p"], r["n"]
    curve = isotonic(positive, size)
    # Inside a cell the margin still orders texts, by less than any step of the curve that matters.
    slope = F.lit(1e-6) * (F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("margin"))) / LIMIT)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(F.array(*[F.lit(float(v)) for v in curve]), cell) + slope))
    return marked.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "margin")
