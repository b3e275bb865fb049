"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Random Fourier features ``sqrt(2/D) cos(w x + b)`` approximate a Gaussian kernel over standardized statistics
of the text. Every partition sums its part of the normal equations, the sums are added in two levels, and a
D x D system is solved on the driver. The scores of the rest of the labelled rows are counted in a fixed
grid, and pooling adjacent violators over the grid turns scores into probabilities.

Defined cases: null and empty texts have all-zero statistics and are scored like any text; repeated rows are
scored one by one; labels of one doc_id that disagree count as their mean; without labelled rows of both
classes every score is the share of the one class there is (0.5 without labels); an empty table gives an empty
result; columns besides ``doc_id``, ``text`` and the label are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import keyed, materialize, small_batches
from sparkwell.llm.repeats import scramble

FEATURES = 384
RIDGE = 1e-3
#: Kernel width in standard deviations of a statistic, by the square root of their number.
WIDTH = 1.5
GRID = 512
#: The fit sums at most about this many labelled rows.
MAX_LABELLED = 400_000
#: One labelled row in CALIBRATION is kept from the fit for the calibration.
CALIBRATION = 4
LETTER, UPPER_, DIGIT, SPACE_, SYMBOL, STOP, PIPE, SHOUT = range(8)
_RUN = re.compile(rb"([!?#*$%&|]){2,}")


def _classes() -> np.ndarray:
    kind = np.zeros((256, 8), np.int64)
    for b in range(256):
        c = chr(b)
        kind[b] = [c.isalpha() if b < 128 else True, "A" <= c <= "Z", "0" <= c <= "9", c in " \t\n\x0b\x0c\r", c in "#*$%&<>@^~=_+", c in ".,;:", c == "|", c in "!?"]
    return kind


CLASSES = _classes()
NAMES = (
    "log_words", "log_bytes", "word_length", "letters", "upper", "digits", "spaces", "symbols", "stops", "pipes", "shouts", "other", "runs",
    "distinct_words", "top_word", "adjacent_repeats", "distinct_lines", "line_words", "short_lines", "ended_lines", "compression", "long_words",
)


def statistics(body: bytes) -> list[float]:
    words = body.split()
    n, size = len(words), max(1, len(body))
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ CLASSES
    lines = [x for x in body.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = (counts / size).tolist()
    return [
        float(np.log1p(n)), float(np.log1p(size)), sum(map(len, words)) / n, share[LETTER], share[UPPER_], share[DIGIT], share[SPACE_], share[SYMBOL], share[STOP], share[PIPE], share[SHOUT],
        1 - min(1.0, share[LETTER] + share[DIGIT] + share[SPACE_] + share[STOP]), sum(len(m.group()) for m in _RUN.finditer(body)) / size,
        len(seen) / n, max(seen.values()) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        sum(len(x) < 20 for x in lines) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines), len(zlib.compress(body, 1)) / size, sum(len(w) > 20 for w in words) / n,
    ]


def remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for rows without id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""
    small_batches(docs.sparkSession)
    src = keyed(docs).select("doc_id", "body")
    kind = src.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(b) for b in pdf["body"]]})

    return src.mapInPandas(work, f"doc_id {kind}, x array<double>")


def projection(dims: int, features: int = FEATURES, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.normal(size=(dims, features)) / (width * np.sqrt(dims)), rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / len(b)) * np.cos(z @ w + b), np.ones((len(x), 1))], axis=1)


def isotonic(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing share of positives by grid cell: adjacent violators pooled, empty cells filled in between."""
    blocks: list[list[float]] = []
    for cell in np.flatnonzero(total):
        blocks.append([positive[cell], total[cell], cell, cell])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, t, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + t, blocks[-1][2], last]
    at = [c for blk in blocks for c in (blk[2], blk[3])]
    # A half-count each way keeps the ends off 0 and 1, and pure blocks in the order of their size.
    value = [v for blk in blocks for v in [(blk[0] + 0.5) / (blk[1] + 1)] * 2]
    return np.maximum.accumulate(np.interp(np.arange(len(total)), at, value)) if blocks else np.full(len(total), 0.5)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted): trained on labelled rows that are not held out, applied to all."""
    stats = materialize(measured(docs), "statistics")
    out = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    train = stats.join(known, "doc_id").where(~out)
    n = train.count()
    if n > max_labelled:
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1e6 * max_labelled / n))
    train = materialize(train.select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)).alias("part")), "labelled")
    dims = len(NAMES)
    moments = train.agg(*[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(dims)], F.avg("y")).first()
    if moments[-1] is None or moments[-1] in (0.0, 1.0):
        share = 0.5 if moments[-1] is None else float(moments[-1])
        return stats.select("doc_id", out.alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    mean, scale = np.array(moments[:dims]), np.maximum(np.array(moments[dims : 2 * dims]), 1e-9)
    w, b = projection(dims)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(b) + 1, len(b) + 2))
        for pdf in batches:
            f, y = fourier(np.array(pdf["x"].tolist()), mean, scale, w, b), pdf["y"].to_numpy()
            # Both classes weigh the same, so that the rarer one shapes the score as much.
            weight = np.where(y > 0.5, 0.5 / moments[-1], 0.5 / (1 - moments[-1]))
            total += (f * weight[:, None]).T @ np.c_[f, y]
        yield pd.DataFrame({"part": [int(scramble(np.array([abs(total).sum()]).view(np.uint64))[0] % np.uint64(8))], "sums": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [0], "sums": [sum(np.frombuffer(s) for s in pdf["sums"]).tobytes()]})

    kind = "part int, sums binary"
    sums = train.where("part > 0").select("x", "y").mapInPandas(equations, kind).groupBy("part").applyInPandas(add, kind).groupBy("part").applyInPandas(add, kind)
    total = np.frombuffer(sums.first()["sums"]).reshape(len(b) + 1, -1)
    solved = np.linalg.solve(total[:, :-1] + RIDGE * np.eye(len(b) + 1), total[:, -1])

    def cells(x: pd.Series) -> np.ndarray:
        raw = fourier(np.array(x.tolist()).reshape(-1, dims), mean, scale, w, b) @ solved
        return np.clip((raw + 0.5) / 2 * GRID, 0, GRID - 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cell": cells(pdf["x"]).astype(np.int32), "y": pdf["y"]})

    counted = train.where("part = 0").select("x", "y").mapInPandas(count, "cell int, y double").groupBy("cell").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    positive, size = np.zeros(GRID), np.zeros(GRID)
    for r in counted:  # at most GRID rows
        positive[r["cell"]], size[r["cell"]] = r["p"], r["n"]
    curve = isotonic(positive, size)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = cells(pdf["x"])
            score = np.clip(np.interp(at, np.arange(GRID) + 0.5, curve), 0.0, 1.0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.withColumn("held_out", out).mapInPandas(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")
