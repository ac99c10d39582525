"""Quality: random Fourier features over document statistics, ridge scores, isotonic calibration.

A document is a vector of statistics of its whole text. Standardised, it is
mapped to cosines of random projections, whose products approximate a Gaussian
kernel. Each partition of the labelled rows sums its normal equations, for two
folds apart; the sums meet in a tree and only they reach the driver. Ridge
scores of each fold by the other's weights are counted in a fixed number of
bins, and pool-adjacent-violators turns them to probabilities.

Defined cases: a null or empty text has the statistics of an empty text and a
score like any other; labels of null quality or unknown documents are ignored,
and one that is given more than once counts each time; without labels of both
kinds every score is the share of label 1, or 0.5 without labels. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

STATISTICS = (
    "log_bytes", "log_words", "word_mean", "word_spread", "upper", "digits", "marks", "spaces", "beyond_ascii", "distinct_words",
    "commonest_word", "repeated_neighbours", "repeated_lines", "line_length", "capital_words", "short_words", "entropy", "packed", "commonest_mark", "words_with_marks",
)
FEATURES, WIDTH, RIDGE, BINS, SEED = 256, 4.0, 1e-3, 4096, 7
#: Rows of partial sums that meet at once on their way to the driver.
MEETINGS = 16

_UPPER, _DIGIT, _SPACE, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_SPACE[[32, *range(9, 14)]] = True
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False


def statistics(text: bytes) -> list[float]:
    """The numbers of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    of = Counter(words)
    p = counts[counts > 0] / n
    marks = counts[_MARK]
    total_marks = int(marks.sum())
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()),
        counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, total_marks / n, counts[_SPACE].sum() / n, counts[128:].sum() / n, len(of) / w,
        (max(of.values()) if of else 0) / w, sum(a == b for a, b in zip(words, words[1:])) / w, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        sum(x[:1].isupper() for x in words) / w, float((lengths <= 3).mean()), float(-(p * np.log2(p)).sum()), len(zlib.compress(text, 1)) / n,
        float(marks.max()) / w, sum(not x.isalnum() and x.isascii() for x in words) / w,
    ]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t or b"") for t in b["text"].cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "statistics"])


@dataclass(frozen=True)
class FourierMap:
    mean: np.ndarray
    spread: np.ndarray
    seed: int = SEED

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Features of standardised rows, and a constant."""
        rng = np.random.default_rng(self.seed)
        d = len(self.mean)
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        directions = rng.normal(size=(d, FEATURES)) / WIDTH
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + shift), np.ones((len(x), 1))])


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(STATISTICS))


def _sums(mapped: FourierMap):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total = np.zeros((2, size, size + 1))
        for b in batches:
            x, y, fold = mapped(_rows(b["statistics"])), b["quality"].to_numpy(), b["fold"].to_numpy()
            for f in (0, 1):
                a = x[fold == f]
                total[f] += a.T @ np.column_stack([a, y[fold == f]])
        if total.any():
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    return sums


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in table["sums"])
    return pa.table({"sums": [total.tobytes()]})


def _binned(model_of_fold: list[np.ndarray], mapped: FourierMap):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, fold = mapped(_rows(b["statistics"])), b["fold"].to_numpy()
            score = np.where(fold == 0, x @ model_of_fold[1], x @ model_of_fold[0])
            yield pa.RecordBatch.from_arrays([pa.array(bin_of(score)), b["quality"]], ["bin", "quality"])

    return count


def bin_of(score: np.ndarray) -> np.ndarray:
    return np.clip((score + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending places and non-falling rates."""
    blocks: list[list[float]] = []
    for a, o, k in zip(at, ones, n):
        blocks.append([a * k, o, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass(frozen=True)
class QualityModel:
    mapped: FourierMap | None
    weights: np.ndarray
    places: np.ndarray
    rates: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mapped is None:
            return np.full(len(x), self.prior)
        raw = self.mapped(x) @ self.weights
        # A thousandth of the raw score keeps the order within a level.
        return 0.999 * np.interp(raw, self.places, self.rates) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)


def fit_quality(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """From stats (doc_id, statistics), stored, and labels (doc_id, quality)."""
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("quality"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    rows = materialize(stats.join(known, "doc_id").select("statistics", "quality", fold.alias("fold")), "quality-rows")
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("quality")).first()
    if not n or ones in (0, n):
        return QualityModel(None, np.zeros(0), np.zeros(0), np.zeros(0), ones / n if n else 0.5)
    at = [F.col("statistics")[i] for i in range(len(STATISTICS))]
    moments = np.array(rows.agg(*map(F.avg, at), *map(F.stddev_pop, at)).first()).reshape(2, -1)
    mapped = FourierMap(moments[0], np.where(moments[1] > 1e-9, moments[1], 1.0))
    sums = rows.mapInArrow(_sums(mapped), "sums binary").withColumn("meeting", F.pmod(F.spark_partition_id(), F.lit(MEETINGS)))
    met = sums.groupBy("meeting").applyInArrow(_add, "sums binary").collect()  # at most MEETINGS rows
    folds = sum(np.frombuffer(r["sums"]) for r in met).reshape(2, FEATURES + 1, FEATURES + 2)

    def solve(s: np.ndarray) -> np.ndarray:
        count = max(1.0, s[-1, -2])
        return np.linalg.solve(s[:, :-1] + RIDGE * count * np.eye(len(s)) / FEATURES + 1e-9 * np.eye(len(s)), s[:, -1])

    counted = rows.mapInArrow(_binned([solve(f) for f in folds], mapped), "bin long, quality double")
    bins = sorted(counted.groupBy("bin").agg(F.sum("quality"), F.count(F.lit(1))).collect())  # at most BINS rows
    b = np.array(bins, float)
    places, rates = isotonic((b[:, 0] + 0.5) / BINS * 2 - 0.5, b[:, 1], b[:, 2])
    return QualityModel(mapped, solve(folds.sum(axis=0)), places, rates, ones / n)


def _score(model: QualityModel):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(model.scores(_rows(b["statistics"])))], ["doc_id", "score"])

    return score


def document_statistics(docs: DataFrame) -> DataFrame:
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(table.mapInArrow(_read, "doc_id long, statistics array<double>"), "statistics")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted; labels of held-out documents are not learned from."""
    stats = document_statistics(docs)
    model = fit_quality(stats, labels.where(~held_out()))
    scored = stats.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
