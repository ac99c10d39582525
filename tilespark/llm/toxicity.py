"""Toxicity: a cumulative-link ordinal regression over sparse text features.

Features are hashes of a text's words and of their beginnings, so that inflected
forms share weight; a word is a run of letters, digits and bytes above 127, in
lower case for ASCII. Runs beyond LONG_RUN bytes, such as sentences of scripts
without spaces, are also read as overlapping windows of characters. On a bounded
sample of labelled rows, features are chosen by how they tell toxic texts from
others (near copies in the sample count once): by being there at all or, where
that parts them better, by being repeated, as words are that clean texts hold now
and then; such a feature counts from its second occurrence.

Labels say only whether a text is toxic. The grade of a toxic text of the sample,
1 to 3, is the third it falls in by a binary regression that was fitted on the
other half of the sample and has seen neither the text nor its label; all others
have grade 0. One weight vector w serves all thresholds: P(grade >= k) = logistic(w.x - t_k),
with t_1 < t_2 < t_3. A text's severity is its expected grade, the sum of the
three; it is rejected where P(grade >= 1) is one half or more.

Defined cases: a null or empty text has no features; labels of null toxic or
unknown documents are ignored; of a document that is labelled more than once the
highest label counts, and of rows that share a doc_id the least text is learned
from; if the labels do not hold both kinds, severity is 0 and nothing is
rejected. A run of letters beyond SEGMENT bytes counts as several. An empty table
gives an empty result. Other columns are ignored by `score_toxicity` and passed
through by `reject_toxic`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows for fitting at most, of either kind, by the hash of their doc_id.
TOXIC_ROWS, OTHER_ROWS = 4000, 8000
#: Features whose counts are compared, and those that get a weight.
CANDIDATES, FEATURES = 1 << 16, 1024
#: A feature counts if so many toxic texts of the sample have it, and this share of them.
LEAST_TEXTS, LEAST_SHARE = 3, 0.004
#: Added to twice the logarithm of the number of candidates: the least likelihood ratio statistic of a feature.
EVIDENCE = 4.0
#: So many times as large a share of toxic texts has the feature, or repeats it, at least.
LIFT = 8.0
#: A feature is judged by the texts that hold it at least once, and by those that hold it at least so often.
REPEATS = 2
GRADES = 3
#: Bytes of the beginnings of words.
STEMS = (4, 5, 6, 7)
#: Runs of more bytes also count by all windows of so many bytes that begin with a character.
LONG_RUN, WINDOWS = 24, (6, 9)
#: Bytes that are read at once, about, and the longest run.
SEGMENT = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[48:58] = _LETTER[97:123] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = 0xD6E8FEB86659FD93
#: Powers of an odd factor, and of its inverse: what moves a hash from its place in a run to the run's beginning.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_CODES = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if n > len(_POWERS[0]):
        for k, factor in enumerate((_FACTOR, pow(_FACTOR, -1, 1 << 64))):
            steps = np.full(2 * n, factor, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def features(text: bytes) -> np.ndarray:
    """The hashed features of a text, with repeats."""
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + SEGMENT)
        while end < len(text) and end < at + 2 * SEGMENT and _LETTER[_LOWER[text[end]]]:
            end += 1
        chars = _LOWER[np.frombuffer(text, np.uint8, end - at, at)]
        at = end
        inside = _LETTER[chars]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(starts):
            continue
        lengths = ends - starts
        place = np.arange(starts[0], len(chars)) - np.repeat(starts, np.diff(starts, append=len(chars)))
        longest = int(lengths.max())
        forth, back = _powers(longest)
        values = np.where(inside[starts[0] :], _CODES[chars[starts[0] :]] * forth[np.minimum(place, longest - 1)], np.uint64(0))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        begin = starts - starts[0]
        found.append(_mixed(upto[begin + lengths] - upto[begin] + lengths.astype(np.uint64) * _ODD))
        for stem in STEMS:
            long = begin[lengths >= stem]
            found.append(_mixed((upto[long + stem] - upto[long]) ^ np.uint64(stem << 56)))
        if longest > LONG_RUN:
            left = np.repeat(lengths, np.diff(starts, append=len(chars)))
            head = inside[starts[0] :] & (left > LONG_RUN) & (chars[starts[0] :] & 0xC0 != 0x80)
            for width in WINDOWS:
                first = np.flatnonzero(head & (place + width <= left))
                found.append(_mixed((upto[first + width] - upto[first]) * back[place[first]] ^ np.uint64(width << 56)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class ToxicityModel:
    """`keys`: ascending feature hashes; `free` (occurrences that do not count) and `weights` beside them; `thresholds`: ascending, one per grade. No keys: no model."""

    keys: np.ndarray
    free: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        if not len(self.keys):
            return np.zeros(GRADES)
        return _logistic(vector(features((text or "").encode()), self.keys, self.free) @ self.weights - self.thresholds)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def counts_of(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.bincount(at[keys[at] == found], minlength=len(keys))


def vector(found: np.ndarray, keys: np.ndarray, free: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(counts_of(found, keys) - free, 0))


@dataclass(frozen=True)
class Sparse:
    """A matrix by its entries."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        rows, columns = np.nonzero(dense)
        return cls(rows, columns, dense[rows, columns], dense.shape)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * g[self.rows], self.shape[1])

    def only(self, rows: np.ndarray) -> Sparse:
        """The rows of a mask."""
        keep = rows[self.rows]
        return Sparse((np.cumsum(rows) - 1)[self.rows[keep]], self.columns[keep], self.values[keep], (int(rows.sum()), self.shape[1]))


def fit_ordinal(x: Sparse, grades: np.ndarray, n_grades: int = GRADES, ridge: float = 1e-5, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model by Adam on the penalised likelihood; grades 0 to n_grades."""
    n, d = x.shape
    # t_1, then the logarithms of the steps between thresholds.
    p = np.zeros(d + n_grades)
    p[d] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for k in range(1, rounds + 1):
        steps = np.exp(p[d + 1 :])
        t = np.concatenate([[p[d]], p[d] + np.cumsum(steps)])
        # Probabilities of grades at or above 0 .. n_grades + 1.
        up = np.ones((n, n_grades + 2))
        up[:, 1 : n_grades + 1] = _logistic(x.times(p[:d])[:, None] - t)
        up[:, n_grades + 1] = 0
        hi, lo = up[rows, grades], up[rows, grades + 1]
        own = np.maximum(hi - lo, 1e-12)
        slope = up * (1 - up)
        d_hi, d_lo = slope[rows, grades] / own / n, slope[rows, grades + 1] / own / n
        g_t = (np.bincount(grades, d_hi, n_grades + 2) - np.bincount(grades + 1, d_lo, n_grades + 2))[1 : n_grades + 1]
        tail = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([x.turned_times(d_lo - d_hi) + ridge * p[:d], [tail[0]], tail[1:] * steps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return p[:d], np.concatenate([[p[d]], p[d] + np.cumsum(np.exp(p[d + 1 :]))])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three minima over a text's features, equal for near copies almost always."""
    salts = _mixed(np.arange(1, 4, dtype=np.uint64) * _ODD)
    for b in batches:
        found = [features(t or b"") for t in b["text"].cast(pa.binary()).to_pylist()]
        minima = [[int(_mixed(f ^ x).min(initial=2**64 - 1)) >> 1 for x in salts] for f in found]
        yield b.append_column("sketch", pa.array(minima, pa.list_(pa.int64())))


def _toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, repeated) of the texts of this partition: in how many texts each feature is, and is repeated."""
    for b in batches:
        found = [np.unique(features(t or b""), return_counts=True) for t in b["text"].cast(pa.binary()).to_pylist()]
        every = np.concatenate([f for f, _ in found]) if found else np.zeros(0, np.uint64)
        often = np.concatenate([c for _, c in found]) >= REPEATS if found else np.zeros(0, bool)
        keys, place, n = np.unique(every, return_inverse=True, return_counts=True)
        repeated = np.bincount(place[often], minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(repeated.astype(np.int64))], ["feature", "n", "repeated"])


def _others_with(keys: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, repeated = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for b in batches:
            for t in b["text"].cast(pa.binary()).to_pylist():
                c = counts_of(features(t or b""), keys)
                total += c > 0
                repeated += c >= REPEATS
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some]), pa.array(repeated[some])], ["feature", "n", "repeated"])

    return count


def _rows_of(keys: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, counts = [], []
            for t in b["text"].cast(pa.binary()).to_pylist():
                c = counts_of(features(t or b""), keys)
                some = np.flatnonzero(c)
                columns.append(some)
                counts.append(c[some])
            arrays = [b["doc_id"], b["toxic"], pa.array(columns, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "columns", "counts"])

    return rows


def half_of(doc_id: int) -> int:
    """Which half of the sample a document is in."""
    return zlib.crc32(str(doc_id).encode()) & 1


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """From docs (doc_id, text) and labels (doc_id, toxic)."""
    nothing = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.arange(GRADES, dtype=float))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*by_hash).limit(TOXIC_ROWS).union(known.where("toxic = 0").orderBy(*by_hash).limit(OTHER_ROWS))
    # At most TOXIC_ROWS + OTHER_ROWS rows of two numbers are broadcast; of rows that share a doc_id one is taken.
    sample = texts.join(F.broadcast(materialize(picked, "toxic-picked")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # Copies of one text would make each of its words look telling, so they count once.
    sample = sample.mapInArrow(_sketches, "doc_id long, toxic int, text string, sketch array<long>")
    sample = sample.groupBy("toxic", "sketch").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"))
    sample = materialize(sample.select("doc_id", "toxic", "text"), "toxic-sample")
    toxic, other = sample.where("toxic = 1"), sample.where("toxic = 0")
    n_toxic, n_other = toxic.count(), other.count()
    if not n_toxic or not n_other:
        return nothing
    least = max(LEAST_TEXTS, LEAST_SHARE * n_toxic)
    counted = [F.sum("n").alias("n"), F.sum("repeated").alias("repeated")]
    schema = "feature long, n long, repeated long"
    common = toxic.mapInArrow(_toxic_features, schema).groupBy("feature").agg(*counted).where(F.col("n") >= least)
    found = common.orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()
    if not found:
        return nothing
    keys = np.array([r["feature"] for r in found], np.int64).view(np.uint64)
    # Texts that have the feature, and texts that repeat it.
    in_toxic = np.array([[r["n"], r["repeated"]] for r in found], float).T
    order = np.argsort(keys)
    keys, in_toxic = keys[order], in_toxic[:, order]
    in_other = np.zeros((2, len(keys)))
    for r in other.mapInArrow(_others_with(keys), schema).groupBy("feature").agg(*counted).collect():  # at most CANDIDATES rows
        in_other[:, np.searchsorted(keys, np.uint64(r["feature"] & (2**64 - 1)))] = r["n"], r["repeated"]
    # The likelihood ratio statistic of feature and kind, either way.
    cells = np.array([[in_toxic, n_toxic - in_toxic], [in_other, n_other - in_other]])
    expected = cells.sum(axis=1, keepdims=True) * cells.sum(axis=0, keepdims=True) / (n_toxic + n_other)
    weight = 2 * np.where(cells > 0, cells * np.log(np.maximum(cells, 1e-9) / np.maximum(expected, 1e-9)), 0).sum(axis=(0, 1))
    lift = (in_toxic / n_toxic) / ((in_other + 0.5) / (n_other + 1))
    # What chance alone gives the best of so many features is left out.
    weight[(weight < 2 * np.log(weight.size) + EVIDENCE) | (lift < LIFT) | (in_toxic < least)] = 0
    free = weight.argmax(axis=0) * (REPEATS - 1)
    weight = weight.max(axis=0)
    best = np.argsort(-weight, kind="stable")[:FEATURES]
    best = np.sort(best[weight[best] > 0])
    if not len(best):
        return nothing
    keys, free = keys[best], free[best]
    rows = sample.mapInArrow(_rows_of(keys), "doc_id long, toxic int, columns array<long>, counts array<long>").orderBy("doc_id").collect()  # the bounded sample
    size = [len(r["columns"]) for r in rows]
    columns = np.fromiter((c for r in rows for c in r["columns"]), np.int64, sum(size))
    counts = np.fromiter((c for r in rows for c in r["counts"]), np.int64, sum(size))
    x = Sparse(np.repeat(np.arange(len(rows)), size), columns, np.log1p(np.maximum(counts - free[columns], 0)), (len(rows), len(keys)))
    kind, half = np.array([r["toxic"] for r in rows]), np.array([half_of(r["doc_id"]) for r in rows])
    # How strongly each half's model, which has not seen the text or its label, takes a text for toxic.
    evidence = np.zeros(len(rows))
    for h in (0, 1):
        weights, _ = fit_ordinal(x.only(half != h), kind[half != h], 1)
        evidence[half == h] = x.only(half == h).times(weights)
    bounds = np.quantile(evidence[kind == 1], np.arange(1, GRADES) / GRADES)
    grades = np.where(kind == 1, 1 + np.searchsorted(bounds, evidence, "right"), 0)
    return ToxicityModel(keys, free, *fit_ordinal(x, grades))


def toxicity(model: ToxicityModel, text: str = "text") -> Column:
    """A struct column (p_toxic, severity)."""

    @F.pandas_udf("p_toxic double, severity double")
    def scores(texts: pd.Series) -> pd.DataFrame:
        p = np.array([model.probabilities(t) for t in texts]).reshape(-1, GRADES)
        return pd.DataFrame({"p_toxic": p[:, 0], "severity": p.sum(axis=1)})

    return scores(F.col(text).cast("string"))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """A row per document: doc_id, severity, p_toxic, rejected."""
    scored = docs.select("doc_id", toxicity(model).alias("s"))
    return scored.select("doc_id", F.col("s.severity").alias("severity"), F.col("s.p_toxic").alias("p_toxic"), (F.col("s.p_toxic") >= 0.5).alias("rejected"))


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that are not rejected, in docs' own columns."""
    return docs.where(toxicity(model)["p_toxic"] < 0.5)
