"""Exact deduplication: counting quotient filters find repeated fingerprints, bytes decide.

A text is normalised by deleting the white space `[\\x20\\x09-\\x0D]`. Each
partition builds one counting quotient filter of its 64-bit fingerprints, cut
by leading bits; the cuts meet by those bits and merge without loss: two filters'
sorted remainders are woven into each other, nothing is sorted again. Texts whose merged count is one are unique. All others
go to byte verification: their normalised bytes are grouped, so that a
collision of fingerprints never joins two texts.

Defined cases: a null text counts as empty, and all empty texts are equal; of
equal texts the one with the most code points stays, then the smallest doc_id
(null last); of rows that agree in both, exactly one stays. An empty table
gives an empty result. Other columns are ignored by `exact_dedup` and passed
through by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, joined_by_size, keep_rows, materialize, salt

#: Fingerprints that one merging task holds, about; the number of cuts follows from it.
FINGERPRINTS_PER_CUT = 1 << 20
#: Repeated fingerprints up to which they are sent to the scans (8 bytes each); beyond it texts are shuffled to them.
BROADCAST_FINGERPRINTS = 1 << 21


class CountingQuotientFilter:
    """Sorted fingerprints as quotient runs of remainders, with counters.

    `occupied` has a bit for each quotient that has a run, `runend` a bit for each
    stored remainder that ends its run, so both together give every quotient.
    Counters above one stand in a sparse list beside the remainders.
    """

    def __init__(self, quotient_bits: int, remainder_bits: int, occupied: np.ndarray, runend: np.ndarray, remainders: np.ndarray, many: np.ndarray, counts: np.ndarray):
        self.q, self.r = quotient_bits, remainder_bits
        self.occupied, self.runend, self.remainders, self.many, self.counts = occupied, runend, remainders, many, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        """From fingerprints of `bits` bits, in any order and with repeats."""
        keys, n = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        return cls.from_sorted(keys, n, bits)

    @classmethod
    def from_sorted(cls, keys: np.ndarray, n: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        """From ascending different fingerprints and how often each is there."""
        q = max(1, int(len(keys)).bit_length())
        r = bits - q
        quotients = (keys >> np.uint64(r)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotients] = True
        runend = np.ones(len(keys), bool)
        runend[:-1] = quotients[1:] != quotients[:-1]
        many = np.flatnonzero(n > 1)
        return cls(q, r, occupied, runend, keys & np.uint64((1 << r) - 1), many.astype(np.int64), n[many].astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order, and their counts."""
        run = np.concatenate([[0], np.cumsum(self.runend)[:-1]]) if len(self.runend) else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied)[run.astype(np.int64)] if len(run) else run
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.many] = self.counts
        return (quotients.astype(np.uint64) << np.uint64(self.r)) | self.remainders, counts

    def count(self, fingerprint: int) -> int:
        quotient, remainder = fingerprint >> self.r, fingerprint & ((1 << self.r) - 1)
        if not self.occupied[quotient]:
            return 0
        run = int(np.count_nonzero(self.occupied[:quotient]))
        ends = np.flatnonzero(self.runend)
        first, last = (ends[run - 1] + 1 if run else 0), ends[run] + 1
        at = first + int(np.searchsorted(self.remainders[first:last], np.uint64(remainder)))
        if at == last or int(self.remainders[at]) != remainder:
            return 0
        k = int(np.searchsorted(self.many, at))
        return int(self.counts[k]) if k < len(self.many) and self.many[k] == at else 1

    @classmethod
    def merge(cls, filters: Iterable[CountingQuotientFilter], bits: int = 64) -> CountingQuotientFilter:
        """All filters as one, two of similar size at a time."""
        waiting: list[CountingQuotientFilter] = []
        for f in filters:
            waiting.append(f)
            while len(waiting) > 1 and len(waiting[-1].remainders) >= len(waiting[-2].remainders):
                waiting.append(waiting.pop().merged(waiting.pop(), bits))
        while len(waiting) > 1:
            waiting.append(waiting.pop().merged(waiting.pop(), bits))
        return waiting[0] if waiting else cls.build(np.zeros(0, np.uint64), bits)

    def merged(self, other: CountingQuotientFilter, bits: int = 64) -> CountingQuotientFilter:
        """Both filters' runs of remainders are in order, so they are woven into each other; nothing is sorted."""
        a, n = self.items()
        b, m = other.items()
        # Where the other's fingerprints go; equal ones stand right after their twin.
        place = np.searchsorted(a, b, "right") + np.arange(len(b))
        mine = np.ones(len(a) + len(b), bool)
        mine[place] = False
        keys, counts = np.empty(len(mine), np.uint64), np.empty(len(mine), np.int64)
        keys[place], counts[place], keys[mine], counts[mine] = b, m, a, n
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        return self.from_sorted(keys[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(keys) else counts, bits)

    def to_bytes(self) -> bytes:
        width = (self.r + 7) // 8
        remainders = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.q, self.r, len(self.remainders), len(self.many)], "<i8")
        return b"".join([head.tobytes(), np.packbits(self.occupied).tobytes(), np.packbits(self.runend).tobytes(), remainders.tobytes(), self.many.astype("<i8").tobytes(), self.counts.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, r, n, m = (int(x) for x in np.frombuffer(data, "<i8", 4))
        at = 32

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q).astype(bool)
        runend = np.unpackbits(take((n + 7) // 8), count=n).astype(bool)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : (r + 7) // 8] = take(n * ((r + 7) // 8)).reshape(n, (r + 7) // 8)
        many = take(8 * m).view("<i8")
        return cls(q, r, occupied, runend, wide.reshape(-1).view("<u8").astype(np.uint64), many, take(8 * m).view("<i8"))


def _normalised(text: pa.Array) -> list[bytes]:
    return [(x or b"").translate(None, SPACE_BYTES) for x in text.cast(pa.binary()).to_pylist()]


def _fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def _digests(with_md5: bool):
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256(x).digest() for x in _normalised(b["text"])]
            points = pc.fill_null(pc.utf8_length(b["text"]), 0).cast(pa.int64())
            raw = [hashlib.md5(x or b"").hexdigest() for x in b["text"].cast(pa.binary()).to_pylist()] if with_md5 else [None] * len(sha)
            yield pa.RecordBatch.from_arrays([b["doc_id"], points, pa.array([_fingerprint(d) for d in sha], pa.int64()), pa.array(sha, pa.binary()), pa.array(raw, pa.string())], ["doc_id", "n_points", "fp", "sha", "text_md5"])

    return digests


def _build_filters(cut_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b["fp"].to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        rest = 64 - cut_bits
        cuts = (keys >> np.uint64(rest)).astype(np.int64)
        names, at = np.unique(cuts, return_index=True)
        ends = [*at[1:], len(keys)]
        payload = [CountingQuotientFilter.build(keys[a:z] & np.uint64((1 << rest) - 1), bits=rest).to_bytes() for a, z in zip(at, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(payload, pa.binary())], ["cut", "filter"])

    return build


def _merge_filters(cut_bits: int):
    def merge(table: pa.Table) -> pa.Table:
        rest = 64 - cut_bits
        merged = CountingQuotientFilter.merge((CountingQuotientFilter.from_bytes(x.as_py()) for x in table["filter"]), bits=rest)
        keys, counts = merged.items()
        keys = (keys | np.uint64(table["cut"][0].as_py() << rest)).view(np.int64)
        return pa.table({"fp": pa.array(keys[counts > 1], pa.int64()), "n": pa.array(counts[counts > 1], pa.int64())})

    return merge


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) of every fingerprint that occurs more than once, from a stored table with the column fp."""
    bits = max(6, (fingerprints.count() // FINGERPRINTS_PER_CUT).bit_length())
    filters = fingerprints.select("fp").mapInArrow(_build_filters(bits), "cut long, filter binary")
    return filters.groupBy("cut").applyInArrow(_merge_filters(bits), "fp long, n long")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _normalised(b["text"])
        digests = [hashlib.sha256(x).digest() for x in texts]
        yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(d) for d in digests], pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], ["fp", "sha", "bytes"])


def _groups(docs: DataFrame, with_md5: bool = False) -> DataFrame:
    """A row per document: row_id, doc_id, sha, and of verified groups of two or more their group_size, keep_id and keep_row."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = table.mapInArrow(_digests(with_md5), "doc_id long, n_points long, fp long, sha binary, text_md5 string")
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "exact-rows")
    repeated = materialize(repeated_fingerprints(rows).select("fp"), "exact-fingerprints")
    few = repeated.count() <= BROADCAST_FINGERPRINTS
    routed = F.broadcast(repeated) if few else repeated
    # Byte verification: equal bytes collapse on the map side, so a copied text travels once from each task.
    texts = table.mapInArrow(_texts, "fp long, sha binary, bytes binary").join(routed, "fp", "left_semi")
    distinct = texts.groupBy("fp", "sha", "bytes").agg(F.count(F.lit(1)).alias("n"))
    verified = distinct.groupBy("fp", "sha").agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    one = F.expr("assert_true(texts = 1, 'two different texts have the same SHA-256')").isNull()
    verified = verified.where("group_size > 1").where(one).select("sha", "group_size")
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull(), F.expr("~doc_id"), F.expr("~row_id"), "doc_id", "row_id")).alias("best")
    # `part` keeps the rows of one text in several tasks until each has only its best row.
    mine = rows.join(routed, "fp", "left_semi").withColumn("part", salt(64, "row_id"))
    picked = mine.groupBy("sha", "part").agg(best).groupBy("sha").agg(F.max("best").alias("best"))
    groups = verified.join(picked, "sha").select("sha", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"))
    return joined_by_size(rows, materialize(groups, "exact-groups"), "sha", "group_size", rows.count())


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs).select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_row", F.col("row_id")) == F.col("row_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without their exact copies, in docs' own columns; one row of each group stays."""
    kept = F.coalesce("keep_row", F.col("row_id")) == F.col("row_id")
    return keep_rows(docs, _groups(docs, with_md5=True).select("doc_id", "text_md5", kept.alias("kept")))
